"""The mirror of a listing: a second run reads only what is new, changed files come once, failures are repeated."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from textloom.sources import incremental


class Site:
    """A web site of folders and files whose contents and failures a test sets."""

    def __init__(self):
        self.files, self.tagged, self.broken, self.asked = {}, True, Counter(), Counter()
        site = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                site.asked[self.path] += 1
                if site.broken[self.path] > 0:
                    site.broken[self.path] -= 1
                    self.send_error(500)
                    return
                body = site.answer(self.path)
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server.server_port}"

    def answer(self, path):
        if path.startswith("/raw/"):
            return self.files[path[5:]]
        prefix = path.removeprefix("/list/")
        entries, seen = [], set()
        for name, body in self.files.items():
            if name.startswith(prefix):
                head, _, rest = name[len(prefix) :].partition("/")
                if rest and head not in seen:
                    seen.add(head)
                    entries.append({"name": head, "type": "dir", "url": f"{self.base}/list/{prefix}{head}/"})
                elif not rest:
                    entries.append({"name": head, "type": "file", "download_url": f"{self.base}/raw/{name}"} | ({"sha": str(hash(body))} if self.tagged else {}))
        return json.dumps(entries).encode()

    @property
    def fetched(self):
        return {p[5:]: n for p, n in self.asked.items() if p.startswith("/raw/")}


@pytest.fixture
def site():
    s = Site()
    s.files = {"a.txt": b"one", "x/b.TXT": b"two \xff", "x/y/c.txt": b"three", "x/d.csv": b"no text"}
    yield s
    s.server.shutdown()


def changed(mirror, since):
    return sorted((r.path, r.text) for r in mirror.changes(since).collect())


def test_only_changes_are_read(spark, site, tmp_path):
    mirror, url = incremental.Mirror(spark, str(tmp_path / "m")), f"{site.base}/list/"
    assert mirror.version() == 0 and changed(mirror, 0) == []
    assert mirror.sync(url) == 1
    assert changed(mirror, 0) == [("a.txt", "one"), ("x/b.TXT", "two "), ("x/y/c.txt", "three")]
    site.asked.clear()
    assert mirror.sync(url) == 2
    assert changed(mirror, 1) == [] and site.fetched == {}
    site.files |= {"x/y/c.txt": b"three!", "z/new.txt": b"four"}
    del site.files["a.txt"]
    assert mirror.sync(url) == 3
    assert changed(mirror, 2) == [("x/y/c.txt", "three!"), ("z/new.txt", "four")] and site.fetched == {"x/y/c.txt": 1, "z/new.txt": 1}
    assert sorted(r.path for r in mirror.index().collect()) == ["x/b.TXT", "x/y/c.txt", "z/new.txt"]


def test_untagged_files_come_once(spark, site, tmp_path):
    site.tagged = False
    mirror, url = incremental.Mirror(spark, str(tmp_path / "m")), f"{site.base}/list/"
    mirror.sync(url)
    site.files["a.txt"] = b"changed"
    mirror.sync(url)
    mirror.sync(url)
    assert changed(mirror, 1) == [("a.txt", "changed")] and site.fetched["x/b.TXT"] == 3


def test_failures_are_repeated(spark, site, tmp_path):
    mirror, url = incremental.Mirror(spark, str(tmp_path / "m")), f"{site.base}/list/"
    site.broken |= {"/list/x/": 1, "/raw/a.txt": 1, "/raw/x/y/c.txt": 99}
    mirror.sync(url, tries=2, wait=0.0)
    assert changed(mirror, 0) == [("a.txt", "one"), ("x/b.TXT", "two ")]
    assert [r.path for r in mirror.failures().collect()] == ["x/y/c.txt"] and "500" in mirror.failures().first().error
    site.broken.clear()
    mirror.sync(url, tries=1)
    assert changed(mirror, 1) == [("x/y/c.txt", "three")] and mirror.failures().count() == 0


def test_a_run_that_dies_has_no_effect(spark, site, tmp_path, monkeypatch):
    mirror, url = incremental.Mirror(spark, str(tmp_path / "m")), f"{site.base}/list/"
    mirror.sync(url)
    site.files["a.txt"] = b"changed"
    site.broken["/list/x/"] = 99
    with pytest.raises(Exception, match="500"):
        mirror.sync(url, tries=2, wait=0.0)
    site.broken.clear()
    assert mirror.version() == 1

    class Dies(incremental.Mirror):
        @property
        def _files(self):
            return self

        @_files.setter
        def _files(self, value):
            self.real = value

        def mkdirs(self, path):
            raise KeyboardInterrupt

        def __getattr__(self, name):
            return getattr(self.__dict__["real"], name)

    with pytest.raises(KeyboardInterrupt):
        Dies(spark, str(tmp_path / "m")).sync(url)
    assert mirror.version() == 1 and changed(mirror, 1) == []
    assert mirror.sync(url) == 2 and changed(mirror, 1) == [("a.txt", "changed")]


def test_a_stream_sees_each_change_once(spark, site, tmp_path):
    mirror, url = incremental.Mirror(spark, str(tmp_path / "m")), f"{site.base}/list/"

    def drain():
        source = spark.readStream.schema("path string, digest string, body binary").parquet(str(tmp_path / "m/files"))
        source.select("path").writeStream.option("checkpointLocation", str(tmp_path / "c")).format("parquet").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted(r.path for r in spark.read.parquet(str(tmp_path / "out")).collect())

    mirror.sync(url)
    assert drain() == ["a.txt", "x/b.TXT", "x/y/c.txt"]
    site.files["a.txt"] = b"changed"
    mirror.sync(url)
    assert drain() == ["a.txt", "a.txt", "x/b.TXT", "x/y/c.txt"]


def test_tags():
    assert incremental.tag_of({"sha": "x", "size": 1}) == "x" and incremental.tag_of({"size": 1}) is None
    assert incremental.tag_of({"size": 1, "last_modified": "t"}) == "1:t"
