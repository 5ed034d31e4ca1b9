"""Sharding, URL rules, WARC archives, mixing and the pipeline."""

import hashlib
import os
import zlib

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from textloom.llm import mixing, queries, scratch, sharding, url_rules, warc

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, duck, name):
    same_rows(queries.queries()[name](spark, small), duck, SQL[name])


def test_sharding_of_odd_rows(spark):
    rows = [(i, f"text {i}", 1) for i in range(500)] + [(7, "hot", 2)] * 900 + [(None, None, 3), (None, "é", 3), (1, "", 3), (2, "long " * 100_000, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    got = sharding.op5_rendezvous(df).collect()
    assert sorted((r.doc_id, r.text_crc32) for r in got if r.doc_id is not None) == sorted((d, zlib.crc32(t.encode())) for d, t, _ in rows if d is not None)
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(1, 0), (3, zlib.crc32("é".encode()))}
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    by_key = {}
    for r in got:
        assert by_key.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 16)
    assert sharding.op5_rendezvous(df.limit(0)).count() == 0


def test_weighted_shards(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    out = sharding.shard_rows(df, [1.0, 3.0], [1.0, 3.0, 1.0])
    n = {r.shard: r["count"] for r in out.groupBy("shard").count().collect()}
    assert n[1] / 20000 == pytest.approx(0.75, abs=0.02)
    moved = out.where("shard <> grown_shard")
    assert moved.where("grown_shard <> 2").count() == 0 and moved.count() / 20000 == pytest.approx(0.2, abs=0.02)
    with pytest.raises(ValueError, match="positive"):
        sharding.rendezvous(F.lit("a"), [1.0, 0.0])


def test_sharding_stays_native(spark, small):
    plan = queries.op5_shard(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


URLS = {
    "http://a.Example.COM/en/71?x#y": ("a.example.com", "/en/71", "example.com/en/7", "allow"), "https://x.com/en/": ("x.com", "/en/", "com/en/", "block"),
    "https://xcom/en/": ("xcom", "/en/", None, "allow"), "com://com/en/8": ("com", "/en/8", "com/en/", "block"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
    "h://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"), "h://b.net/de/8": ("b.net", "/de/8", "net/de/", "allow"), "h://org?/es/": ("org", "", None, "allow"),
    "h://a.b.c.org/es/://x": ("a.b.c.org", "/es/://x", "org/es/", "block"), "://org/es/\n": ("org", "/es/\n", "org/es/", "block"), "": ("", "", None, "allow"), "h://İ.com#": ("İ.com", "", None, "allow"),
}


def test_url_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] * 2 + [(None, "h://org/es/", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, rule string")
    got = sorted((str(tuple(r)) for r in url_rules.op7_rules(df).collect()))
    want = [(i, *URLS[u]) for i, u, _ in rows[: 2 * len(URLS)]] + [(None, "org", "/es/", "org/es/", "block")]
    assert got == sorted(map(str, want))
    assert url_rules.judge(df, spark.createDataFrame([], "host string, path string, action string"), "keep").where("verdict <> 'keep'").count() == 0
    assert url_rules.op7_rules(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "h://org/es/" + "x/" * 50_000), (2, "h://" + "a." * 200_000 + "com/en/")], "page_id bigint, url string")
    assert {r.page_id: (len(r.path), r.rule, r.verdict) for r in url_rules.op7_rules(long).collect()} == {1: (100_004, "org/es/", "block"), 2: (4, "com/en/", "block")}
    rules = spark.createDataFrame([("org", "/es/", "block"), ("org", "/es/", "allow"), (None, "/", "block"), ("com", None, "block")], "host string, path string, action string")
    assert {(r.rule, r.verdict) for r in url_rules.judge(df, rules, "keep").collect()} == {(None, "keep"), ("org/es/", "allow")}


def test_warc_round_trip(spark, tmp_path):
    big, other = "é" * 600, "x" * 70000
    pages = [(1, "http://a/ b\n", big), (9, None, big), (4, "u", big), (2, "u", "small"), (3, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", other), (7, "v", other), (8, "u", other[:-1]), (None, "u", other), (10, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, payload_bytes int")
    folder = f"file://{tmp_path}/w"
    got = warc.round_trip(df, folder).collect()
    assert len(got) == len(pages)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(i), len((t or "").encode()), sha(t)) for i, _, t in pages)
    assert sorted((str(r.page_id), r.refers_to) for r in got if r.record_type == "revisit") == [("1", 9), ("4", 9), ("None", 7)]
    whole = [f"{tmp_path}/w/whole/{n}" for n in os.listdir(tmp_path / "w/whole")]
    for name in os.listdir(tmp_path / "w/records"):
        if name.endswith(".idx"):
            body = (tmp_path / "w/records" / name.removesuffix(".idx")).read_bytes()
            for line in (tmp_path / "w/records" / name).read_text().splitlines():
                _, kind, offset, length = line.split("\t")
                fields, _ = warc.parse(zlib.decompress(body[int(offset) : int(offset) + int(length)], 31))
                assert fields["warc-type"] == kind
    for path in whole:  # each archive is one gzip member
        inflater = zlib.decompressobj(31)
        inflater.decompress(open(path, "rb").read())
        assert inflater.eof and not inflater.unused_data
    listed = {r.value.rsplit("/", 1)[-1] for r in spark.read.text(f"{folder}/manifest").collect()}
    assert listed == {n for n in os.listdir(tmp_path / "w/records") if n.endswith(".gz")}
    warc.round_trip(df, f"file://{tmp_path}/v", keep_whole=False).collect()
    assert sorted(os.listdir(tmp_path / "v")) == ["manifest", "records"]
    assert warc.op8_warc(df.limit(0)).count() == 0


def test_normalising_an_already_split_archive(tmp_path):
    one, two = (warc.record(i, "http://x", b"body" * i, None, False) for i in (1, 2000))
    (tmp_path / "a.gz").write_bytes(warc.member(one) + warc.member(two))
    index = warc.normalise(f"file://{tmp_path}/a.gz", f"file://{tmp_path}/b.gz")
    assert [i[0] for i in index] == ["<urn:page:1>", "<urn:page:2000>"] and (tmp_path / "b.gz.idx").exists()
    (tmp_path / "c.gz").write_bytes(warc.member(one + two[:-9]))
    with pytest.raises(ValueError, match="ends inside"):
        warc.normalise(f"file://{tmp_path}/c.gz", f"file://{tmp_path}/d.gz")


def brute_budgets(leaves, budget, weights, epochs):
    """Fill by repeatedly capping the children that are short."""

    def share(nodes, total):
        nodes = {k: v for k, v in nodes.items() if v[0] > 0 and v[1] > 0}
        full, left, open_ = {}, total, dict(nodes)
        while open_:
            level = left / sum(w for _, w in open_.values())
            short = {k for k, (c, w) in open_.items() if c / w < level}
            if not short:
                return full | {k: min(c, int(level * w)) for k, (c, w) in open_.items()}
            for k in short:
                full[k] = open_.pop(k)[0]
                left -= full[k]
        return full

    def live(leaf):
        return all(weights.get(name, {}).get(node, 1) > 0 for name, node in zip(("domain", "lang", "source"), leaf, strict=True))

    def cap(prefix):
        return sum(t * epochs for leaf, t in leaves.items() if leaf[: len(prefix)] == prefix and live(leaf))

    out = {(): budget}
    for depth, name in enumerate(("domain", "lang", "source")):
        new = {}
        for parent, total in out.items():
            below = {leaf[: depth + 1] for leaf in leaves if leaf[:depth] == parent}
            new |= share({b: (cap(b), weights.get(name, {}).get(b[-1], 1)) for b in below}, total)
        out = new
    return out


def test_mixing_of_odd_rows(spark):
    docs = [(i, "w " * (1 + i % 9), ("en", "de", None)[i % 3], f"s{i % 5}" if i % 4 else "src0", 1) for i in range(400)]
    docs += [(900, None, "en", "s1", 1), (901, " \n", "en", "s1", 1), (None, "a b c", "xx", None, 1)] + [(5, "hot row", "en", "src0", 1)] * 300
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, mix_tokens int")
    weights = {"domain": {"even": 3, "odd": 1}, "lang": {"en": 4}, "source": {"src0": 5, "s1": 0}}
    for total, epochs in ((100, 1), (1200, 1), (2500, 2), (10**6, 3), (0, 1)):
        got = mixing.mix(df, mixing.domain_of(F.col("source")), weights, F.lit(total), epochs).collect()
        leaves, rows = {}, {}
        for d, t, lang, source, _ in docs:
            leaf = ("even" if source and source[-1] in "02468" else "odd", lang or "", source or "")
            leaves[leaf] = leaves.get(leaf, 0) + len((t or "").split())
            for e in range(epochs):
                key = hashlib.md5(f"42:{e}:{'' if d is None else d}:{zlib.crc32((t or '').encode())}".encode()).hexdigest()
                rows.setdefault(leaf, []).append((e, key, len((t or "").split())))
        want = []
        for leaf, budget in brute_budgets(leaves, total, weights, epochs).items():
            before = 0
            for e, key, n in sorted(rows[leaf]):
                if before < budget and n:
                    want.append((leaf, e, key, n))
                before += n
        assert sorted(((r.mix_domain, r.mix_lang, r.mix_source), r.mix_epoch, r.mix_order, r.mix_tokens) for r in got) == sorted(want)
        assert not any(r.mix_source == "s1" for r in got)
    assert mixing.op9_mix(df.limit(0)).count() == 0


def test_budget_of_zero_weights_is_handed_on(spark):
    rows = [(i, "w " * 10, "en", "s1" if i < 50 else "s2" if i < 60 else "s3", "x" if i < 60 else "y") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, dom string")
    got = mixing.mix(df, F.col("dom"), {"source": {"s1": 0}}, F.lit(400)).collect()
    assert sum(r.mix_tokens for r in got) == 400 and not any(r.source == "s1" for r in got)


def test_rows_and_picks_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    monkeypatch.setattr(mixing, "RUN", 7)
    docs = [(i % 300, f"w{i % 300} " * (1 + i % 13), "en", "src0", i % 3) for i in range(900)] + [(5, "hot", "en", "src0", k % 2) for k in range(400)] + [(6, "long " * 100_000, "de", "src1", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for total in (1, 3000, 7000, 12000, 10**6):
        made = mixing.Mixture(df, F.lit("d"), {}, F.lit(total), 2, 1, ("doc_id", "text", "lang", "source"))
        key = lambda r: (r.mix_epoch, r.mix_order, r.mix_tokens)
        picks, rows = made.picks().collect(), made.rows().collect()
        assert sorted(map(key, picks)) == sorted(map(key, rows)) and all(len(r.text.split()) == r.mix_tokens for r in rows)


def test_mixing_stays_native(spark, small):
    plan = queries.op9_mix_sources(spark, small)._jdf.queryExecution().toString()
    plan += mixing.mixed_documents(spark.read.parquet(f"{small}/documents.parquet"), 1)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_scratch_tables_are_read_back_and_released(spark):
    df = scratch.materialize(spark.range(3), "test")
    assert scratch.shared_dir(spark).startswith("file:/") and df.count() == 3
    assert scratch.checked_broadcast(df, 2) is df
    path = df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert os.path.exists(path)
    other = os.path.join(scratch.shared_dir(spark).removeprefix("file://").removeprefix("file:"), "textloom", "of-another-job")
    os.makedirs(other, exist_ok=True)
    scratch.release(spark)
    assert not os.path.exists(path) and os.path.exists(other)
    os.rmdir(other)
