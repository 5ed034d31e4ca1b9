"""A directory-listing web API as a Spark data source, ``textloom_listing``.

Options: ``url``, an endpoint that answers with a JSON array of objects with
``name``, ``type`` (``file`` or ``dir``), ``download_url`` and ``url``; folders
are followed. Each file is a partition of its own, fetched on an executor.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _fetch(url: str) -> bytes:
    from urllib.request import urlopen

    with urlopen(url, timeout=60) as answer:  # noqa: S310
        return answer.read()


def walk(url: str, suffix: str = ".txt", fetch: Callable[[str], bytes] = _fetch, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(path, download URL) of all files below a listing."""
    for entry in json.loads(fetch(url)):
        path = f"{prefix}{entry['name']}"
        if entry["type"] == "dir":
            yield from walk(entry["url"], suffix, fetch, f"{path}/")
        elif path.lower().endswith(suffix):
            yield path, entry["download_url"]


class FilePartition(InputPartition):
    def __init__(self, path: str, url: str):
        self.path, self.url = path, url


class ListingReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [FilePartition(p, u) for p, u in walk(self.options["url"], self.options.get("suffix", ".txt"))] or [FilePartition("", "")]

    def read(self, partition):
        if partition.url:
            yield partition.path, _fetch(partition.url).decode("utf-8", "ignore")


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textloom_listing"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema):
        return ListingReader(self.options)
