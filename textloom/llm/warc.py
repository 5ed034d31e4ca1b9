"""WARC archives: written as one gzip stream a file, normalised to a member a record.

``write_archives`` puts a record per page into archives that are each a single
gzip stream. ``normalise`` inflates such a file once, as a stream, and writes
every record again as a gzip member of its own, with a sidecar index of
(record id, type, offset, length). ``read_records`` reads single members back
by that index. Archives and indexes are real files in a shared folder (any
store that pyarrow's file systems reach); memory is bounded by the largest
record.

Defined results: a null payload is empty, a null or unprintable URL is written
percent-encoded; a payload of at least ``least`` bytes that other pages share is
written once, by the page with the largest id (by each of its rows, should the
id repeat), and revisited by the others; rows with a null id are written and
read back with a null id, and refer like any other. Files are named by a random
id, so a task that runs again never touches another's file, and only files
listed in the manifest count. An empty table writes no archive. Payloads are
written whole, however long; repeated rows are a record each. Only the named
columns are read, so others can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.scratch import checked_broadcast, materialize, new_path, small_batches

LEAST = 1000
#: Bytes of records after which a new archive begins.
ARCHIVE_BYTES = 32 << 20
LEVEL = 4
CHUNK = 1 << 18
#: Fixed values of the format.
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
ID_PREFIX = "urn:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record with an HTTP block; a revisit keeps the block's head only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields by lower-case name, block) of one record."""
    head, _, rest = data.partition(CRLF * 2)
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def inflate(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces."""
    inflater = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            if piece := inflater.decompress(data, CHUNK):
                yield piece
            data = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
            if inflater.eof:
                inflater = zlib.decompressobj(31)
    if rest := inflater.flush():
        yield rest


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated WARC stream, by their Content-Length."""
    buffer, at = bytearray(), 0
    for piece in pieces:
        buffer += piece
        while (end := buffer.find(CRLF * 2, at)) >= 0:
            head = bytes(buffer[at:end]).lower()
            length = int(head.rpartition(b"\r\ncontent-length:")[2].partition(CRLF)[0])
            if len(buffer) < end + 4 + length + 4:
                break
            yield bytes(buffer[at : end + 4 + length + 4])
            at = end + 4 + length + 4
        if at > CHUNK:
            del buffer[:at]
            at = 0
    if len(buffer) > at:
        raise ValueError("the archive ends inside a record")


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def normalise(source: str, target: str) -> list[tuple[str, str, int, int]]:
    """Rewrite a monolithic archive with a member a record; returns and writes its index.

    The index file, ``target`` + ``.idx``, has a line of record id, type, offset
    and length by tabs for each record.
    """
    fs, path = store(source)
    out_fs, out_path = store(target)
    index, at = [], 0
    with fs.open_input_stream(path, compression=None) as stream, out_fs.open_output_stream(out_path, compression=None) as out:
        for data in records(inflate(stream)):
            packed = member(data)
            head = data[: data.find(CRLF * 2)].decode("utf-8").split("\r\n")
            fields = dict(line.split(": ", 1) for line in head[1:])
            index.append((fields["WARC-Record-ID"], fields["WARC-Type"], at, len(packed)))
            out.write(packed)
            at += len(packed)
    with out_fs.open_output_stream(out_path + ".idx", compression=None) as out:
        out.write("".join(f"{i}\t{t}\t{o}\t{n}\n" for i, t, o, n in index).encode())
    return index


def refer(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to, revisit): who writes a shared payload, and who refers to whom.

    Only digests that occur more than once are joined back, so the payloads
    are shuffled only if those are too many to broadcast.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    keyed = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    shared = keyed.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = keyed.join(checked_broadcast(materialize(shared.select("digest", "first"), "shared")), "digest", "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(referred: DataFrame, folder: str) -> DataFrame:
    """(archive): monolithic gzip archives of all records, written to ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        fs.create_dir(base, recursive=True)
        out, size = None, 0

        def close():
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["archive"])

        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, packer = fs.open_output_stream(f"{base}/{name}", compression=None), 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record(page_id, url, payload, refers_to, revisit)
                out.write(packer.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return referred.mapInArrow(run, "archive string")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, record_id, type, offset, length): the index of the normalised copies in ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                index = normalise(source, target)
                columns = [list(c) for c in zip(*index, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([target] * len(index)), pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                    ["archive", "record_id", "type", "offset", "length"],
                )

    return archives.mapInArrow(run, "archive string, record_id string, type string, offset bigint, length bigint")


def read_records(index: DataFrame) -> DataFrame:
    """The pages behind index rows, each from its own member.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url). A
    response's digest and length are checked against its payload.
    """

    def number(field: str | None) -> int | None:
        digits = (field or "").strip("<>").removeprefix(ID_PREFIX)
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, handle = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != opened:
                    if handle:
                        handle.close()
                    fs, path = store(archive)
                    opened, handle = archive, fs.open_input_file(path)
                fields, block = parse(zlib.decompress(handle.read_at(length, offset), 31))
                http, _, payload = block.partition(CRLF * 2)
                size = int(http.lower().rpartition(b"content-length:")[2].strip())
                sha = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                revisit = fields["warc-type"] == "revisit"
                if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != sha):
                    raise ValueError(f"damaged record {fields['warc-record-id']}")
                rows.append((number(fields["warc-record-id"]), size, sha, fields["warc-type"], number(fields.get("warc-refers-to")), fields["warc-target-uri"]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"],
            )

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
    return index.select("archive", "offset", "length").mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None, keep_whole: bool = True) -> DataFrame:
    """Write, normalise and read back all pages.

    The archives stay in ``folder``/records, listed in ``folder``/manifest; files
    that aren't listed there are left-overs of tasks that ran again. The
    monolithic ones stay in ``folder``/whole, unless they aren't kept: they go
    once the index is written, after which no task reads them.
    """
    spark: SparkSession = pages.sparkSession
    small_batches(spark, 500)
    folder = folder or new_path(spark, "warc")
    written = materialize(write_archives(refer(pages), f"{folder}/whole"), "written")
    # Every archive is a task of its own at most; the written tables fix whose files count.
    spread = written.repartition(max(1, min(written.count(), 10_000)))
    index = materialize(normalise_archives(spread, f"{folder}/records"), "index")
    index.select("archive").distinct().coalesce(1).write.text(f"{folder}/manifest")
    if not keep_whole:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/whole")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return read_records(index)


def op8_warc(pages: DataFrame) -> DataFrame:
    return round_trip(pages, keep_whole=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
         g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= {LEAST} AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= {LEAST} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
    FROM g"""
