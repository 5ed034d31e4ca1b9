"""A sink, ``textloom_roots``, that writes a table to several roots in one pass: ``root/__label=<label>/part-*.parquet``.

Tasks write their rows by label below ``root/_staged-<run>`` of every root. Only
when all tasks are done does the driver move the staged folders into place, after
setting aside what was there; if that fails in any root, all are put back. A
failing task leaves no root changed: what was staged is removed. Files of tasks
that ran twice are left out, since the commit lists those that count.

Options: ``roots`` (a JSON array of URIs) and ``label`` (the column's name). A null
label goes to Hive's default folder. Modes: overwrite replaces a root's
contents, append adds files to it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from textloom.sources.stores import exists, remove, store

NULL = "__HIVE_DEFAULT_PARTITION__"
FOLDER = "__label"


@dataclass
class Written(WriterCommitMessage):
    """(folder of the label, file) of what one task staged in every root."""

    files: list[tuple[str, str]]


def folder_of(label: str | None) -> str:
    return f"{FOLDER}={NULL if label is None else quote(label, safe=' .-_')}"


class RootsWriter(DataSourceArrowWriter):
    def __init__(self, roots: list[str], label: str, overwrite: bool) -> None:
        self.roots, self.label, self.overwrite = roots, label, overwrite
        self.run = uuid.uuid4().hex

    def staged(self) -> Iterator[tuple]:
        """(file system, root, staging folder) of every root."""
        for root in self.roots:
            files, path = store(root)
            path = path.rstrip("/")
            yield files, path, f"{path}/_staged-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task, open_, out = uuid.uuid4().hex, {}, []
        for batch in iterator:
            column = batch.column(batch.schema.get_field_index(self.label))
            for label in pc.unique(column).to_pylist():
                rows = batch.filter(pc.is_null(column) if label is None else pc.fill_null(pc.equal(column, pa.scalar(label, column.type)), False))
                folder, name = folder_of(None if label is None else str(label)), f"part-{task}.parquet"
                if folder not in open_:
                    open_[folder] = []
                    out.append((folder, name))
                    for files, _, staged in self.staged():
                        files.create_dir(f"{staged}/{folder}")
                        open_[folder].append(pq.ParquetWriter(f"{staged}/{folder}/{name}", batch.schema, filesystem=files))
                for writer in open_[folder]:
                    writer.write_batch(rows)
        for writers in open_.values():
            for writer in writers:
                writer.close()
        return Written(out)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        listed = [f for m in messages if m for f in m.files]
        undo: list[tuple] = []
        try:
            for files, root, staged in self.staged():
                files.create_dir(root)
                if self.overwrite:
                    aside = f"{root}/_aside-{self.run}"
                    files.create_dir(aside)
                    for old in self._contents(files, root):
                        files.move(old, f"{aside}/{old.rsplit('/', 1)[-1]}")
                        undo.append((files, f"{aside}/{old.rsplit('/', 1)[-1]}", old))
                for folder, name in listed:
                    files.create_dir(f"{root}/{folder}")
                    files.move(f"{staged}/{folder}/{name}", f"{root}/{folder}/{name}")
                    undo.append((files, f"{root}/{folder}/{name}", f"{staged}/{folder}/{name}"))
        except BaseException:
            for files, now, before in reversed(undo):
                files.create_dir(before.rsplit("/", 1)[0])
                files.move(now, before)
            self._drop_empty(listed)
            self.abort([])
            raise
        self._clean()

    @staticmethod
    def _contents(files, root: str) -> list[str]:
        import pyarrow.fs as fs

        return [f.path for f in files.get_file_info(fs.FileSelector(root)) if not f.base_name.startswith(("_staged-", "_aside-"))]

    def _drop_empty(self, listed: list[tuple[str, str]]) -> None:
        """Delete folders that this run made and has emptied again."""
        import pyarrow.fs as fs

        for files, root, _ in self.staged():
            for folder in {f for f, _ in listed}:
                path = f"{root}/{folder}"
                if exists(files, path) and not files.get_file_info(fs.FileSelector(path)):
                    files.delete_dir(path)

    def _clean(self) -> None:
        for files, root, staged in self.staged():
            remove(files, staged)
            remove(files, f"{root}/_aside-{self.run}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()


class RootsSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textloom_roots"

    def writer(self, schema, overwrite: bool) -> RootsWriter:
        return RootsWriter(json.loads(self.options["roots"]), self.options.get("label", "label"), overwrite)
