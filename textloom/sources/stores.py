"""Files of any store that both Spark and Arrow reach, for code on executors."""

from __future__ import annotations

import pyarrow.fs as fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a URI; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def exists(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != fs.FileType.NotFound


def remove(files: fs.FileSystem, path: str) -> None:
    """Delete a folder; one that isn't there is no error."""
    if exists(files, path):
        files.delete_dir(path)
