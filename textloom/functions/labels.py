"""Labels, sources and names from paths and file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN, TECHNICAL = "pls", "no_pls"


def source_of(path: Column, prefix: str) -> Column:
    """First segment below ``prefix`` if another follows it, else ``unknown``."""
    rest = F.regexp_replace(F.regexp_replace(path, f"^\\Q{prefix}\\E", ""), "^/+", "")
    parts = F.split(rest, "/")
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("unknown")


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def label_of(path: Column, plain: Sequence[str] = (), technical: Sequence[str] = (), default: str = "NO_PLS") -> Column:
    """PLS if a plain pattern occurs in the path (tried first), then NO_PLS, else the default."""
    low = F.lower(path)
    any_of = lambda patterns: F.exists(F.array(*(F.lit(p.lower()) for p in patterns)), lambda p: F.contains(low, p)) if patterns else F.lit(False)
    return F.when(any_of(plain), "PLS").when(any_of(technical), "NO_PLS").otherwise(default)


def plain_by_section(name: Column) -> Column:
    """The rule of accumulated sections: 1 if the file name has ``_accumulated_section``."""
    return F.when(F.contains(name, F.lit("_accumulated_section")), 1).otherwise(0)


def plain_by_suffix(name: Column) -> Column:
    """The rule of suffixes: 1 if the name has ``-pls.txt``, ``-abstract.txt`` or ``_section``."""
    return F.when(F.contains(name, F.lit("-pls.txt")) | F.contains(name, F.lit("-abstract.txt")) | F.contains(name, F.lit("_section")), 1).otherwise(0)


def label_name(code: Column) -> Column:
    return F.when(code == 1, PLAIN).when(code == 0, TECHNICAL)


def label_code(name: Column) -> Column:
    return F.when(F.lower(name) == PLAIN, 1).when(F.lower(name) == TECHNICAL, 0)


def normalize_doc_id(doc_id: Column) -> Column:
    """What stands before the first ``_``, without ``-abstract`` and ``-pls``."""
    head = F.substring_index(doc_id.cast("string"), "_", 1)
    return F.replace(F.replace(head, F.lit("-abstract"), F.lit("")), F.lit("-pls"), F.lit(""))


def output_name(path: str, folder: str | None = None, suffix: str = "_metrics.parquet") -> str:
    """``<stem>_metrics.parquet`` in ``folder``, or next to the input."""
    base, _, name = path.rstrip("/").rpartition("/")
    return f"{folder.rstrip('/') if folder else base or '.'}/{name.rpartition('.')[0] or name}{suffix}"
