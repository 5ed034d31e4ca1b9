"""The registered queries over the library's own operators."""

from __future__ import annotations

from textloom.plans.queries import files, readability, tables, texts
from textloom.plans.queries.common import Query

flagship = tables.flagship


def queries() -> dict[str, Query]:
    return dict(sorted((texts.R.queries | tables.R.queries | files.R.queries | readability.R.queries).items()))


def oracle_sql() -> dict[str, str]:
    return dict(sorted((texts.R.sql | tables.R.sql | files.R.sql | readability.R.sql).items()))
