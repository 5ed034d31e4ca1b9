"""Queries against their SQL on texts that the small tables lack."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import same_rows

from textloom.plans import queries

#: Empty ones, and some whose Latin-1 bytes pass for UTF-8 or that end in a line separator.
TEXTS = ["", "a", "Two words.", "", "", "", "\u00e9t\u00e9", "x\n", "", "\u4e2d\u6587", "aaa", "\u00c3\u00a9", "a\u2028", "a\u0085", "caf\u00e9 \u00c3\u00a9", ""]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    columns = {"doc_id": range(len(TEXTS)), "text": TEXTS, "lang": ["en"] * len(TEXTS), "source": ["s0", "s1", "s1", None] * 4, "n_chars": map(len, TEXTS)}
    pq.write_table(pa.table({k: list(v) for k, v in columns.items()}), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": list(range(len(TEXTS))), "quality": [0, 1, None, 1] * 4, "toxic": [0] * len(TEXTS)}), folder / "labels.parquet")
    return str(folder)


def equals_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    same_rows(queries.queries()[name](spark, folder), con, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["q19_entropy_chars", "q74_text_tree", "q75_latin_1_files"])
def test_empty_texts(spark, odd, name):
    equals_sql(spark, odd, name)


@pytest.mark.parametrize("name", ["q47_median_by_label", "q48_topvar_metrics", "q49_boxstats", "q50_histogram_density"])
def test_documents_without_a_label(spark, odd, name):
    equals_sql(spark, odd, name)
