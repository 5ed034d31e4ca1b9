"""URL filtering by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the expressions a rule could have: each suffix of
its host with as many labels as some rule's host, with each prefix of its path as long as some
rule's path. Expressions and rules meet in an equi-join on the first four bytes
of their SHA-256, so the shipped keys stay short; the full digest is confirmed
after it, and of the rules that fit, the longest wins. Only expressions that meet
a rule leave the join; their best rule by host and path is joined back to the
pages, so no key holds a row of every page.

Defined results: a null URL or one without ``://`` has an empty host and path,
which no rule fits. Repeated rows and ids keep a row each. Of two rules with
the same expression, the one with the smaller action wins; rules with a null
host or path fit nothing. A URL counts whole, however long. An empty rule table
leaves every URL with the default verdict, an empty page table gives no rows.
Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import checked_broadcast, materialize

PREFIX_HEX = 8
#: Upper-case letters that hosts are folded from; others stay.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """The text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """The text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, depths: list[int]) -> Column:
    """The suffixes of a host at label boundaries that have one of these numbers of labels."""
    labels = F.split(host, r"\.")
    counts = F.filter(F.array(*map(F.lit, depths)), lambda n: n <= F.size(labels))
    return F.transform(counts, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page.

    ``rules`` has the string columns host, path and action. The distinct
    lengths of rule paths and label counts of rule hosts travel as arrays,
    bounded by the longest path and host.
    """
    table = (
        rules.select("host", "path", "action")
        .where("host is not null and path is not null")
        .groupBy("host", "path")
        .agg(F.min("action").alias("action"))
        .withColumn("digest", _digest(F.col("host"), F.col("path")))
        .select(
            F.concat("host", "path").alias("rule"),
            "action",
            "digest",
            F.substring("digest", 1, PREFIX_HEX).alias("prefix"),
            F.length("path").alias("path_length"),
            F.size(F.split("host", r"\.")).alias("depth"),
        )
    )
    table = materialize(table, "rules")
    depths = sorted(r.depth for r in table.select("depth").distinct().collect())
    lengths = sorted(r.path_length for r in table.select("path_length").distinct().collect())
    url = F.col(url_col).cast("string")
    parsed = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    if not lengths:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    cuts = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    prefixes = F.transform(cuts, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(host_suffixes(F.col("host"), depths), lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    exploded = parsed.select("host", "path", F.explode(expressions).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    matched = exploded.join(checked_broadcast(table.withColumnRenamed("digest", "full")), "prefix").where("digest = full")
    best = F.max(F.struct(F.length("rule").alias("length"), F.col("rule"), F.col("action"))).alias("best")
    judged = checked_broadcast(materialize(matched.groupBy("host", "path").agg(best), "judged"))
    return parsed.join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict")
    )


#: The registered query's rules: host, path, action.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op7_rules(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    return judge(pages, spark.createDataFrame(RULES, "host string, path string, action string"))


def oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    fold = f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    return f"""
    WITH rules(rhost, rpath, action) AS (VALUES {rules}),
         p AS (SELECT row_number() OVER () AS row, page_id, {fold} AS host,
                      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
         m AS (SELECT row, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
               FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY row)
    SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m USING (row)"""
