"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

A token budget is propagated from the root through domain, language and source.
At each node the children share its budget in proportion to their weights; a
child short of tokens is filled up and the rest goes to its siblings. As a
child's capacity is that of the leaves in its subtree whose weights are positive
all the way, a shortage reaches an ancestor's siblings only when its own siblings
are used up. Each leaf then takes a prefix, by tokens, of its documents in seeded
order: epoch by epoch, each epoch in an order of its own.

Texts are read once for a narrow table of ids, content checks and token counts,
in which equal rows are one row with a count. No leaf is sorted as a whole: only
the epoch in which its budget ends is ordered, and there token sums by hash range
show in which range it ends. That range is divided again until it holds some
hundred rows, however large the leaf is; only these are ordered.

Defined results: null domain, language or source count as ``''``, a null text
has no tokens; documents without tokens are never selected; rows that repeat
count and are ordered as separate rows (rows of one id and text are
interchangeable); a document is taken if the prefix before it is short of the
leaf's budget. A text counts whole, however long. An empty table or budget gives
no rows. Input columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.scratch import checked_broadcast, materialize

#: Hex digits of the seeded order that one round divides a range by, and rows that need not be divided further.
RANGE_DIGITS, RANGE_ROWS = 2, 256
#: Copies of one row that are dealt out by one generated row.
RUN = 4096
LEVELS = ("mix_domain", "mix_lang", "mix_source")
ADDED = (*LEVELS, "mix_tokens", "mix_epoch", "mix_order")


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _weight(node: Column, weights: Mapping[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("bigint")
    if min(weights.values()) < 0:
        raise ValueError("weights must not be negative")
    known = F.create_map(*(F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], int(kv[1]))))
    return F.coalesce(F.try_element_at(known, node), F.lit(1)).cast("bigint")


def _fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Share ``budget`` among the nodes below each parent: least(cap, level * weight).

    The water level is the budget left over full nodes, by weight of the others,
    at the first node in order of cap / weight that it doesn't fill; nodes after
    that one would give a lower level.
    """
    key = [F.col(c) for c in parent] or [F.lit(0)]
    order = Window.partitionBy(*key).orderBy(F.col("ratio").asc(), *[F.col(c).asc() for c in LEVELS if c in nodes.columns])
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.partitionBy(*key)
    ranked = nodes.where("weight > 0 and cap > 0").withColumn("ratio", F.col("cap").cast("double") / F.col("weight").cast("double"))
    levels = ranked.withColumns({"full": F.coalesce(F.sum("cap").over(before), F.lit(0)), "rest": F.sum("weight").over(after)}).withColumn(
        "level", (F.col("budget") - F.col("full")).cast("double") / F.col("rest").cast("double")
    )
    chosen = levels.withColumn("water", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everywhere))
    share = F.floor(F.col("water") * F.col("weight").cast("double")).cast("bigint")
    return chosen.withColumn("budget", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", share))).drop(
        "ratio", "full", "rest", "level", "water"
    )


def leaf_budgets(leaves: DataFrame, budget: Column, weights: Mapping[str, Mapping[str, int]], epochs: int) -> DataFrame:
    """Token budgets of the leaves (domain, language, source, tokens); budget may use ``total``, their sum."""
    weight = {c: _weight(F.col(c), weights.get(kind, {})) for c, kind in zip(LEVELS, ("domain", "lang", "source"), strict=True)}
    live = F.least(*weight.values()) > 0
    capped = leaves.select(*LEVELS, F.when(live, F.col("tokens") * epochs).otherwise(0).alias("cap"), "tokens")
    domain, lang, source = LEVELS
    total = Window.partitionBy(F.lit(0))
    top = capped.groupBy(domain).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("total", F.sum("tokens").over(total))
    top = top.withColumn("budget", F.greatest(F.lit(0), budget).cast("bigint")).withColumn("weight", weight[domain])
    mid = capped.groupBy(domain, lang).agg(F.sum("cap").alias("cap")).withColumn("weight", weight[lang])
    low = capped.withColumn("weight", weight[source])
    filled = _fill(top, []).select(domain, "budget")
    filled = _fill(mid.join(filled, domain), [domain]).select(domain, lang, "budget")
    return _fill(low.join(filled, [domain, lang]), [domain, lang]).select(*LEVELS, "budget")


def _name(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _order(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.col("mix_key")).cast("binary"))


def _copies(rows: DataFrame, n: str) -> DataFrame:
    """Every row as often as its column ``n`` says, without that column."""
    runs = rows.withColumn("mix_run", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n), F.lit(RUN).cast("bigint"))))
    return runs.withColumn("mix_copy", F.explode(F.sequence("mix_run", F.least(F.col("mix_run") + RUN - 1, F.col(n))))).drop("mix_run", "mix_copy", n)


class Mixture:
    """What a mix takes: ``narrow`` has the rows, ``ends`` where each leaf's budget ends, ``border`` how many copies of the rows there."""

    def __init__(self, docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], budget: Column, epochs: int, seed: int, names: tuple[str, str, str, str]):
        id_col, text_col, lang_col, source_col = names
        self.seed, self.id_col, self.text_col = seed, id_col, text_col
        clean = docs.drop(*(c for c in docs.columns if c in ADDED))
        self.columns = clean.columns
        key = F.concat_ws(":", _name(F.col(id_col)), F.crc32(_name(F.col(text_col)).cast("binary")).cast("string"))
        self.leaved = clean.withColumns({LEVELS[0]: _name(domain), LEVELS[1]: _name(F.col(lang_col)), LEVELS[2]: _name(F.col(source_col)), "mix_key": key})
        counted = self.leaved.select(*LEVELS, "mix_key", F.col(id_col).alias("mix_id"), token_count(F.col(text_col)).alias("mix_tokens")).where("mix_tokens > 0")
        self.narrow = materialize(counted.groupBy(*LEVELS, "mix_key", "mix_id", "mix_tokens").agg(F.count("*").alias("n")), "narrow")
        leaves = materialize(self.narrow.groupBy(*LEVELS).agg(F.sum(F.col("n") * F.col("mix_tokens")).alias("tokens"), F.count("*").alias("rows")), "leaves")
        budgets = leaf_budgets(leaves, budget, weights, epochs).where("budget > 0")
        whole = F.least(F.expr("budget div tokens"), F.lit(epochs))
        ends = leaves.join(budgets, list(LEVELS)).select(*LEVELS, whole.cast("int").alias("last"), "budget", "tokens")
        left = F.when(F.col("last") < epochs, F.col("budget") - F.col("last") * F.col("tokens")).otherwise(0)
        self.ends = checked_broadcast(materialize(ends.select(*LEVELS, "last", left.alias("left"), F.lit("").alias("prefix")), "ends"))
        size = leaves.agg(F.max("rows")).first()[0] or 0
        while size > RANGE_ROWS:
            self._divide()
            size >>= 4 * RANGE_DIGITS
        prefix = Window.partitionBy(*LEVELS).orderBy("mix_order", "mix_id", "mix_tokens").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.col("n") * F.col("mix_tokens")).over(prefix), F.lit(0))
        border = self._at_end().withColumn("mix_before", before).where(F.col("mix_before") < F.col("left"))
        taken = F.least(F.col("n"), F.ceil((F.col("left") - F.col("mix_before")) / F.col("mix_tokens"))).cast("bigint")
        # A range of RANGE_ROWS rows, about, of each leaf.
        self.border = materialize(border.select(*LEVELS, "mix_key", "mix_id", "mix_tokens", F.col("last").alias("mix_epoch"), "mix_order", "n", taken.alias("taken")), "border")

    def _at_end(self) -> DataFrame:
        """The narrow rows in the range of the seeded order in which their leaf's budget ends."""
        ended = self.narrow.join(self.ends.where("left > 0"), list(LEVELS)).withColumn("mix_order", _order(self.seed, F.col("last")))
        return ended.where(F.startswith("mix_order", "prefix"))

    def _divide(self) -> None:
        digits = F.substring(F.col("mix_order"), F.length("prefix") + 1, F.lit(RANGE_DIGITS))
        sums = self._at_end().groupBy(*LEVELS, "last", "left", F.concat("prefix", digits).alias("prefix")).agg(F.sum(F.col("n") * F.col("mix_tokens")).alias("t"))
        upto = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("prefix"))
        reached = sums.withColumn("before", upto - F.col("t")).where("left > before")
        end = reached.groupBy(*LEVELS, "last").agg(F.max(F.struct("prefix", (F.col("left") - F.col("before")).alias("left"))).alias("end"))
        done = self.ends.where("left <= 0")
        self.ends = checked_broadcast(materialize(end.select(*LEVELS, "last", "end.left", "end.prefix").unionByName(done), "ends"))

    def _whole(self, rows: DataFrame) -> DataFrame:
        """``rows`` with mix_epoch and mix_order, once for each epoch that takes them wholly before the border range."""
        epochs = F.sequence(F.lit(0), F.when(F.col("left") > 0, F.col("last")).otherwise(F.col("last") - 1))
        some = F.col("last") + F.when(F.col("left") > 0, 1).otherwise(0) > 0
        dealt = rows.join(self.ends, list(LEVELS)).where(some).withColumn("mix_epoch", F.explode(epochs)).withColumn("mix_order", _order(self.seed, F.col("mix_epoch")))
        before = F.col("mix_order").substr(F.lit(1), F.length("prefix")) < F.col("prefix")
        return dealt.where((F.col("mix_epoch") < F.col("last")) | before).drop("last", "left", "prefix")

    def picks(self) -> DataFrame:
        """(mix_id and the ``mix_`` columns): a row for each document and epoch taken, from the narrow table alone."""
        columns = ["mix_id", *LEVELS, "mix_tokens", "mix_epoch", "mix_order", "n"]
        taken = self.border.withColumn("n", F.col("taken"))
        return _copies(self._whole(self.narrow).select(*columns).unionByName(taken.select(*columns)), "n")

    def rows(self) -> DataFrame:
        """The rows taken, with all columns and the ``mix_`` ones."""
        out = [*self.columns, *LEVELS, "mix_tokens", "mix_epoch", "mix_order"]
        text = F.col(self.text_col).cast("string")
        used = self.leaved.where(text.rlike(r"[^\x20\x09-\x0D]"))
        whole = self._whole(used).withColumn("mix_tokens", token_count(text))
        keys = self.border.groupBy(*LEVELS, "mix_key", "mix_epoch", "mix_order").agg(F.sum("n").alias("n"), F.sum("taken").alias("taken"))
        met = used.join(checked_broadcast(materialize(keys, "keys")), [*LEVELS, "mix_key"]).withColumn("mix_tokens", token_count(text))
        # A leaf has one group of equal rows at most that is taken in part.
        part = met.where("taken < n").withColumn("mix_content", F.xxhash64(*self.columns))
        shared = [*LEVELS, "mix_key", "mix_tokens", "mix_epoch", "mix_order", "taken"]
        kinds = part.groupBy(*shared, "mix_content").agg(F.first(F.struct(*self.columns)).alias("mix_row"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*LEVELS, "mix_key").orderBy("mix_content").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = kinds.withColumn("n", F.least("n", F.col("taken") - before)).where("n > 0")
        some = _copies(kept, "n").select(*(F.col("mix_row")[c].alias(c) for c in self.columns), *LEVELS, "mix_tokens", "mix_epoch", "mix_order")
        return whole.select(*out).union(met.where("taken = n").select(*out)).union(some)


def mix(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[str, Mapping[str, int]],
    budget: Column,
    epochs: int = 1,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """The selected rows of ``docs``, once for each epoch that takes them, with the ``mix_`` columns.

    ``weights`` maps ``domain``, ``lang`` and ``source`` to integer weights by
    node name (1 if absent); ``budget`` is a token count, and may use the column
    ``total``, all tokens of the table.
    """
    return Mixture(docs, domain, weights, budget, epochs, seed, (id_col, text_col, lang_col, source_col)).rows()


#: The registered query's tree: sources whose number ends in an even digit are of domain ``even``.
WEIGHTS = {"domain": {"even": 3, "odd": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
SHARE = (9, 10)


def domain_of(source: Column) -> Column:
    return F.when(F.coalesce(source, F.lit("")).rlike("[02468]$"), "even").otherwise("odd")


def _mixture(docs: DataFrame, epochs: int) -> Mixture:
    budget = F.expr(f"total * {SHARE[0]} div {SHARE[1]}")
    return Mixture(docs, domain_of(F.col("source")), WEIGHTS, budget, epochs, 42, ("doc_id", "text", "lang", "source"))


def mixed_documents(docs: DataFrame, epochs: int) -> DataFrame:
    return _mixture(docs, epochs).rows()


def op9_mix(docs: DataFrame) -> DataFrame:
    """Which documents a mix of nine tenths of the tokens takes, each at most twice."""
    return _mixture(docs, 2).picks().select(
        F.col("mix_id").alias("doc_id"), F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"),
        F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("tokens"), F.col("mix_order").alias("seed_order"),
    )


def oracle(epochs: int = 2, table: str = "documents", columns: str | None = None) -> str:
    """DuckDB SQL for ``op9_mix``: the same budgets, and each leaf's prefix by one running sum."""

    def weight(node: str, known: Mapping[str, int]) -> str:
        return "CASE " + " ".join(f"WHEN {node} = '{k}' THEN {v}" for k, v in known.items()) + " ELSE 1 END::BIGINT"

    def fill(name: str, nodes: str, parent: str, keys: str, keep: str) -> str:
        return f"""
         {name}_r AS (SELECT *, cap::DOUBLE / weight::DOUBLE AS ratio FROM ({nodes}) WHERE weight > 0 AND cap > 0),
         {name}_l AS (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY ratio, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                          / (sum(weight) OVER (PARTITION BY {parent} ORDER BY ratio, {keys} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM {name}_r),
         {name}_w AS (SELECT *, max(CASE WHEN ratio >= level THEN level END) OVER (PARTITION BY {parent}) AS water FROM {name}_l),
         {name} AS (SELECT {keep}, CASE WHEN water IS NULL THEN cap ELSE least(cap, floor(water * weight::DOUBLE)::BIGINT) END AS budget FROM {name}_w),"""

    columns = columns or "doc_id, domain, lang, source, epoch, tokens, seed_order"
    return f"""
    WITH d AS (SELECT * EXCLUDE (lang, source), coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      CASE WHEN regexp_matches(coalesce(source, ''), '[02468]$') THEN 'even' ELSE 'odd' END AS domain,
                      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM ({crc_table(table)})),
         leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
         {fill("dom", f"SELECT domain, (sum(tokens) * {epochs})::BIGINT AS cap, {weight('domain', WEIGHTS['domain'])} AS weight, (SELECT (sum(tokens) * {SHARE[0]} // {SHARE[1]})::BIGINT FROM leaves) AS budget FROM leaves GROUP BY domain", "0", "domain", "domain")}
         {fill("lan", f"SELECT domain, lang, (sum(l.tokens) * {epochs})::BIGINT AS cap, {weight('lang', WEIGHTS['lang'])} AS weight, any_value(dom.budget) AS budget FROM leaves l JOIN dom USING (domain) GROUP BY domain, lang", "domain", "domain, lang", "domain, lang")}
         {fill("src", f"SELECT domain, lang, source, l.tokens * {epochs} AS cap, {weight('source', WEIGHTS['source'])} AS weight, lan.budget FROM leaves l JOIN lan USING (domain, lang)", "domain, lang", "domain, lang, source", "domain, lang, source")}
         e AS (SELECT d.*, epoch::INTEGER AS epoch, md5('42:' || epoch || ':' || coalesce(doc_id::VARCHAR, '') || ':' || crc) AS seed_order
               FROM d, range({epochs}) r(epoch) WHERE tokens > 0),
         c AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, seed_order, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
    SELECT {columns} FROM c JOIN src USING (domain, lang, source) WHERE before < budget"""


def crc_table(table: str) -> str:
    """``table`` with ``crc``, the CRC-32 of its texts, which DuckDB lacks."""
    return f"""SELECT d.*, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
                       lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
               FROM {table} d, (SELECT list(c ORDER BY i) AS t FROM (
                    SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END, i::BIGINT) AS c
                    FROM range(256) r(i)))"""
