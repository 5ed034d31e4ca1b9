"""Conversation repair: the cheapest edits that bring the turns' roles into the grammar ``(s?(ua)+)?``.

Rows are damaged, checked and numbered with column functions. Each conversation
is cut into pieces of ``PIECE`` rows, a piece being a string of one code a row;
pieces are hash-partitioned into batches, and a recursive DuckDB query in each
batch advances one turn of all its pieces at a time, keeping the least cost and
audit for every pair of states a piece is entered and left in. A second recursive
query joins ``PIECE`` neighbouring pieces, and runs until a conversation is one.
So a conversation of any length is spread over all tasks.

Least (cost, audit) pairs may be kept one per state: two audits over the same
rows with equal cost can't be proper prefixes of each other, as only inserted
turns make the longer one longer, and those cost. So what follows never turns
their order around.

The audit says which rows stay and, with the grammar, as what: its length
without deletions is odd if a system turn was kept. Texts are read once more and
only for rows that stay.

Defined results: a null conv_id is a conversation; any null is one space in the
checksum, in roles and in texts, but a null turn stays first and out of the
gaps; rows of equal turn are ordered by a digest of role and text; copies of a
row that are equal in all four columns are deleted as duplicates; texts count
whole, however long; an empty table gives no rows. Gaps beyond 64 bits are null.
Columns other than conv_id, turn, role and text aren't read, so their names
can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.checksums import CRC_TABLE, crc32
from textloom.llm.runs import parts_of, placed, sha256_in_order
from textloom.llm.scratch import materialize

#: Fixed values of the contract: the damage by remainder, the costs, the pairs of neighbours that are legal.
DAMAGES = 20
DROP, EMPTY, UNSTOP, REPEAT, REROLE = range(5)
DELETED, REROLED, INSERTED, TRUNCATED = 4, 3, 3, 3
LEGAL = ("su", "ua", "au")
WHITE = " \t\n\x0b\x0c\r"
STOPS = ".!?"

#: Rows of a piece, and pieces that are joined at a time.
PIECE = 64
#: Pieces in a batch, about; rows copied out at a time; rows a task remembers to have sent.
BATCH = 2000
SEEN = 100_000
#: Codes of a row by the initial of its role (s, u, a, another): whole, truncated, to be deleted.
WHOLE, CUT, BAD = "suao", "SUAO", "0123"
#: States of the grammar: nothing yet, after s, after u, after a. Those after which u and a may come, and the last ones allowed.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
FINAL = (START, AFTER_A)


def _inserted(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, audit) after no, one or two inserted turns; more are never cheapest."""
    once = NEXT[state]
    return [(state, 0, ""), (once, INSERTED, "I"), (NEXT[once], 2 * INSERTED, "II")]


def moves() -> list[tuple[str, int, int, int, str]]:
    """(code, state, next state, cost, audit): what a row may do, after turns inserted before it; the best by cost, then audit."""
    best: dict[tuple[str, int, int], tuple[int, str]] = {}
    for code in WHOLE + CUT + BAD:
        initial = code.lower()
        extra = TRUNCATED if code in CUT else 0
        for state in NEXT:
            for at, cost, audit in _inserted(state):
                after = [(at, DELETED, "D")]
                if code not in BAD:
                    after.append((NEXT[at], REROLED + extra, "R"))
                    if initial == "s" and at == START:
                        after.append((AFTER_S, extra, "K"))
                    elif initial == ("a" if at == AFTER_U else "u"):
                        after.append((NEXT[at], extra, "K"))
                for to, c, edit in after:
                    key, value = (code, state, to), (cost + c, audit + edit)
                    best[key] = min(best.get(key, value), value)
    return [(*key, *value) for key, value in sorted(best.items())]


def endings() -> dict[int, tuple[int, str]]:
    """(cost, audit) of the turns that are inserted after the last row, by state."""
    return {state: min((cost, audit) for at, cost, audit in _inserted(state) if at in FINAL) for state in NEXT}


#: One turn of all pieces at a time. ``piece`` holds (g, k, codes), ``move`` the table of moves.
TURNS_SQL = """
    WITH RECURSIVE path AS (
        SELECT g, 0 AS step, s.state AS entered, s.state AS state, 0::BIGINT AS cost, '' AS audit
        FROM piece, (SELECT DISTINCT state FROM move) s WHERE k > 0 OR s.state = 0
        UNION ALL
        SELECT g, step, entered, state, best.cost, best.audit
        FROM (SELECT p.g, p.step + 1 AS step, p.entered, m.next AS state, min(struct_pack(cost := p.cost + m.cost, audit := p.audit || m.audit)) AS best
              FROM path p JOIN piece c ON c.g = p.g JOIN move m ON m.code = substr(c.codes, p.step + 1, 1) AND m.state = p.state
              GROUP BY ALL))
    SELECT p.g, entered, state, cost, audit FROM path p JOIN piece c ON c.g = p.g AND p.step = length(c.codes)"""

#: One piece of all groups of neighbours at a time. ``part`` holds (g, k, step, entered, state, cost, audit).
PIECES_SQL = """
    WITH RECURSIVE size AS (SELECT g, any_value(k) AS k, max(step) + 1 AS size FROM part GROUP BY g),
    path AS (
        SELECT g, 0 AS step, s.state AS entered, s.state AS state, 0::BIGINT AS cost, '' AS audit
        FROM size, (SELECT unnest(range(4))::INTEGER AS state) s WHERE k > 0 OR s.state = 0
        UNION ALL
        SELECT g, step, entered, state, best.cost, best.audit
        FROM (SELECT p.g, p.step + 1 AS step, p.entered, m.state AS state, min(struct_pack(cost := p.cost + m.cost, audit := p.audit || m.audit)) AS best
              FROM path p JOIN part m ON m.g = p.g AND m.step = p.step AND m.entered = p.state
              GROUP BY ALL))
    SELECT p.g, entered, state, cost, audit FROM path p JOIN size z ON z.g = p.g AND p.step = z.size"""

PARTS = "conv string, k bigint, entered int, state int, cost bigint, audit string"


def _duck(memory: str = "512MB"):
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": memory})


def _answers(con, sql: str, keys: pa.Table) -> pa.Table:
    """The query's rows with (conv, k) for the number ``g`` that stands for them."""
    found = con.sql(sql).to_arrow_table()
    at = found["g"].combine_chunks().cast(pa.int64())
    columns = [keys["conv"].take(at), keys["k"].take(at), found["entered"].cast(pa.int32()), found["state"].cast(pa.int32()), found["cost"].cast(pa.int64()), found["audit"].cast(pa.string())]
    return pa.table(columns, ["conv", "k", "entered", "state", "cost", "audit"])


def _solve_pieces(batch: pa.Table) -> pa.Table:
    """(conv, k, codes) -> PARTS."""
    con = _duck()
    rows = moves()
    move = pa.table({n: [r[i] for r in rows] for i, n in enumerate(("code", "state", "next", "cost", "audit"))})
    piece = pa.table({"g": pa.array(range(len(batch)), pa.int32()), "k": batch["k"], "codes": batch["codes"]})
    con.register("move", move)
    con.register("piece", piece)
    return _answers(con, TURNS_SQL, batch)


def _join_pieces(batch: pa.Table) -> pa.Table:
    """PARTS of neighbours, numbered by ``step`` in each (conv, k) -> PARTS."""
    con = _duck()
    con.register("given", batch)
    con.sql("CREATE TABLE names AS SELECT row_number() OVER () - 1 AS g, conv, k FROM (SELECT DISTINCT conv, k FROM given)")
    con.sql("CREATE TABLE part AS SELECT n.g, b.* FROM given b JOIN names n ON n.conv = b.conv AND n.k = b.k")
    return _answers(con, PIECES_SQL, con.sql("SELECT conv, k FROM names ORDER BY g").to_arrow_table())


def _in_batches(rows: DataFrame, pieces: int, solve) -> DataFrame:
    """``solve`` over batches of whole (conv, k) groups, hash-partitioned; a batch holds some BATCH groups."""
    batches = max(1, -(-pieces // BATCH))
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("conv", "k"), F.lit(batches)))
    return dealt.groupBy("batch").applyInArrow(solve, PARTS)


def _space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies, digest): rows after damage, each as often as ``copies`` says; ``conv`` is conv_id as a string, empty for null."""
    kind = F.crc32(F.concat(_space("conv_id"), F.lit(":"), _space("turn")).cast("binary")) % DAMAGES
    text = _space("text")
    text = F.when(F.col("_kind") == EMPTY, "").when(F.col("_kind") == UNSTOP, F.translate(text, STOPS, "")).otherwise(text)
    role = F.when(F.col("_kind") == REROLE, "user").otherwise(_space("role"))
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("_kind")).where(F.col("_kind") != DROP)
    after = rows.select(
        F.coalesce(F.col("conv_id").cast("bigint").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("bigint"), role.alias("role"), text.alias("text"),
        F.when(F.col("_kind") == REPEAT, 2).otherwise(1).cast("bigint").alias("copies"),
    )
    return after.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text").cast("binary")))


def checked(after: DataFrame) -> DataFrame:
    """Narrow rows, one a (conv, turn, digest): initial of the role, blank, cut (no stop at its end), copies, first (of its role and text)."""
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    initial = F.substring("role", 1, 1)
    narrow = after.select(
        "conv", "turn", "digest", "copies", F.when(initial.isin(*"sua"), initial).otherwise("o").alias("initial"),
        (F.trim("text", F.lit(WHITE)) == "").alias("blank"), (~last.isin(*STOPS)).alias("cut"),
    )
    rows = narrow.groupBy("conv", "turn", "digest", "initial", "blank", "cut").agg(F.sum("copies").alias("copies"))
    rows = materialize(rows, "checked")
    # A join on the whole key, in which a text that recurs all over a long conversation is no hot key.
    firsts = rows.groupBy("conv", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("t"))
    firsts = firsts.select("conv", "digest", F.col("t.turn").alias("turn"), F.lit(True).alias("first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv", "digest", "turn")]
    return rows.alias("r").join(firsts.alias("f"), same, "left").select("r.*", F.coalesce("f.first", F.lit(False)).alias("first"))


def numbered(rows: DataFrame) -> DataFrame:
    """(conv, pos, code, turn, digest): a row for every copy, in order from 0."""
    at = placed(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("digest")], "ordered", F.col("copies"))
    kind = F.when(F.col("blank") | ~F.col("first") | (F.col("copy") > 0), 2).when(F.col("cut"), 1).otherwise(0)
    place = F.instr(F.lit(WHOLE), F.col("initial"))
    code = F.substring(F.element_at(F.array(F.lit(WHOLE), F.lit(CUT), F.lit(BAD)), kind + 1), place, F.lit(1))
    # A row's copies are dealt out in runs, so that no task makes all of a hot one's.
    runs = at.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(BATCH).cast("bigint"))))
    each = runs.withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + BATCH, F.col("copies")) - 1)))
    return each.select("conv", (F.col("before") + F.col("copy")).alias("pos"), code.alias("code"), "turn", "digest", "blank", "copy", "first")


def _pieces(rows: DataFrame) -> DataFrame:
    """(conv, k, codes, illegal): the codes of PIECE rows, and their neighbours that aren't legal, the last row before the piece included."""
    k = F.expr(f"pos div {PIECE}")
    here = F.struct(k.alias("k"), (F.col("pos") % PIECE).cast("int").alias("step"))
    ahead = F.struct((k + 1).alias("k"), F.lit(-1).alias("step"))
    # The last row of a piece is told to the next one too.
    told = rows.select("conv", "code", F.explode(F.when(F.col("pos") % PIECE == PIECE - 1, F.array(here, ahead)).otherwise(F.array(here))).alias("p"))
    listed = told.groupBy("conv", "p.k").agg(F.array_sort(F.collect_list(F.struct("p.step", "code"))).alias("rows")).where("rows[size(rows) - 1].step >= 0")
    initials = F.translate(F.concat_ws("", F.transform("rows", lambda r: r["code"])), CUT + BAD, WHOLE + WHOLE)
    pairs = F.transform(F.sequence(F.lit(1), F.length("initials") - 1), lambda i: F.substring(F.col("initials"), i, F.lit(2)))
    return (
        listed.withColumn("initials", initials)
        .withColumn("codes", F.concat_ws("", F.transform(F.filter("rows", lambda r: r["step"] >= 0), lambda r: r["code"])))
        .select("conv", "k", "codes", F.when(F.length("initials") > 1, F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL)))).otherwise(0).cast("bigint").alias("illegal"))
    )


def solved(pieces: DataFrame) -> DataFrame:
    """(conv, cost, audit): the cheapest repair of each conversation whose written pieces (conv, k, codes) are given."""
    # Their number and the longest conversation's: all that reaches the driver.
    n, last = pieces.agg(F.count("*"), F.max("k")).first()
    parts = _in_batches(pieces.select("conv", "k", "codes"), n, _solve_pieces)
    while (last or 0) > 0:
        parts = materialize(parts, "parts")
        step = (F.col("k") % PIECE).cast("int").alias("step")
        met = parts.select("conv", F.expr(f"k div {PIECE}").alias("k"), step, "entered", "state", "cost", "audit")
        n, last = -(-n // PIECE), last // PIECE
        parts = _in_batches(met, n, _join_pieces)
    tail = F.create_map(*(x for state, (cost, audit) in endings().items() for x in (F.lit(state), F.struct(F.lit(cost).alias("cost"), F.lit(audit).alias("audit")))))
    whole = F.struct((F.col("cost") + tail[F.col("state")]["cost"]).alias("cost"), F.concat("audit", tail[F.col("state")]["audit"]).alias("audit"))
    return parts.groupBy("conv").agg(F.min(whole).alias("best")).select("conv", "best.cost", "best.audit")


def kept_rows(audits: DataFrame) -> DataFrame:
    """(conv, pos, place, role, before, after): the rows that stay, by their place among the repaired turns.

    ``role`` is the one a row gets (null: its own); ``before`` and ``after`` are
    the roles of the turns inserted next to it, ``after`` at the end only. No
    conversation consists of inserted turns alone, as deleting is free of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roles = pa.list_(pa.string())
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), roles, roles)
        names = ["conv", "pos", "place", "role", "before", "after"]
        out: list[list] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for conv, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system = (len(audit) - audit.count("D")) % 2
                place, pos, added, last = 0, 0, [], None
                for edit in audit:
                    if edit != "D":
                        role = ("user", "assistant")[(place - system) % 2]
                        if edit == "I":
                            added.append(role)
                        else:
                            last = [conv, pos, place, None if edit == "K" else role, added, []]
                            out.append(last)
                            added = []
                        place += 1
                    pos += edit != "I"
                    if len(out) >= 10 * BATCH:
                        # The last row waits for what is inserted after it.
                        out, held = out[:-1], out[-1]
                        yield batch_of()
                        out = [held]
                if last:
                    last[5] = added
        if out:
            yield batch_of()

    return audits.select("conv", "audit").mapInArrow(run, "conv string, pos bigint, place bigint, role string, before array<string>, after array<string>")


def _folded(texts: DataFrame) -> DataFrame:
    """``texts`` without most copies of a (conv, turn, digest): those that a task meets again soon go before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            keep = []
            for key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keep.append(key not in seen)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return texts.mapInArrow(run, texts.schema)


def repaired(after: DataFrame, rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, place, role, text) of the repaired conversations, from ``damaged``, ``numbered`` and ``solved`` rows.

    Rows that stay meet their texts in the one shuffle of texts, by conversation:
    both are sorted by (turn, digest), which is the order of the repaired turns.
    So the result lies in order, too, each conversation in one partition, which
    a digest of it needs anyhow; rows stream through, none is held.
    """
    # Written, so that the join is planned by their size, not by that of the audits they come from.
    stay = materialize(kept_rows(audits), "kept").join(rows.select("conv", "pos", "turn", "digest"), ["conv", "pos"])
    stay = stay.select("conv", "turn", "digest", F.lit(False).alias("is_text"), "place", "role", "before", "after", F.lit(None).cast("string").alias("text"))
    texts = _folded(after.select("conv", "turn", "digest", "role", "text"))
    texts = texts.select("conv", "turn", "digest", F.lit(True), F.lit(None).cast("bigint"), "role", F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), "text")
    both = stay.union(texts).repartition(parts_of(after), "conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "digest", "is_text")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list | None = None  # the last row that stays, until its text comes
        for batch in batches:
            out: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns[:8]]
            for i, (conv, turn, digest, is_text, place, role, before, behind) in enumerate(zip(*columns, strict=True)):
                if not is_text:
                    waiting = [(conv, turn, digest), place, role, before, behind]
                elif waiting and waiting[0] == (conv, turn, digest):
                    _, at, given, before, behind = waiting
                    turns = [*((x, "") for x in before), (role if given is None else given, batch.column(8)[i].as_py()), *((x, "") for x in behind)]
                    out += [(conv, at - len(before) + k, *t) for k, t in enumerate(turns)]
                    waiting = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv", "place", "role", "text"])

    return both.mapInArrow(merge, "conv string, place bigint, role string, text string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, turns): a row of counts, cost and audit a conversation, and the rows of ``repaired``."""
    after = damaged(conversations)
    rows = materialize(numbered(checked(after)), "numbered")
    pieces = materialize(_pieces(rows), "pieces")
    audits = materialize(solved(pieces), "audits")
    spans = rows.groupBy("conv", "turn").count().groupBy("conv").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("turn").alias("distinct"))
    gaps = F.try_add(F.try_subtract(F.try_subtract("hi", "lo"), F.col("distinct")), F.lit(1).cast("bigint"))
    faults = rows.groupBy("conv").agg(
        F.count_if("blank").alias("blank"),
        F.count_if(~F.col("blank") & (~F.col("first") | (F.col("copy") > 0))).alias("duplicate"),
        F.count_if(F.col("code").isin(*CUT)).alias("truncated"),
    )
    neighbours = pieces.groupBy("conv").agg(F.sum("illegal").alias("illegal"))
    ids = conversations.select(F.coalesce(F.col("conv_id").cast("bigint").cast("string"), F.lit("")).alias("conv")).distinct()
    report = ids
    for part in (spans.select("conv", F.when(F.col("distinct") == 0, 0).otherwise(gaps).alias("gaps"), F.lit(True).alias("some")), faults, neighbours, audits):
        report = report.join(part, "conv", "left")
    zero = F.lit(0).cast("bigint")
    report = report.select(
        F.when(F.col("conv") != "", F.col("conv")).cast("bigint").alias("conv_id"), "conv", F.when(F.col("some"), F.col("gaps")).otherwise(zero).alias("gaps"),
        *(F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
    )
    return report, repaired(after, rows, audits)


def op11_repairs(conversations: DataFrame) -> DataFrame:
    """The registered query's columns: the report, with a digest of each repaired conversation."""
    report, turns = repair(conversations)
    digests = sha256_in_order(turns.select("conv", F.concat("role", F.lit(":"), "text").alias("item")), ["conv"], "item", "\n", "repaired_sha256")
    return report.join(digests, "conv", "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def oracle(table: str = "conversations") -> str:
    """DuckDB SQL for ``op11_repairs`` over ``table``: whole conversations, a row at a time, in one recursion."""
    move = ", ".join(f"('{code}', {state}, {to}, {cost}, '{audit}')" for code, state, to, cost, audit in moves())
    tail = ", ".join(f"({state}, {cost}, '{audit}')" for state, (cost, audit) in endings().items())
    white = r"\x20\x09-\x0D"
    return rf"""
    WITH RECURSIVE {CRC_TABLE}, move(code, state, next, cost, audit) AS (VALUES {move}), tail(state, cost, audit) AS (VALUES {tail}),
         o AS (SELECT coalesce(conv_id::VARCHAR, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                      {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % {DAMAGES} AS kind FROM {table}, crc),
         d AS (SELECT conv, turn, CASE kind WHEN {REROLE} THEN 'user' ELSE role END AS role,
                      CASE kind WHEN {EMPTY} THEN '' WHEN {UNSTOP} THEN translate(text, '{STOPS}', '') ELSE text END AS text
               FROM o, range(CASE kind WHEN {REPEAT} THEN 2 ELSE 1 END) WHERE kind <> {DROP}),
         n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text)) - 1 AS pos FROM d),
         f AS (SELECT *, NOT regexp_matches(text, '[^{white}]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS seen,
                      NOT regexp_matches(text, '[{STOPS}][{white}]*$') AS cut,
                      CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial,
                      lag(role[1]) OVER (PARTITION BY conv ORDER BY pos) AS earlier FROM n),
         c AS (SELECT *, CASE WHEN blank OR seen THEN translate(initial, '{WHOLE}', '{BAD}') WHEN cut THEN upper(initial) ELSE initial END AS code FROM f),
         path AS (
             SELECT conv, 0 AS step, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM (SELECT DISTINCT conv FROM c)
             UNION ALL
             SELECT conv, step, state, best.cost, best.audit
             FROM (SELECT p.conv, p.step + 1 AS step, m.next AS state, min(struct_pack(cost := p.cost + m.cost, audit := p.audit || m.audit)) AS best
                   FROM path p JOIN c ON c.conv = p.conv AND c.pos = p.step JOIN move m ON m.code = c.code AND m.state = p.state GROUP BY ALL)),
         a AS (SELECT conv, any_value(turns) AS turns, min(struct_pack(cost := p.cost + t.cost, audit := p.audit || t.audit)) AS best
               FROM path p JOIN (SELECT conv, count(*) AS turns FROM c GROUP BY conv) USING (conv) JOIN tail t USING (state) WHERE p.step = turns GROUP BY conv),
         e AS (SELECT conv, i, best.audit[i] AS edit, (length(replace(best.audit, 'D', '')) % 2) AS system,
                      length(replace(best.audit[1:i], 'I', '')) - 1 AS pos, length(replace(best.audit[1:i], 'D', '')) - 1 AS place
               FROM (SELECT *, unnest(range(1, length(best.audit) + 1)) AS i FROM a)),
         r AS (SELECT e.conv, place, CASE WHEN edit = 'K' THEN c.role WHEN (place - system) % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
                      CASE WHEN edit = 'I' THEN '' ELSE c.text END AS text
               FROM e LEFT JOIN c ON c.conv = e.conv AND c.pos = e.pos WHERE edit <> 'D'),
         h AS (SELECT conv, sha256(string_agg(role || ':' || text, chr(10) ORDER BY place)) AS repaired_sha256 FROM r GROUP BY conv),
         s AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                      count(*) FILTER (NOT blank AND seen) AS duplicate, count(*) FILTER (NOT blank AND NOT seen AND cut) AS truncated,
                      count(*) FILTER (pos > 0 AND coalesce(earlier || role[1], '') NOT IN ('su', 'ua', 'au')) AS illegal
               FROM c GROUP BY conv)
    SELECT CASE WHEN q.conv <> '' THEN q.conv END::BIGINT AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(a.best.cost, 0) AS cost, coalesce(a.best.audit, '') AS audit,
           coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv FROM o) q LEFT JOIN s USING (conv) LEFT JOIN a USING (conv) LEFT JOIN h USING (conv)"""
