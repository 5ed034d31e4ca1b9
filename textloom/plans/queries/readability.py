"""Queries over what lists and the corpus itself teach: syllables, familiar words, sentence ends, tokens, compatibility forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import cleaning, generation, hyphenation, kernels, metrics, tokenizer, tokens
from textloom.operators import sentences
from textloom.plans.queries import common as C

R = C.Registry()
#: Words in the list of familiar ones.
FAMILIAR = 3000


def _letters(names: str) -> str:
    return ", ".join(f"'{c}'" for c in names)


def _syllables_sql() -> str:
    """SQL of a word's syllables by ``hyphenation.rule_patterns``: places i whose highest digit is odd."""
    consonant = f"w[i + 1] IN ({_letters(hyphenation.CONSONANTS)})"
    before_le = f"i = length(w) - 3 AND right(w, 2) = 'le' AND {consonant} AND w[i + 1] NOT IN ('l', 'r')"
    silent = f"i = length(w) - 2 AND right(w, 1) = 'e' AND {consonant}"
    onset = f"i = 2 AND left(w, 3) IN ({_letters(hyphenation.ONSETS)})"
    plain = f"{consonant} AND w[i + 2] IN ({_letters(hyphenation.VOWELS)})"
    return f"1 + len(list_filter(range(2, greatest(2, length(w) - 1)), lambda i: ({before_le}) OR (({plain}) AND NOT ({silent}) AND NOT ({onset}))))"


def _bases_sql() -> str:
    """SQL list of ``hyphenation.bases``."""
    out = ["w"]
    for ending, (lost_e, doubled, y) in hyphenation.ENDINGS.items():
        stem, has = f"left(w, length(w) - {len(ending)})", f"ends_with(w, '{ending}') AND length(w) >= {len(ending) + hyphenation.STEM}"
        out.append(f"CASE WHEN {has} THEN {stem} END")
        short = f"left(w, length(w) - {len(ending) + 1})"
        if lost_e:
            out.append(f"CASE WHEN {has} THEN {stem} || 'e' END")
        if doubled:
            out.append(f"CASE WHEN {has} AND right({stem}, 1) = right({short}, 1) THEN {short} END")
        if y:
            out.append(f"CASE WHEN {has} AND right({stem}, 1) = 'i' THEN {short} || 'y' END")
    return f"[{', '.join(out)}]"


_WORDS = r"(SELECT doc_id, lower(t) AS w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS t FROM documents) WHERE regexp_full_match(t, '\p{L}+') GROUP BY ALL)"


@R.add(f"""
    WITH w AS {_WORDS},
         f AS (SELECT w FROM w GROUP BY w ORDER BY count(*) DESC, w LIMIT {FAMILIAR}),
         t AS (SELECT w, {_syllables_sql()} AS s, {_bases_sql()} AS bases FROM (SELECT DISTINCT w FROM w)),
         k AS (SELECT w FROM (SELECT w, unnest(bases) AS b FROM t) SEMI JOIN f ON f.w = b GROUP BY w),
         g AS (SELECT doc_id, sum(c)::BIGINT AS n, sum(c * s)::BIGINT AS syllables, coalesce(sum(c) FILTER (k.w IS NULL), 0)::BIGINT AS hard FROM w JOIN t USING (w) LEFT JOIN k USING (w) GROUP BY doc_id),
         d AS (SELECT doc_id, text, coalesce(n, 0) AS n, coalesce(syllables, 0) AS syllables, coalesce(hard, 0) AS hard, {C.n_sents('text')}::DOUBLE AS sents FROM documents LEFT JOIN g USING (doc_id))
    SELECT doc_id, n AS n_words, syllables AS n_syllables, hard AS n_difficult,
           round(CASE WHEN length(trim(text)) < 10 OR n = 0 THEN {generation.DEFAULTS['flesch_reading_ease']} ELSE greatest(0.0, least(100.0, 206.835 - 1.015 * (n / sents) - 84.6 * (syllables / n))) END::DOUBLE, 6) AS flesch,
           round(CASE WHEN length(trim(text)) < 10 OR n = 0 THEN {generation.DEFAULTS['dale_chall_readability_score']}
                      ELSE 0.1579 * (100 * hard / n) + 0.0496 * (n / sents) + CASE WHEN 100 * hard / n > 5 THEN 3.6365 ELSE 0.0 END END::DOUBLE, 6) AS dale_chall
    FROM d""")
def q78_familiar_words(spark, d):
    """Readability with syllables by patterns and the corpus's most common words as the familiar ones."""
    docs = C.documents(spark, d)
    types = docs.select(F.explode(F.array_distinct(tokens.words(F.col("text")))).alias("w")).where(F.col("w").rlike(r"^\p{L}+$"))
    common = types.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(FAMILIAR)
    tools = kernels.Tools(syllables=hyphenation.Hyphenation(hyphenation.rule_patterns()), familiar=hyphenation.Familiar(hyphenation.entries(common, "w")))
    held = docs.withColumn("s", metrics.word_statistics_a(F.col("text"), tools))
    scores = generation.readability_or_default(F.col("text"), F.col("s"), with_tools=True)
    return held.select(
        "doc_id", F.col("s.n").alias("n_words"), F.col("s.syllables").alias("n_syllables"), F.col("s.difficult").alias("n_difficult"),
        F.round(scores["flesch_reading_ease"], 6).alias("flesch"), F.round(scores["dale_chall_readability_score"], 6).alias("dale_chall"),
    )


def _quoted(signs: str) -> str:
    return "'" + signs.replace("'", "''") + "'"


_SURE = "core LIKE '%!' OR core LIKE '%?' OR (core LIKE '%.' AND core NOT LIKE '%..' AND NOT abbreviated AND NOT initial AND NOT number)"
_ENDS = f"""
    WITH t AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\\t-\\r \\x{{00A0}}]+') AS l FROM documents)),
         b AS (SELECT doc_id, i, core, rtrim(core, ',;:') AS body FROM (SELECT doc_id, i, rtrim(ltrim(t, {_quoted(sentences.OPENERS)}), {_quoted(sentences.CLOSERS)}) AS core FROM t)),
         w AS (SELECT *, lower(rtrim(body, '.!?')) AS type, body LIKE '%.' AS stop FROM b),
         c AS (SELECT type, count(*) FILTER (stop)::DOUBLE AS dotted, count(*) FILTER (NOT stop)::DOUBLE AS plain FROM w WHERE type <> '' GROUP BY type),
         n AS (SELECT sum(dotted + plain) AS n, sum(dotted) / sum(dotted + plain) AS p FROM c),
         a AS (SELECT type FROM (SELECT *, length(replace(type, '.', '')) AS letters FROM c, n) WHERE regexp_matches(type, '\\p{{L}}') AND dotted > 0
               AND -2 * (dotted * (ln(p) - ln({sentences.DOTTED}::DOUBLE)) + plain * (ln(1 - p) - ln(1 - {sentences.DOTTED}::DOUBLE))) * exp(-letters) * (length(type) - letters + 1) * pow(letters::DOUBLE, -plain) >= {sentences.ABBREVIATION}),
         m AS (SELECT w.*, a.type IS NOT NULL AS abbreviated, regexp_full_match(w.type, '\\p{{L}}') AS initial, regexp_full_match(w.type, '\\p{{Nd}}+') AS number FROM w LEFT JOIN a USING (type)),
         s AS (SELECT *, {_SURE} AS sure FROM m),
         x AS (SELECT *, lag(sure) OVER (PARTITION BY doc_id ORDER BY i) AS follows, lead(core) OVER (PARTITION BY doc_id ORDER BY i) AS next, lead(type) OVER (PARTITION BY doc_id ORDER BY i) AS next_type FROM s),
         f AS (SELECT type, count(*)::DOUBLE AS k FROM x WHERE follows AND type <> '' GROUP BY type),
         z AS (SELECT type, k, dotted + plain AS o, n, (SELECT sum(k) FROM f) AS b FROM f JOIN c USING (type), n),
         g AS (SELECT type FROM (SELECT *, o / n AS p0, k / b AS p1, (o - k) / (n - b) AS p2 FROM z) WHERE regexp_matches(type, '^\\p{{L}}') AND p1 > p0 AND
               -2 * ((k * ln(p0) + CASE WHEN b > k THEN (b - k) * ln(1 - p0) ELSE 0 END + CASE WHEN o > k THEN (o - k) * ln(p0) ELSE 0 END + CASE WHEN n - b - o + k > 0 THEN (n - b - o + k) * ln(1 - p0) ELSE 0 END)
                     - (k * ln(p1) + CASE WHEN b > k THEN (b - k) * ln(1 - p1) ELSE 0 END + CASE WHEN o > k THEN (o - k) * ln(p2) ELSE 0 END + CASE WHEN n - b - o + k > 0 THEN (n - b - o + k) * ln(1 - p2) ELSE 0 END)) >= {sentences.STARTER}),
         e AS (SELECT x.*, CASE WHEN next IS NULL OR core LIKE '%!' OR core LIKE '%?' THEN true WHEN core NOT LIKE '%.' THEN false WHEN core LIKE '%..' THEN left(next, 1) <> lower(left(next, 1))
                                WHEN abbreviated OR initial THEN left(next, 1) <> lower(left(next, 1)) AND g.type IS NOT NULL ELSE NOT (number AND left(next, 1) <> upper(left(next, 1))) END AS ends
               FROM x LEFT JOIN g ON g.type = x.next_type),
         q AS (SELECT doc_id, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
         r AS (SELECT doc_id, k, count(*) AS c FROM q GROUP BY ALL)
    SELECT d.doc_id, coalesce(u.n, 0) AS n_sents, coalesce(u.longest, 0) AS longest
    FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, max(c) AS longest FROM r GROUP BY doc_id) u USING (doc_id)"""


@R.add(_ENDS)
def q79_learned_sentences(spark, d):
    """Sentences a document and words in its longest, by ends that the corpus teaches."""
    docs = C.documents(spark, d)
    found = docs.select("doc_id", sentences.sentences(sentences.learn(docs))(F.col("text")).alias("s"))
    longest = F.array_max(F.transform("s", lambda s: F.regexp_count(s, F.lit(r"[^\t-\r \x{00A0}]+"))))
    return found.select("doc_id", F.size("s").cast("bigint").alias("n_sents"), F.coalesce(longest, F.lit(0)).cast("bigint").alias("longest"))


def learned_tools(docs, text: str = "text") -> kernels.Tools:
    """Rule tokens, sentence ends learnt from ``docs``, and syllables by rule patterns."""
    model = sentences.learn(docs, text)
    whole = tokenizer.Tokenizer([*tokenizer.ABBREVIATIONS, *(f"{a}." for a in model.abbreviations)])
    return kernels.Tools(whole, model, hyphenation.Hyphenation(hyphenation.rule_patterns()))


@R.add()
def q80_family_a_learned(spark, d):
    """Family A over rule tokens, learnt sentences and pattern syllables."""
    docs = C.documents(spark, d).select("doc_id", "text")
    return metrics.metrics_a(docs, "text", learned_tools(docs)).drop("text")


_WIDE = "".join(chr(0xFEE0 + ord(c)) for c in "0123456789!?")


@R.add(f"SELECT doc_id, {C.sql_clean()} AS clean FROM documents")
def q81_clean_nfkc(spark, d):
    """Texts whose digits and marks are made wide first: compatibility normalisation undoes that before the other steps."""
    wide = F.translate(F.col("text"), "0123456789!?", _WIDE)
    return C.documents(spark, d).select("doc_id", cleaning.clean(wide, unicode=True).alias("clean"))
