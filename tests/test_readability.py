"""Rule tokens, syllables, familiar words and learnt sentence ends against hand-made cases and plain Python."""

import math
import random
import re
import statistics
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import generation, hyphenation, kernels, metrics, tokenizer
from textloom.operators import sentences
from textloom.plans import queries
from textloom.plans.queries import readability

CASES = {
    "I can't (really) don’t go.": "I|ca|n't|(|really|)|do|n’t|go|.",
    "We've run 10km, 5% of $10.": "We|'ve|run|10|km|,|5|%|of|$|10|.",
    "see https://x.org/a_b?c=1. mail a.b@c.de!": "see|https://x.org/a_b?c=1|.|mail|a.b@c.de|!",
    "well-known and/or e.g. U.S. Dr. Smith's \"quoted\" text...": "well|-|known|and|/|or|e.g.|U.S.|Dr.|Smith|'s|\"|quoted|\"|text|...",
    "end.Next (a(b)c) 3.14 1,000 x=y NASA.": "end|.|Next|(|a|(|b|)|c|)|3.14|1,000|x|=|y|NASA|.",
    "[12]; «oui» – non… a--b 25°C 3m² ''": "[|12|]|;|«|oui|»|–|non|…|a|--|b|25|°C|3|m²|'|'",
    "": "", " \n\t ": "", "...": "...", ".": ".", "(": "(", "won't cannot let's": "wo|n't|can|not|let|'s", "naïve—été": "naïve|—|été",
}


@pytest.mark.parametrize("text", CASES)
def test_rule_tokens(text):
    assert "|".join(tokenizer.Tokenizer()(text)) == CASES[text]


def test_tokens_lose_no_character():
    rng = random.Random(3)
    t = tokenizer.Tokenizer()
    for _ in range(3000):
        text = "".join(rng.choice("ab.Z3'’-/:(),\"$% \né…–!?n't km@wwww.http://") for _ in range(rng.randrange(30)))
        assert "".join(t(text)) == "".join(text.split()), text


def test_own_abbreviations_stay_whole():
    assert tokenizer.Tokenizer(["Abb."])("abb. Dr. x") == ["abb.", "Dr", ".", "x"]


def test_hyphenation_patterns():
    h = hyphenation.Hyphenation(["hy3ph he2n hena4 hen5at 1na n2at 1tio 2io o2n", "% a comment", "ta-ble as-so-ciate"])
    assert h.points("Hyphenation") == [2, 6] and h("hyphenation") == 3  # hy-phen-ation
    assert h.points("table") == [2] and h("associate") == 3 and h("x") == 1 and h("") == 1
    rule = hyphenation.Hyphenation(hyphenation.rule_patterns())
    assert {w: rule(w) for w in "table make strap banana reading the nation bottle pearl".split()} == {"table": 2, "make": 1, "strap": 1, "banana": 3, "reading": 2, "the": 1, "nation": 2, "bottle": 2, "pearl": 1}


def brute_points(word, patterns, left=2, right=2):
    best = [0] * (len(word) + 3)
    whole = f".{word}."
    for pattern in patterns:
        letters = re.sub(r"\d", "", pattern)
        for m in re.finditer(f"(?={re.escape(letters)})", whole):
            at = m.start()
            for c in pattern:
                if c.isdigit():
                    best[at] = max(best[at], int(c))
                else:
                    at += 1
    return [i for i in range(left, len(word) - right + 1) if best[i + 1] % 2]


def test_trie_equals_search_of_each_pattern():
    rng = random.Random(1)
    patterns = ["".join(rng.choice(("", "", "1", "2", "3")) + c for c in "".join(rng.choice("ab.e") for _ in range(rng.randrange(1, 4)))) + rng.choice(("", "1", "4")) for _ in range(40)]
    patterns = [p for p in patterns if "-" not in p]
    by_letters = {re.sub(r"\d", "", p): p for p in patterns}  # one pattern for the same letters
    h = hyphenation.Hyphenation(by_letters.values())
    for _ in range(500):
        word = "".join(rng.choice("abec") for _ in range(rng.randrange(12)))
        assert h.points(word) == brute_points(word, by_letters.values()), word


def test_familiar_words_are_known_inflected():
    known = hyphenation.Familiar(["run", "Try", "make", "big", "quick", "glass"])
    assert all(map(known, "run runs running try tries tried trying make makes making made big bigger biggest quickly Quick glasses".replace("made ", "").split()))
    assert not any(map(known, ("runt", "made", "s", "ing", "gla", "")))


def test_lists_are_checked(spark, tmp_path, monkeypatch):
    (tmp_path / "words.txt").write_text("b\na\nb\n")
    assert hyphenation.read_lines(spark, str(tmp_path / "words.txt")) == ["a", "b"]
    monkeypatch.setattr(hyphenation, "ENTRIES", 1)
    with pytest.raises(ValueError, match="entries"):
        hyphenation.read_lines(spark, str(tmp_path / "words.txt"))


def plain_learn(texts):
    """Abbreviations and starters by plain counting."""
    tokens = [[(c, (b := c.rstrip(",;:")).rstrip(".!?").lower(), b.endswith(".")) for t in re.findall("[^\t-\r  ]+", text or "") for c in [t.lstrip(sentences.OPENERS).rstrip(sentences.CLOSERS)]] for text in texts]
    dotted, plain = Counter(), Counter()
    for row in tokens:
        for _, kind, stop in row:
            if kind:
                (dotted if stop else plain)[kind] += 1
    n, p = sum(dotted.values()) + sum(plain.values()), 0
    abbreviations = set()
    for kind in dotted:
        p = sum(dotted.values()) / n
        ll = -2 * (dotted[kind] * math.log(p) + plain[kind] * math.log(1 - p) - dotted[kind] * math.log(0.99) - plain[kind] * math.log(0.01))
        letters = len(kind.replace(".", ""))
        if any(map(str.isalpha, kind)) and ll * math.exp(-letters) * (kind.count(".") + 1) * letters ** -plain[kind] >= 0.3:
            abbreviations.add(kind)
    initial = lambda kind: len(kind) == 1 and kind.isalpha()
    after = Counter()
    for row in tokens:
        for (core, kind, _), (_, following, _) in zip(row, row[1:], strict=False):
            if following and (core[-1:] in "!?" and core or core[-1:] == "." and core[-2:] != ".." and kind not in abbreviations and not initial(kind) and not kind.isdecimal()):
                after[following] += 1
    b, starters = sum(after.values()), set()
    xlog = lambda k, share: k * math.log(share) if k else 0.0
    for kind, k in after.items():
        o = dotted[kind] + plain[kind]
        p0, p1, p2 = o / n, k / b, (o - k) / (n - b)
        if p1 > p0 and kind[0].isalpha():
            same = xlog(k, p0) + xlog(b - k, 1 - p0) + xlog(o - k, p0) + xlog(n - b - o + k, 1 - p0)
            apart = xlog(k, p1) + xlog(b - k, 1 - p1) + xlog(o - k, p2) + xlog(n - b - o + k, 1 - p2)
            if -2 * (same - apart) >= 30:
                starters.add(kind)
    return abbreviations, starters


def corpus():
    rng = random.Random(5)
    words = "patient trial dose results treatment showed effect group placebo weeks".split()
    out = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            body = [rng.choice(words) for _ in range(rng.randrange(3, 8))]
            body[rng.randrange(len(body))] = rng.choice(("Dr. Smith", "approx. 3.5 mg", "e.g. aspirin", "Fig. 2", "no. 7", "J. Doe", "(vs. placebo)"))
            parts.append(f"{rng.choice(('The', 'We', 'However,'))} {' '.join(body)}{rng.choice('..!?')}")
        out.append(" ".join(parts))
    return [*out, None, "", "... ", "One. Two", "He said \"yes.\" Then left."]


def test_learnt_ends(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(5)
    model = sentences.learn(df)
    assert (set(model.abbreviations), set(model.starters)) == plain_learn(texts)
    assert {"dr", "approx", "e.g", "fig", "vs"} <= model.abbreviations and {"the", "we", "however"} <= model.starters
    cases = {
        "We saw Dr. Smith. He left.": ["We saw Dr. Smith.", "He left."],
        "It cost 3.5 dollars, e.g. Two more": ["It cost 3.5 dollars, e.g. Two more"],
        "Give approx. The dose": ["Give approx.", "The dose"],
        "See J. Doe. We did!  Why? Yes": ["See J. Doe.", "We did!", "Why?", "Yes"],
        "item 7. of the list. Done": ["item 7. of the list.", "Done"],
        'He said "stop." Then left... slowly ... Fast.': ['He said "stop."', "Then left... slowly ...", "Fast."],
        "": [], " \n": [],
    }
    assert {t: model(t) for t in cases} == cases
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", sentences.sentences(model)(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == cases
    assert sentences.learn(df.limit(0)) == sentences.Model(frozenset(), frozenset())


def test_limit_of_learnt_words(spark, monkeypatch):
    monkeypatch.setattr(sentences, "LIMIT", 1)
    with pytest.raises(ValueError, match="more than 1"):
        sentences.learn(spark.createDataFrame([(t,) for t in corpus()], "text string"))


def test_counts_are_flushed(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for t in corpus()], "text string")
    want = {tuple(r) for r in sentences.word_counts(df, "text").collect()}
    monkeypatch.setattr(sentences, "HELD", 2)
    assert {tuple(r) for r in sentences.word_counts(df, "text").collect()} == want


def test_family_a_with_tools_equals_plain_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    tools = readability.learned_tools(docs)
    got = {r.doc_id: r for r in queries.queries()["q80_family_a_learned"](spark, small).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) == 200
    for doc, text in rows:
        r, text = got[doc], text or ""
        tokens = tools.tokens(text)
        words = [t for t in tokens if t.isalpha()]
        assert (r.n_tokens, r.n_words) == (len(tokens), len(words))
        if not words:
            assert r.n_sents == 0 and r.dale_chall == 0
            continue
        sents = tools.sentences(text)
        per = [sum(map(str.isalpha, tools.tokens(s))) for s in sents]
        syllables = [tools.syllables(w.lower()) for w in words]
        n, s = len(words), max(1, len(sents))
        hard = 100 * sum(x >= 3 for x in syllables) / n
        assert r.n_sents == s and r.avg_sent_len_words == pytest.approx(sum(per) / s) and r.std_sent_len_words == pytest.approx(statistics.pstdev(per), abs=1e-6)
        assert r.flesch_reading_ease == pytest.approx(206.835 - 1.015 * n / s - 84.6 * sum(syllables) / n)
        assert r.dale_chall == pytest.approx(0.1579 * hard + 0.0496 * n / s + (3.6365 if hard > 5 else 0))
        assert r.prop_punct_tokens == pytest.approx(sum(all(unicodedata.category(c)[0] == "P" for c in t) for t in tokens) / len(tokens))


def test_familiar_words_make_dale_chall(spark):
    text = "The cats were running quickly past xylophones. They tried it again."
    tools = kernels.Tools(familiar=hyphenation.Familiar("the cat were run quick past they try it again".split()))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    row = metrics.metrics_a(df, "text", tools).orderBy("id").collect()[0]
    assert row.dale_chall == pytest.approx(0.1579 * 100 / 11 + 0.0496 * 5.5 + 3.6365)  # one of eleven words in two sentences
    held = df.withColumn("s", metrics.word_statistics_a(F.col("text"), tools))
    got = held.select(generation.readability_or_default(F.col("text"), F.col("s"), with_tools=True)["dale_chall_readability_score"].alias("d")).collect()
    assert [r.d for r in got] == [pytest.approx(0.1579 * 100 / 11 + 0.0496 * 5.5 + 3.6365), 9.0, 9.0]
