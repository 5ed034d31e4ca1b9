"""Runs of four fifths equal tokens, by their definition."""

import time

import numpy as np
import pyarrow as pa

from test_scans import brute_overlap

from textloom.llm import bytewords, decontaminate


def brute_run(equal, whole):
    n = len(equal)
    ok = [b - a for a in range(n) for b in range(a + 1, n + 1) if 5 * sum(equal[a:b]) >= 4 * (b - a) and (equal[a] and equal[b - 1] or whole and b - a == n)]
    return max(ok, default=0)


def test_longest_run_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(600):
        equal = rng.random(rng.integers(1, 45)) < rng.choice([0.3, 0.7, 0.8, 0.9])
        for whole in (False, True):
            start, end = decontaminate.longest_run(equal, whole)
            assert end - start == brute_run(equal.tolist(), whole)
            assert 5 * equal[start:end].sum() >= 4 * (end - start)


def found(item, doc):
    index = decontaminate.Index([" ".join(item)], decontaminate.MIN_TOKENS)
    return list(index.overlaps(*bytewords.word_hashes(pa.array([" ".join(doc)]))))


def test_items_with_a_fifth_substituted_are_found():
    item = [f"w{i}" for i in range(60)]
    swapped = [w if i % 5 != 2 else f"x{i}" for i, w in enumerate(item)]
    (hit,) = found(item, ["a"] * 9 + swapped + ["b"] * 9)
    assert hit == (0, 0, 9, 69, 0, 48)


def test_recall_with_a_fifth_of_the_tokens_substituted():
    """Whole items with random substitutions, which at least four fifths equal tokens make overlaps."""
    rng = np.random.default_rng(2)
    for length, swaps in ((8, 1), (10, 2), (13, 1), (13, 2), (15, 3), (16, 2), (20, 4), (25, 5), (40, 8), (60, 12)):
        own = [f"w{i}" for i in range(length)]
        texts = []
        for _ in range(200):
            other = list(own)
            for at in rng.choice(length, swaps, replace=False):
                other[at] = "x"
            texts.append(" ".join(["a"] * 9 + other + ["b"] * 9))
        index = decontaminate.Index([" ".join(own)], decontaminate.MIN_TOKENS)
        hits = {h[0] for h in index.overlaps(*bytewords.word_hashes(pa.array(texts)))}
        assert len(hits) / 200 >= 0.99, (length, swaps, len(hits))


def test_runs_equal_brute_force_on_repeats():
    rng = np.random.default_rng(8)
    for _ in range(40):
        item, doc = ([str(x) for x in rng.integers(0, 3, rng.integers(1, 22))] for _ in range(2))
        doc = doc + item[: int(rng.integers(0, 20))] + doc[:5]
        got = sorted((s, e, i, n) for _, _, s, e, i, n in found(item, doc))
        assert got == brute_overlap(" ".join(doc), " ".join(item), decontaminate.MIN_TOKENS)


def test_texts_that_repeat_a_token_are_compared_in_short_time():
    for n, limit in ((2000, 0.5), (20_000, 30)):
        began = time.perf_counter()
        assert found(["a"] * n, ["a"] * n) == [(0, 0, 0, n, 0, n)]
        assert time.perf_counter() - began < limit
    began = time.perf_counter()
    assert not found(["a"] * 2000, (["a"] * 6 + ["b"] * 6) * 150)
    assert time.perf_counter() - began < 5


def test_a_phrase_that_all_share_is_passed_over_soon():
    """Items and rows that have seven words in common and nothing else: no overlap, in time that doesn't follow the pairs."""
    phrase = [f"p{i}" for i in range(7)]
    items = [" ".join([f"i{k}x{j}" for j in range(8)] + phrase + [f"i{k}y{j}" for j in range(8)]) for k in range(4000)]
    docs = [" ".join([f"d{k}x{j}" for j in range(60)] + phrase + [f"d{k}y{j}" for j in range(60)]) for k in range(400)]
    docs[7] += " " + items[11]
    index = decontaminate.Index(items, decontaminate.MIN_TOKENS)
    hashes, bounds = bytewords.word_hashes(pa.array(docs))
    began = time.process_time()
    hits = list(index.overlaps(hashes, bounds))
    assert time.process_time() - began < 10
    assert [(h[0], h[1], h[5]) for h in hits] == [(7, 11, 23)]


def test_portions_give_the_same_runs(monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(6)]
    items = [" ".join(rng.choice(words, rng.integers(1, 25))) for _ in range(30)]
    docs = [" ".join([*rng.choice(words, rng.integers(0, 30)), *items[rng.integers(30)].split(), *rng.choice(words, rng.integers(0, 30))]) for _ in range(12)]
    hashes, bounds = bytewords.word_hashes(pa.array(docs))
    index = decontaminate.Index(items, decontaminate.MIN_TOKENS)
    whole = sorted(index.overlaps(hashes, bounds))
    for doc, row in list(enumerate(docs))[:3]:
        for k, item in list(enumerate(items))[:6]:
            assert sorted(h[2:] for h in whole if h[:2] == (doc, k)) == brute_overlap(row, item, decontaminate.MIN_TOKENS)
    for piece, hits in ((7, 11), (1, 1), (100, 1 << 20), (1 << 20, 50)):
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        monkeypatch.setattr(decontaminate, "HITS", hits)
        assert sorted(index.overlaps(hashes, bounds)) == whole


def test_short_items_needn_t_decide(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "one two three four five six seven eight nine"), (3, "clean")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "the"), (2, "two three four five six seven eight nine")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()} == {(1, 1), (2, 2)}
    assert [r.doc_id for r in decontaminate.clean_documents(docs, bench, decisive=8).collect()] == [1, 3]
