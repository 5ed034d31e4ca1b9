"""The prefix trie against a walk over all prefixes, and its helpers for large groups."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm import queries, runs, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, x string"


def plain_turns(rows):
    """Each conversation's (role, text) in order."""
    found = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            found[conv].append((turn is not None, turn or 0, digest, role, text))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in found.items()}


def walked(rows):
    own = plain_turns(rows)
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = set()
    for node, cs in members.items():
        below = {m: v for m, v in members.items() if m[: len(node)] == node}
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(p) == len(m) + 1 and p[: len(m)] == m for p in below)]
        saved = sum((len(v) - 1) * len(m[-1][1].encode()) for m, v in below.items() if m)
        ends = ",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(cs), len(node), parent, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed, n=60):
    rng = random.Random(seed)
    texts = ("hi", "hi", "é", "", None, "a longer answer. " * 3)
    rows = []
    for c in range(n):
        for turn in range(rng.choice((0, 1, 2, 5, 9, 14))):
            rows.append((c, rng.choice((turn, turn, turn, None, 1)), rng.choice(("user", "assistant", None)), texts[turn % 6] if rng.random() < 0.8 else rng.choice(texts), 1, "x"))
    rows += [(-7, 1, "user", "negative", 1, "x"), (-5, 1, "user", "base", 1, "x"), (None, 1, "user", "nobody", 1, "x")]
    rows += [(200 + c, t, "user", f"same {t}", 1, "x") for c in range(0, 100, 5) for t in range(12)]
    return rows + rows[:5]


@pytest.mark.parametrize(("seed", "piece", "least"), [(1, 4096, 1000), (2, 4, 3), (3, 2, 0)])
def test_equals_walk(spark, monkeypatch, seed, piece, least):
    monkeypatch.setattr(trie, "PIECE", piece)
    monkeypatch.setattr(trie, "HOT_LEAST", least)
    rows = conversations(seed)
    got = [tuple(r) for r in trie.op12_trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == walked(rows)


def test_long_conversation_and_empty_table(spark):
    rows = [(5, t, "user", f"turn {t} " + "x" * (10**6 if t == 3 else 1), 1, "x") for t in range(60)] + [(6, t, "user", f"turn {t}", 1, "x") for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in trie.op12_trie(df).collect()} == walked(rows)
    assert trie.op12_trie(df.limit(0)).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    # 1's donor is absent, and it has no turns after its first ones.
    assert zlib.crc32(b"1") % 9 >= 2
    got = trie.op12_trie(spark.createDataFrame([(1, 1, "user", "gone", 1, "x")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_places_in_groups_over_many_ranges(spark, ranges):
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        rng = random.Random(ranges)
        rows = [(rng.choice((1, 1, 1, 1, 2, None)), i, rng.randrange(4)) for i in range(400)]
        df = runs.placed(spark.createDataFrame(rows, "k bigint, o bigint, w bigint"), "k", [F.col("o")], "t", F.col("w"))
        seen, want = defaultdict(int), set()
        for k, o, w in rows:
            want.add((k, o, w, seen[k]))
            seen[k] += w
        assert {tuple(r) for r in df.select("k", "o", "w", "before").collect()} == want
        items = spark.createDataFrame([(k, o, f"é{w}") for k, o, w in rows] * 2, "k bigint, o bigint, v string")
        sums = defaultdict(list)
        for k, _, w in rows:
            sums[k].append(f"é{w}")
        got = {r.k: r.sha256 for r in runs.joined_sha256(items, ["k"], "o", "v", "\n").collect()}
        assert got == {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in sums.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_query_equals_walk(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.op12_prefix_trie(spark, small).collect()} == walked(rows)
