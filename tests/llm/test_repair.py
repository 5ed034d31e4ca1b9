"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from textloom.llm import queries, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost int, pos string"


def after_damage(rows):
    """Each conversation's (turn, role, text) after damage, in order."""
    found = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        found[conv] += []
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        if kind:
            found[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest())
    return {c: sorted(v, key=order) for c, v in found.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """(cost, audit, repaired) by a best-first search over edits; the roles' grammar is checked on whole results only."""
    legal = re.compile(r"(s?(ua)+)?")
    prefix = re.compile(r"s?(ua)*u?")
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, turns = heapq.heappop(heap)
        roles = "".join(r[:1] or "?" for r, _ in turns)
        if not prefix.fullmatch(roles):
            continue
        if at == len(rows) and legal.fullmatch(roles):
            return cost, audit, turns
        # Of paths to equal rows and role endings, the first by (cost, audit) is enough.
        state = (at, roles[-1:], len(turns) == 0)
        if state in done:
            continue
        done.add(state)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", at, (*turns, (role, ""))))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, turns))
            if kinds[at] in ("", "truncated"):
                extra = 3 * (kinds[at] == "truncated")
                heapq.heappush(heap, (cost + extra, audit + "K", at + 1, (*turns, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + extra, audit + "R", at + 1, (*turns, (new, text))))
    raise AssertionError


def expected(rows):
    out = set()
    for conv, kept in after_damage(rows).items():
        kinds = faults(kept)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, result = cheapest(kept, kinds)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in result).encode()).hexdigest()
        out.add((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return out


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ("Yes.", "No", "a longer answer!", "é?", " \t", "", None, "what.  ")
    roles = ("user", "assistant", "user", "assistant", "system", "u", "tool", "", None, "User")
    rows = []
    for c in range(n):
        first = rng.randrange(3)
        for turn in range(first, first + rng.randrange(12)):
            role = rng.choice(roles) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {turn}."
            rows.append((c, turn * rng.choice((1, 1, 1, 2)) if rng.random() < 0.95 else None, role, text, 1, "x"))
    return rows


@pytest.mark.parametrize(("seed", "piece", "batch"), [(1, 64, 2000), (2, 3, 5), (3, 2, 2)])
def test_equals_search(spark, monkeypatch, seed, piece, batch):
    monkeypatch.setattr(repair, "PIECE", piece)
    monkeypatch.setattr(repair, "BATCH", batch)
    rows = conversations(seed, 60)
    rows += [*rows[:4], *rows[:1] * 6, (None, 1, "user", "nobody.", 1, "x"), (None, None, None, None, 1, "x")]
    got = [tuple(r) for r in repair.op11_repairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(rows)


def test_long_conversation_long_text_and_empty_table(spark):
    rng = random.Random(5)
    rows = [(9, t, rng.choice(("user", "assistant", "system")), f"text {t}" + rng.choice((".", "")), 1, "x") for t in range(700)]
    rows += [(8, t, "user", "long " * 200_000 + f"{t}.", 1, "x") for t in range(3)] + [(7, 1, "user", "same.", 1, "x")] * 300
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in repair.op11_repairs(df).collect()} == expected(rows)
    assert repair.op11_repairs(df.limit(0)).count() == 0


def test_repaired_turns_are_kept_whole(spark):
    rows = [(1, t, r, f"text {t}.", 1, "x") for t, r in enumerate(("system", "user", "user", "assistant"))]
    report, turns = repair.repair(spark.createDataFrame(rows, SCHEMA))
    want = {x[0]: x for x in expected(rows)}[1]
    assert report.first().audit == want[7]
    body = "\n".join(f"{r.role}:{r.text}" for r in turns.orderBy("place").collect())
    assert hashlib.sha256(body.encode()).hexdigest() == want[8]


def test_rows_that_are_all_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    got = repair.op11_repairs(spark.createDataFrame([(3, turn, "user", "gone.", 1, "x")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_extreme_turns(spark):
    rows = [(1, -(2**63), "user", "a.", 1, "x"), (1, 2**63 - 1, "assistant", "b.", 1, "x")]
    assert repair.op11_repairs(spark.createDataFrame(rows, SCHEMA)).first().gaps is None


def test_query_equals_search(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.op11_repair(spark, small).collect()} == expected(rows)
