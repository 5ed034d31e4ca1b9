"""Top-k search, SimHash and components against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from textloom.llm import components, cover_tree, queries, simhash


def brute_top(rows, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(i, set()).add(tuple(int(np.floor(256 * float(np.float32(x)))) for x in v))
    out = set()
    for q, vs in ok.items():
        for v in vs if q % 50 == 0 else ():
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, ws in ok.items() if i != q for w in ws if len(w) == len(v))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_top_k_with_odd_rows(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(150)]
    rows += [(i, [0.5] * 6) for i in range(150, 260)]  # a hot vector, with ties
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (350, []), (351, []), (400, [1.0, 2.0]), (None, [0.1] * 6)]
    rows += [rows[50], rows[100], rows[200]]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score string")
    got = cover_tree.op1_top5(df)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert {tuple(r) for r in got.collect()} == brute_top(rows)


def test_top_k_of_an_empty_table(spark):
    assert cover_tree.op1_top5(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


@pytest.mark.parametrize("size", [2.0**30, 2.0**52, 1e9 + 1 / 256])
def test_large_components_stay_exact(spark, size):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 4)]) for i in range(120)]
    rows += [(i, [size, float(i), -3.0, 1.0 / 256]) for i in range(200, 203)] + [(i, [float(i - 250), 2.0, size / 2, 0.0]) for i in range(250, 254)] + [(300, [-size, -size, -size, -size])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    ok = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = {}
    for q in (i for i in ok if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ok[q], ok[i], strict=True)), i) for i in ok if i != q)
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(scores[:5])}
    if all(-(2**63) < s < 2**63 for _, s in want.values()):
        assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in cover_tree.op1_top5(df).collect()} == want
    else:
        with pytest.raises(Exception, match="out of a long's range"):
            cover_tree.op1_top5(df).collect()


def test_least_scores_beyond_a_long_do_not_raise(spark):
    rows = [(0, [-(2.0**40), 1.0]), (1, [2.0**40, 0.0])] + [(i, [0.0, float(i)]) for i in range(2, 9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert [(r.vec_id, r.score) for r in cover_tree.op1_top5(df).orderBy("rank").collect()] == [(i, 65536 * i) for i in (8, 7, 6, 5, 4)]


def test_dual_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 100, (12, 16))
    points = np.floor(np.concatenate([c + rng.normal(0, 3, (300, 16)) for c in centres]))
    tree, queries_ = cover_tree.Tree(points), cover_tree.Tree(points[::50])
    for node, below in enumerate(tree.children):  # covering and separation
        own = tree.points[tree.start[node] : tree.end[node]]
        assert np.linalg.norm(own - tree.centre[node], axis=1).max() <= tree.radius[node] + 1e-6
        gaps = [np.linalg.norm(tree.centre[a] - tree.centre[b]) for a in below for b in below if a < b]
        assert not gaps or min(gaps) >= max(tree.radius[b] for b in below) - 1e-6
    visits = cover_tree.Visits()
    score, at = cover_tree.search(queries_, np.full(len(points[::50]), -(2.0**62)), tree, np.arange(len(points)), 6, visits)
    assert visits.leaves < 0.5 * visits.possible, visits
    full = (points[::50] @ points.T).astype(np.int64)
    for r in range(len(score)):
        q = queries_.order[r]
        want = np.lexsort((np.arange(len(points)), -full[q]))[:6]
        assert (at[r] == want).all() and (score[r] == full[q][want]).all()


def brute_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(docs):
    fps = [brute_fingerprint(t) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (d, _), x in zip(docs, label, strict=True):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return sorted(((d, f"{fp:016x}", least.get(x)) for (d, _), fp, x in zip(docs, fps, label, strict=True)), key=str)


def simhash_rows(spark, docs):
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id bigint, text string, fp int")
    out = simhash.near_duplicates(df).select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("f"), "component_id")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_simhash_of_odd_rows(spark):
    base = " ".join(f"word{i % 37} and{i}" for i in range(400))
    docs = [(5, base), (6, base.replace("and7 ", "or ")), (7, base.upper()), (3, base + " tail"), (9, None), (8, ""), (10, " \t\n"), (11, "Ünï two"), (12, "ünï two"), (13, "one"), (None, base), (5, base), (14, "\xa0x y z\x85w"), (15, "long " * 70000)]
    assert simhash_rows(spark, docs) == brute_components(docs)
    assert simhash_rows(spark, []) == []


def test_simhash_of_documents(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op10_simhash(spark, small).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == brute_components(docs)


def test_links_span_chains_and_dense_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 300)}
    for x in list(fps)[:40]:  # chains of single flipped bits, and a dense group
        for b in range(0, 12, 2):
            x ^= 3 << b
            fps.add(x)
    dense = list(fps)[0]
    fps |= {dense ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    monkeypatch.setattr(simhash, "GROUP", 2)
    found = components.connected_components(simhash.links(df, 2, tile_rows=8), "a", "b").collect()
    got = {r.node: r.root for r in found}
    forest = simhash.Forest(len(fps))
    u, v = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    forest.link(u, v)
    want = {}
    signed = fps.view(np.int64)
    for i, label in enumerate(forest.label):
        want.setdefault(label, set()).add(int(signed[i]))
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)
    assert all(root == min(g) for root, g in groups.items())


def test_components_ignore_nulls_and_self_links(spark):
    rows = [(1, 2), (2, 3), (9, 9), (None, 4), (7, 8), (8, 7), (3, 1)]
    df = spark.createDataFrame(rows, "x bigint, y bigint")
    assert {tuple(r) for r in components.connected_components(df, "x", "y").collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert components.connected_components(df.limit(0), "x", "y").count() == 0


def test_deduplicate_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(2, text, "a"), (1, text, "b"), (1, text, "b"), (None, "other thing entirely here", "c"), (None, "other thing entirely here", "c"), (4, None, "d"), (5, "", "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, content_0 string")
    assert sorted(map(str, simhash.deduplicate(df).collect())) == sorted(map(str, spark.createDataFrame([rows[1], rows[3], rows[5]], df.schema).collect()))
