"""Connected components of few links and of many give the same roots; few links cost few jobs."""

import numpy as np
import pytest

from textloom.llm import components


def brute(pairs):
    root = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(root[a], root[b])
            changed |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    return set(root.items())


@pytest.mark.parametrize("small", [0, components.SMALL])
def test_roots_by_either_way(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2)) if a != b] + [(200 + k, 201 + k) for k in range(12)] + [(300, 300 + k) for k in range(1, 9)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert {tuple(r) for r in components.connected_components(df, "a", "b").collect()} == brute(pairs)


def test_few_links_cost_few_jobs(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(40)], "a bigint, b bigint")
    sc = spark.sparkContext
    sc.setJobGroup("few-links", "few links")
    try:
        components.connected_components(df, "a", "b")
        jobs = len(sc.statusTracker().getJobIdsForGroup("few-links"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 40, jobs
    links = components._stars_of_few(spark.createDataFrame([(2, 1), (3, 2)], "u bigint, v bigint"))
    assert "Exchange" not in links._jdf.queryExecution().executedPlan().toString()
