"""The neighbour search by a tree of cells against brute force: ties, copies, gaps, and what it compares."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsift.operators import neighbours as N
from netsift.session import scratch_root

DDL = "id string, scope string, cls string, vec array<double>, q boolean, s boolean"


def brute(rows, k):
    kept = [r for r in rows if r[1] is not None and r[3] and all(v is not None and np.isfinite(v) for v in r[3])]
    want = {}
    for i, scope, _, vec, q, _ in kept:
        if q:
            near = sorted((float(np.sqrt(((np.array(vec) - np.array(r[3])) ** 2).sum())), r[0], r[2]) for r in kept if r[5] and r[1] == scope and r[0] != i)
            want[i] = near[:k]
    return {i: n for i, n in want.items() if n}


def found(df, k, **search):
    got = {}
    for r in N.nearest(df, k, **search).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["distance"], r["neighbour"], r["neighbour_cls"]))
    return got


@pytest.mark.parametrize("search", [{"pivots": 3, "leaf_rows": 5, "block_rows": 4}, {"leaf_rows": 9, "levels": 1, "pivots": 2, "block_rows": 6}, {}])
def test_ties_copies_and_one_sided_rows(spark, search):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(260):
        vec = [3.0, 3.0] if i % 3 == 0 else [float(v) for v in rng.integers(0, 6, 2)]  # a third are copies, many ties
        rows.append((f"{i:04d}", "u/0" if i % 7 == 0 else "u", "ab"[i % 2], vec, i % 5 != 0, i % 4 != 0))
    rows += [("n1", None, "a", [1.0, 1.0], True, True), ("n2", "u", "a", None, True, True), ("n3", "u", "a", [float("nan"), 0.0], True, True), ("n4", "u", "a", [None, 0.0], True, True),
             ("n5", "alone", "a", [1.0, 1.0], True, True), ("n6", "u", None, [90.0, -90.0], None, True), ("n7", "u", "a", [-80.0, 9.0], True, None), ("n8", "u", "a", [], True, True)]
    df = spark.createDataFrame(rows, DDL).repartition(3)
    got, want = found(df, 4, **search), brute([(*r[:4], bool(r[4]), bool(r[5])) for r in rows], 4)
    assert set(got) == set(want)
    for i in want:
        assert [g[1:] for g in got[i]] == [w[1:] for w in want[i]] and np.allclose([g[0] for g in got[i]], [w[0] for w in want[i]]), i
    assert found(df.limit(0), 4) == {}


def test_work_is_far_below_all_pairs(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 5)) * 8
    x = centres[rng.integers(0, 60, 6_000)] + rng.normal(size=(6_000, 5)) * 0.3
    df = spark.createDataFrame([(f"{i:05d}", "all", "c", [float(a) for a in v], True, True) for i, v in enumerate(x)], DDL)
    r = N.search_cost(df, 5, leaf_rows=64).first()
    assert r["queries"] == r["candidates"] == 6_000 and r["compared"] < 0.1 * 6_000 ** 2
    got = N.nearest(df.withColumn("q", F.col("id") < "00050"), 5, leaf_rows=64).collect()
    for i in range(50):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert [r["neighbour"] for r in sorted((g for g in got if g["id"] == f"{i:05d}"), key=lambda g: g["rank"])] == [f"{j:05d}" for j in np.argsort(d, kind="stable")[:5]]


def test_vectors_without_near_cells_are_written_a_few_times_only(spark):
    # random vectors in many dimensions: nearly all pairs are compared, which must not write a vector for every cell
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3_000, 32))
    df = spark.createDataFrame([(f"{i:05d}", "all", "c", [float(a) for a in v], True, True) for i, v in enumerate(x)], DDL)
    root = Path(scratch_root(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in root.rglob("*") if p.is_file())
    before = size()
    got = N.nearest(df, 3, leaf_rows=32).where("id < '00020'").collect()
    assert size() - before < 12 * x.nbytes
    for i in range(20):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        near = sorted((g for g in got if g["id"] == f"{i:05d}"), key=lambda g: g["rank"])
        assert [g["neighbour"] for g in near] == [f"{j:05d}" for j in np.argsort(d, kind="stable")[:3]]


def test_groups_that_are_compared_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(1_500, 20)), 1)
    monkeypatch.setattr(N, "GROUP_ROWS", 100)
    monkeypatch.setattr(N, "AT_ONCE", 2)
    df = spark.createDataFrame([(f"{i:05d}", "all", "c", [float(a) for a in v], i % 10 == 0, i % 3 != 0) for i, v in enumerate(x)], DDL)
    got = found(df, 4, leaf_rows=40, block_rows=50)
    want = brute([(f"{i:05d}", "all", "c", list(v), i % 10 == 0, i % 3 != 0) for i, v in enumerate(x)], 4)
    assert {i: [g[1:] for g in n] for i, n in got.items()} == {i: [w[1:] for w in n] for i, n in want.items()}


def test_a_block_goes_only_to_groups_that_reach_it(spark, monkeypatch):
    # points on a plane: a group's bounds reach the edge of the groups around it, not all of their blocks
    rng = np.random.default_rng(6)
    x = rng.uniform(size=(6_000, 2))
    monkeypatch.setattr(N, "GROUP_ROWS", 600)
    df = spark.createDataFrame([(f"{i:05d}", "all", "c", [float(a) for a in v], i % 20 != 0, True) for i, v in enumerate(x)], DDL)
    _, blocks, routes = N._search(df, 3, 16, 32, 2_000, 24)
    sizes = {(r["grp"], r["bid"]): r["n"] for r in blocks.select("grp", "bid", "n").collect()}
    sent = sum(sizes[(r["other"], b)] for r in routes.collect() for b in r["wanted"])
    assert 6_000 <= sent < 3.5 * 6_000  # blocks of groups nearby, not whole groups
    got = {(r["id"], r["rank"]): r["neighbour"] for r in N.nearest(df.withColumn("q", F.col("id") < "00200"), 3, leaf_rows=32).collect()}
    for i in range(200):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert [got[(f"{i:05d}", n)] for n in (1, 2, 3)] == [f"{j:05d}" for j in np.argsort(d, kind="stable")[:3]]
