"""The nearest-neighbour estimate of mutual information against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsift.operators import information, profile


def psi(n: int) -> float:
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute(values, classes, k):
    rows = [(v, c) for v, c in zip(values, classes) if classes.count(c) > 1]
    if not rows:
        return 0.0
    total = psi(len(rows))
    for i, (v, c) in enumerate(rows):
        own = sorted(abs(x - v) for j, (x, d) in enumerate(rows) if d == c and j != i)
        kk = min(k, len(own))
        r = own[kk - 1]
        m = sum(abs(x - v) < r if r > 0 else x == v for x, _ in rows)
        total += (psi(kk) - psi(len(own) + 1) - psi(m)) / len(rows)
    return max(total, 0.0)


def test_digamma(spark):
    got = {r["n"]: r["p"] for r in spark.range(1, 400).select(F.col("id").alias("n"), information.digamma(F.col("id")).alias("p")).collect()}
    assert all(abs(got[n] - psi(n)) < 1e-12 for n in got)


@pytest.mark.parametrize("k,block", [(3, 1 << 14), (3, 8), (1, 5), (7, 16)])
def test_estimate_against_brute_force(spark, k, block):
    rng = np.random.default_rng(k)
    classes = [str(c) for c in rng.integers(0, 3, 120)] + ["rare", "pair", "pair", None]
    shift = np.array([{"0": 0.0, "1": 1.3, "2": 0.4}.get(c, 5.0) for c in classes])
    columns = {"real": (rng.normal(size=124) + shift), "ties": rng.integers(0, 4, 124).astype(float) + (shift > 1), "tiny": rng.normal(size=124) * 1e-300, "huge": 1e15 + rng.normal(size=124),
               "noise": rng.random(124), "same": np.zeros(124)}
    rows = [(c, *(float(v[i]) for v in columns.values())) for i, c in enumerate(classes)]
    df = spark.createDataFrame(rows, "label string, " + ", ".join(f"{c} double" for c in columns)).repartition(3)
    got = {r["feature"]: r["mi"] for r in information.neighbour_information(df, list(columns), "label", k, block).collect()}
    kept = [i for i, c in enumerate(classes) if c is not None]
    for name, values in columns.items():
        want = brute([float(values[i]) for i in kept], [classes[i] for i in kept], k)
        assert math.isclose(got[name], want, abs_tol=1e-9), name


def test_gaps_take_the_median_and_empty_tables_score_nothing(spark):
    rows = [("a", 1.0, None), ("a", None, None), ("b", float("nan"), None), ("b", 4.0, None), ("a", float("inf"), None), ("b", 2.0, None), ("a", 2.5, None), (None, 9.0, None)]
    df = spark.createDataFrame(rows, "label string, x double, empty double")
    got = {r["feature"]: r["mi"] for r in profile.mutual_information(df, ["x", "empty"], "label", neighbours=2).collect()}
    middle = float(np.median([1.0, 4.0, 2.0, 2.5, 9.0]))
    values = [v if v is not None and math.isfinite(v) else middle for _, v, _ in rows[:-1]]
    assert math.isclose(got["x"], brute(values, [r[0] for r in rows[:-1]], 2), abs_tol=1e-9) and abs(got["empty"] - brute([0.0] * 7, [r[0] for r in rows[:-1]], 2)) < 1e-9
    assert {r["mi"] for r in information.neighbour_information(df.limit(0), ["x", "empty"], "label").collect()} == {0.0}
