"""The value table of the drift operators: ranges against brute force, and what tasks hand on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsift.operators import drift as I


@pytest.fixture(scope="module")
def frames(spark):
    r = np.random.default_rng(5)
    sides = []
    for n, shift in ((3_000, 0.0), (2_000, 0.3)):
        rows = [(float(a), float(b), None if c == 3 else float(c), 7.0) for a, b, c in zip(r.normal(shift, 2, n).round(3), np.exp(r.normal(shift, 3, n)), r.integers(0, 5, n))]
        sides.append(spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3))
    return sides


def test_ranges_give_the_figures_of_sorted_columns(frames, monkeypatch):
    monkeypatch.setattr(I, "RANGE_ROWS", 40)
    features = ["a", "b", "c", "d"]
    v = I.value_table(*frames, features)
    base, live = (f.toPandas() for f in frames)
    for c in features:
        b, l = np.sort(base[c].dropna()), np.sort(live[c].dropna())
        both = np.sort(np.concatenate([b, l]))
        ks = np.abs(np.searchsorted(b, both, side="right") / len(b) - np.searchsorted(l, both, side="right") / len(l)).max()
        s = v.stats[c]
        assert (s["n_base"], s["n_live"], s["unique"]) == (len(b), len(l), len(np.unique(both)))
        assert s["ks"] == pytest.approx(ks, abs=1e-12) and s["std_base"] == pytest.approx(b.std(), rel=1e-9, abs=1e-12)
        for (feature, of, rank), x in v.at_rank.items():
            if feature == c:
                assert x == (both if of == "pooled" else b)[rank]
        wanted = {(c, "pooled", r) for r in I._rank_pairs(len(both), I._bin_probs(s["unique"]))} | {(c, "base", r) for r in I._rank_pairs(len(b), [i / 10 for i in range(11)])}
        assert wanted <= set(v.at_rank)
    edges = I.bin_edges(v)
    got = {(r["feature"], r["bin"]): (r["p"], r["q"]) for r in I.histogram_distributions(v, edges).collect()}
    for c in features:
        for side, f in enumerate((base, live)):
            share = np.histogram(f[c].dropna(), edges[c])[0] / f[c].count()
            assert [got[(c, i)][side] for i in range(len(share))] == pytest.approx(list(share))


def test_a_task_hands_on_counts_of_many_batches(spark):
    rows = spark.range(0, 45_000, 1, 1).select((F.col("id") % 2).cast("double").alias("x"))  # five Arrow batches
    assert I._batch_counts(rows, ["x"]).count() == 2


def test_rows_between_tasks_are_narrow(frames, monkeypatch):
    seen = []
    write = I.materialize
    monkeypatch.setattr(I, "materialize", lambda df, name, *a: seen.append((name, df.columns)) or write(df, name, *a))
    I.value_table(*frames, ["a", "b"])
    assert seen == [("drift-values", ["feature", "x", "n_base", "n_live"]), ("drift-ranges", ["feature", "x", "n_base", "n_live", "part"])]


def test_one_empty_side_and_no_values(spark, frames):
    base, live = frames
    v = I.value_table(base, live.where("a > 1e9"), ["a"])
    assert v.stats["a"]["n_live"] == 0 and v.stats["a"]["ks"] == 0.0 and v.stats["a"]["std_base"] > 0
    none = I.value_table(base.where("a > 1e9"), live.where("a > 1e9"), ["a"])
    assert none.stats["a"] == I.EMPTY and I.ks_statistics(none).first()["ks_pvalue"] == 1.0
