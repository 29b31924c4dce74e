"""Mutual information of numeric columns with a class, by nearest neighbours (Ross 2014).

For a row of class c with value x, r is the distance to its k-th nearest neighbour of the same class and m the number of
rows of any class nearer than r (of equal ones if r is 0), itself included. The estimate is
psi(N) + mean psi(k) - mean psi(N_c) - mean psi(m), at least 0.

Everything is done on distinct (column, value, class) cells with counts, sorted over the whole cluster: neighbours
of a cell are near it in that order, so blocks of it with k cells more on either side find every r, and m is a
difference of two running totals in the merged order of cells and interval ends. No key is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.functions.scaling import doubles, lookup, ordered_rank, ordered_total, ordinals, quantiles
from netsift.session import materialize

BLOCK = 16_384  # cells that a task compares at once
_EULER = 0.5772156649015329
_SMALL = 16


def digamma(n: Column) -> Column:
    """psi(n) of a whole number from 1: partial sums of 1/i below 16, the asymptotic series above."""
    small = [-_EULER + sum(1 / i for i in range(1, m)) for m in range(1, _SMALL)]
    x = n.cast("double")
    y = 1 / (x * x)
    series = F.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))
    return F.when(n < _SMALL, F.element_at(F.array(*[F.lit(v) for v in small]), F.least(n, F.lit(_SMALL - 1)).cast("int"))).otherwise(series)


def value_cells(df: DataFrame, columns: list[str], label: str, fill: dict[str, float]) -> DataFrame:
    """(feature int, class, value, n): distinct values by class, gaps and non-finite values filled. Tasks count whole
    Arrow batches and hand on their counts."""
    fills = [float(fill[c]) for c in columns]

    def count(frames):
        for pdf in frames:
            codes, names = pd.factorize(pdf["_class"])
            for i, c in enumerate(columns):
                v = pdf[c].to_numpy(dtype=float)
                v = np.where(np.isfinite(v), v, fills[i]) + 0.0  # both zeros are one value
                values, at = np.unique(v, return_inverse=True)
                cells, n = np.unique(at.reshape(-1) * len(names) + codes, return_counts=True)
                yield pd.DataFrame({"feature": np.full(len(cells), i, np.int32), "class": np.asarray(names)[cells % len(names)], "value": values[cells // len(names)], "n": n})

    x = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_class"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return x.mapInPandas(count, "feature int, class string, value double, n long").groupBy("feature", "class", "value").agg(F.sum("n").alias("n"))


def _nearer(v: np.ndarray, r: np.ndarray, sign: float) -> np.ndarray:
    """The farthest double on one side of v whose distance to v, as doubles subtract, is below r; v itself where r is 0.

    Found by halving the interval of ordinals (whole numbers in the order of doubles) between v and v + 2 r.
    """
    near, far = ordinals(v), ordinals(v + sign * 2 * r)
    for _ in range(66):  # more than halvings of 64 bits
        middle = (near >> 1) + (far >> 1) + (near & far & 1)
        below = (np.abs(doubles(middle) - v) < r) | (middle == near)
        near, far = np.where(below, middle, near), np.where(below, far, middle)
    return np.where(r > 0, doubles(near), v)


def neighbour_bounds(cells: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(feature, pos, n, lo, hi): the closed interval of values nearer than the k-th neighbour of the own class."""

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        v, n, size = pdf["value"].to_numpy(), pdf["n"].to_numpy(), len(pdf)
        group = pd.factorize(pd.MultiIndex.from_frame(pdf[["feature", "class"]]))[0]
        want = np.minimum(k, pdf["class_n"].to_numpy() - 1)
        distance, weight = np.full((size, 2 * k), np.inf), np.zeros((size, 2 * k), np.int64)
        for s in range(1, min(k, size - 1) + 1):
            same = group[s:] == group[:-s]
            apart = np.where(same, v[s:] - v[:-s], np.inf)
            distance[s:, s - 1], weight[s:, s - 1] = apart, np.where(same, n[:-s], 0)
            distance[:-s, k + s - 1], weight[:-s, k + s - 1] = apart, np.where(same, n[s:], 0)
        order = np.argsort(distance, axis=1, kind="stable")
        reached = (n - 1)[:, None] + np.cumsum(np.take_along_axis(weight, order, axis=1), axis=1)
        first = np.argmax(reached >= want[:, None], axis=1)
        r = np.where(n - 1 >= want, 0.0, np.take_along_axis(distance, order, axis=1)[np.arange(size), first])
        own = pdf["own"].to_numpy()
        v, r = v[own], r[own]
        return pd.DataFrame({"feature": pdf["feature"][own], "pos": pdf["pos"][own], "n": n[own], "lo": _nearer(v, r, -1.0), "hi": _nearer(v, r, 1.0)})

    at = F.floor(F.col("pos") / block)
    near = F.array_distinct(F.array(*[F.floor((F.col("pos") + d) / block) for d in (-k, 0, k)]))
    dealt = cells.withColumn("block", F.explode(near)).withColumn("own", F.col("block") == at)
    return dealt.groupBy("block").applyInPandas(bounds, "feature int, pos long, n long, lo double, hi double")


def neighbour_information(df: DataFrame, columns: list[str], label: str, k: int = 3, block: int = BLOCK) -> DataFrame:
    """(feature, mi) in nats. NULLs and non-finite values become the column's median; a class of one row takes no part,
    one of fewer than k + 1 rows uses all of its other rows; without two such rows the estimate is 0."""
    spark = df.sparkSession
    names = spark.createDataFrame(list(enumerate(columns)), "feature int, name string")
    finite = df.select(label, *[F.when(F.abs(F.col(f"`{c}`").cast("double")) < float("inf"), F.col(f"`{c}`").cast("double")).alias(c) for c in columns])
    medians = {c: q[0] or 0.0 for c, q in quantiles(finite, columns, [0.5]).items()}
    classes = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("class")).agg(F.count("*").alias("class_n")).where("class_n > 1")
    cells = lookup(value_cells(finite, columns, label, medians), materialize(classes, "classes"), "class", "inner")
    cells = materialize(ordered_rank(cells, ["feature", "class", "value"], "pos"), "value-cells")
    ends = materialize(neighbour_bounds(cells, k, block), "intervals")
    nothing = F.lit(0).cast("long")
    merged = cells.select("feature", "value", F.lit(1).alias("kind"), "pos", F.col("n").alias("weight"), nothing.alias("n"))
    for kind, end in ((0, "lo"), (2, "hi")):  # a lower end comes before the cells of its value, an upper end after them
        merged = merged.unionByName(ends.select("feature", F.col(end).alias("value"), F.lit(kind).alias("kind"), "pos", nothing.alias("weight"), "n"))
    totals = ordered_total(merged, ["feature", "value", "kind", "pos"], "weight", "below").where("kind <> 1")
    inside = totals.groupBy("feature", "pos").agg(F.max("n").alias("n"), (F.max(F.when(F.col("kind") == 2, F.col("below"))) - F.max(F.when(F.col("kind") == 0, F.col("below")))).alias("m"))
    near = inside.groupBy("feature").agg(F.sum(F.col("n") * digamma(F.col("m"))).alias("near"))
    used = F.least(F.lit(k), F.col("class_n") - 1)
    known = cells.groupBy("feature").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (digamma(used) - digamma(F.col("class_n")))).alias("own"))
    score = F.greatest(digamma(F.col("rows")) + (F.col("own") - F.col("near")) / F.col("rows"), F.lit(0.0))
    scores = known.join(near, "feature").select("feature", score.alias("mi"))
    return names.join(scores, "feature", "left").select(F.col("name").alias("feature"), F.coalesce("mi", F.lit(0.0)).alias("mi"))
