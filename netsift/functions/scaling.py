"""Building blocks that keep ordered and grouped work distributed when a key is hot.

A plain window over a key puts all rows of that key into one task. The helpers below cut each key
into segments, do the ordered work inside a segment, and combine one small row per segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.session import materialize

HASH_BUCKETS = 4096  # three hex digits of an md5


def order_hash(*cols, seed: int = 42) -> Column:
    """A reproducible pseudo-random sort key: md5 over the row key and a seed."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols], F.lit(str(seed))))


def lookup(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a side table. How it travels is left to the optimizer, which knows its size in bytes."""
    return big.join(small, on, how)


def hash_rank(df: DataFrame, hash_col: str, groups: list[str] = (), out: str = "rank",
              ties: list[str] = ()) -> DataFrame:
    """1-based rank of every row by `hash_col` within `groups`, without a whole group in one task.

    A row's rank is the number of rows in lower hash buckets of its group (one small count per bucket)
    plus its position inside its own bucket. Buckets are uniform because the sort key is a hash.
    """
    keys = [f"_g{i}" for i in range(len(groups))] + ["_bucket"]
    tagged = df
    for i, g in enumerate(groups):
        tagged = tagged.withColumn(f"_g{i}", F.coalesce(F.col(g).cast("string"), F.lit("\u0000")))
    tagged = tagged.withColumn("_bucket", F.substring(hash_col, 1, 3))
    below = Window.partitionBy(*keys[:-1]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys).agg(F.count("*").alias("_n"))
        .withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys).orderBy(hash_col, *ties)
    return (
        tagged.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(out, (F.col("_below") + F.col("_pos")).cast("long"))
        .drop("_pos", "_below", *keys)
    )


def hash_first(df: DataFrame, hash_col: str, want: Column, groups: list[str] = ()) -> DataFrame:
    """The first `want` rows of every group in hash order; a group whose `want` is NULL stays whole.

    Hash buckets are counted. Buckets below the cut are kept by a filter and those above dropped by it; only the one
    bucket of a group that the cut goes through is ranked.
    """
    keys = [f"_g{i}" for i in range(len(groups))] + ["_bucket"]
    tagged = df.withColumn("_want", want).withColumn("_bucket", F.substring(hash_col, 1, 3))
    for i, g in enumerate(groups):
        tagged = tagged.withColumn(f"_g{i}", F.coalesce(F.col(g).cast("string"), F.lit("\u0000")))
    below = Window.partitionBy(*keys[:-1]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = tagged.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_want").alias("_want"))
    left = F.col("_want") - F.coalesce(F.sum("_n").over(below), F.lit(0))
    cuts = sizes.withColumn("_left", left).where(F.col("_left").isNull() | (F.col("_left") > 0))
    cuts = materialize(cuts.select(*keys, F.when(F.col("_left") < F.col("_n"), F.col("_left")).alias("_left")), "hash-cuts")
    near = tagged.drop("_want").join(cuts, keys)
    inside = Window.partitionBy(*keys).orderBy(hash_col)
    ranked = near.where("_left is not null").withColumn("_pos", F.row_number().over(inside)).where("_pos <= _left")
    return near.where("_left is null").select(*df.columns).unionByName(ranked.select(*df.columns))


def carry_forward(df: DataFrame, keys: list[str], segment: str, order: list[str], value: Column,
                  out: str) -> DataFrame:
    """Last non-NULL `value` at or before each row of a key.

    The running value is computed inside (key, segment); one row per segment carries it across. The
    segment must not decrease along the order, e.g. a time bucket.
    """
    df = df.withColumn("_v", value)
    inside = Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    latest = (
        df.where(F.col("_v").isNotNull())
        .groupBy(*keys, segment).agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    )
    every = df.select(*keys, segment).distinct().join(latest, [*keys, segment], "left")
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    return (
        df.withColumn("_local", F.last("_v", ignorenulls=True).over(inside))
        .join(carried, [*keys, segment], "left")
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_v", "_local", "_carry")
    )


def running_sums(df: DataFrame, keys: list[str], segment: str, order: list[str],
                 sums: dict[str, str]) -> DataFrame:
    """Running totals of columns (`out -> column`) per key, cut into segments as in carry_forward."""
    inside = Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, segment).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    offsets = totals.select(
        *keys, segment,
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
    )
    out = df
    for o, c in sums.items():
        out = out.withColumn(f"_l_{o}", F.sum(c).over(inside))
    out = out.join(offsets, [*keys, segment])
    for o in sums:
        out = out.withColumn(o, F.col(f"_l_{o}") + F.col(f"_o_{o}"))
    return out.drop(*[f"_l_{o}" for o in sums], *[f"_o_{o}" for o in sums])


def ordered_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """Global 1-based rank along `order` for any sortable columns.

    Rows are range-partitioned and written once with their range number, so the ranges stay fixed
    even if tasks are repeated; ranks are range offsets plus positions inside a range.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ordered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range").agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"))
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, "_range")
        .withColumn(out, (F.col("_below") + F.col("_pos")).cast("long"))
        .drop("_range", "_pos", "_below")
    )


def ordered_total(df: DataFrame, order: list[str], weight: str, out: str = "total") -> DataFrame:
    """Running total of `weight` along `order` over the whole table, the row itself included; ranges as in ordered_rank."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ordered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.sum(weight).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("_in", F.sum(weight).over(inside)).join(offsets, "_range").withColumn(out, F.col("_below") + F.col("_in")).drop("_range", "_in", "_below")


def bucket_index(value: Column, bounds: list[float]) -> Column:
    """Number of `bounds` strictly below `value`: a cheap range segment for sorted work."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < value))


def sorted_position(arr: Column, value: Column, bits: int, inclusive: bool = False) -> Column:
    """How many entries of a sorted array lie below `value` (`inclusive`: at or below), by binary search.

    The array must be padded to exactly 2^bits - 1 entries, see `padded`.
    """
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bits))])

    def halve(acc: Column, step: Column) -> Column:
        entry = F.get(arr, acc + step - 1)
        return acc + F.when(entry <= value if inclusive else entry < value, step).otherwise(0)

    return F.aggregate(steps, F.lit(0), halve)


def padded(values: list, bits: int, top) -> list:
    """Sorted distinct values filled up to 2^bits - 1 entries with `top`, which no value reaches."""
    out = sorted(set(values))
    size = (1 << bits) - 1
    if len(out) > size:
        raise ValueError(f"{len(out)} values do not fit in {size} places")
    return out + [top] * (size - len(out))


def quantiles(df: DataFrame, columns: list[str], probs: list[float], *, exact: bool = True) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several columns, NULL and NaN ignored; one small list per column.

    The wanted ranks are bracketed by the bounded sketch and pinned down by counting, all columns in the same scans
    (see _quantiles_by_counting), whatever the size of the table. Infinities are values. `exact=False` is the sketch.
    """
    if not columns:
        return {}
    number = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    x = df.select(*[number(c).alias(c) for c in columns])
    if not exact:
        row = x.agg(*[F.percentile_approx(f"`{c}`", list(probs), 10_000).alias(c) for c in columns]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in columns}
    return _quantiles_by_counting(x, columns, probs)


_LEAST = -(1 << 63)


def ordinals(values: np.ndarray) -> np.ndarray:
    """Doubles as 64-bit integers of the same order, infinities included; both zeros are 0."""
    bits = np.ascontiguousarray(values, dtype=np.float64).view(np.int64)
    return np.where(bits >= 0, bits, np.int64(_LEAST) - bits)


def doubles(numbers: np.ndarray) -> np.ndarray:
    """The inverse of `ordinals`."""
    return np.where(numbers >= 0, numbers, np.int64(_LEAST) - numbers).view(np.float64)


def from_ordinal(number: int) -> float:
    return float(np.array([number if number >= 0 else _LEAST - number], dtype=np.int64).view(np.float64)[0])


def _located(x: DataFrame, parts: dict[str, list[dict]], split: int) -> DataFrame:
    """(feature, pos, b, n, lo, hi): rows by where they lie to a column's disjoint, sorted intervals of ordinals.

    `pos` is how many ends lie behind a row, odd inside interval (pos + 1) / 2; `b` is which of `split` equal parts of
    that interval it is in. A task hands on one row for each (feature, pos, b), with the least and largest ordinal.
    """
    names = list(parts)
    lows = [np.array([q["lo"] for q in parts[c]], dtype=np.int64) for c in names]
    highs = [np.array([q["hi"] for q in parts[c]], dtype=np.int64) for c in names]
    widths = [np.array([(q["hi"] - q["lo"]) // split + 1 for q in parts[c]], dtype=np.uint64) for c in names]

    def locate(batches):
        found: dict[tuple[int, int, int], list[int]] = {}
        for batch in batches:
            for i, column in enumerate(batch.columns):
                v = ordinals(column.drop_null().to_numpy(zero_copy_only=False))
                pos = np.searchsorted(lows[i], v, side="right") + np.searchsorted(highs[i], v, side="left")
                inside = pos % 2 == 1
                at = np.where(inside, pos // 2, 0)
                part = np.zeros(len(v), np.int64)
                # differences of 64-bit integers fit into unsigned ones
                part[inside] = ((v[inside].view(np.uint64) - lows[i][at[inside]].view(np.uint64)) // widths[i][at[inside]]).astype(np.int64)
                cell, own, n = np.unique(pos * split + part, return_inverse=True, return_counts=True)
                lo, hi = np.full(len(cell), np.iinfo(np.int64).max), np.full(len(cell), _LEAST)
                np.minimum.at(lo, own, v)
                np.maximum.at(hi, own, v)
                for c, k, a, b in zip(cell.tolist(), n.tolist(), lo.tolist(), hi.tolist()):
                    old = found.get((i, *divmod(c, split)))
                    found[(i, *divmod(c, split))] = [k, a, b] if old is None else [old[0] + k, min(old[1], a), max(old[2], b)]
        rows = [(names[i], pos, b, *v) for (i, pos, b), v in found.items()]
        columns_ = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_, kinds)], names=["feature", "pos", "b", "n", "lo", "hi"])

    located = x.select(*[f"`{c}`" for c in names]).mapInArrow(locate, "feature string, pos int, b int, n long, lo long, hi long")
    return located.groupBy("feature", "pos", "b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _quantiles_by_counting(x: DataFrame, columns: list[str], probs: list[float], split: int = 1024) -> dict[str, list[float | None]]:
    """Exact order statistics of many columns in a few scans with tiny shuffles.

    The sketch's guaranteed rank error gives an interval around every wanted rank. A scan counts the rows below and
    inside the intervals and in `split` parts of each; the parts with a wanted rank, shrunk to the values they hold,
    are the next intervals, until each is one value. Intervals are of ordinals, so a scan makes every interval at
    least `split` times narrower, at most seven scans are needed, and infinities are no special case.    """
    acc = 10_000
    grid = {p: (max(p - 2.0 / acc, 0.0), min(p + 2.0 / acc, 1.0)) for p in probs}
    points = sorted({e for pair in grid.values() for e in pair})
    row = x.agg(*[F.struct(F.count(f"`{c}`").alias("n"), F.min(f"`{c}`").alias("lo"), F.max(f"`{c}`").alias("hi"),
                           F.percentile_approx(f"`{c}`", points, acc).alias("q")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    order = lambda value: int(ordinals(np.array([value]))[0])
    sizes, parts, ranks, found = {}, {}, {}, {}
    for i, c in enumerate(columns):
        s = row[f"s{i}"]
        sizes[c] = n = s["n"]
        if n == 0:
            continue
        at = dict(zip(points, s["q"]))
        ranks[c] = sorted({r for p in probs for r in (int(np.floor(p * (n - 1))), int(np.ceil(p * (n - 1))))})
        spans = sorted((order(s["lo"] if a == 0.0 else at[a]), order(s["hi"] if b == 1.0 else at[b])) for a, b in grid.values())
        merged = [list(spans[0])]
        for lo, hi in spans[1:]:
            if lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        parts[c] = [{"lo": lo, "hi": hi} for lo, hi in merged]
    while parts:
        counted: dict[str, list] = {}
        for r in _located(x, parts, split).collect():  # split rows at most for each interval
            counted.setdefault(r["feature"], []).append(r)
        following: dict[str, list[dict]] = {}
        for c, ps in parts.items():
            below = 0  # a wanted rank beside the intervals is followed in the same way
            for r in sorted(counted[c], key=lambda r: (r["pos"], r["b"])):
                want = [k for k in ranks[c] if below <= k < below + r["n"] and (c, k) not in found]
                if r["lo"] == r["hi"]:
                    found.update({(c, k): from_ordinal(r["lo"]) for k in want})
                elif want:
                    following.setdefault(c, []).append({"lo": r["lo"], "hi": r["hi"]})
                below += r["n"]
        parts = following
    out = {}
    for c in columns:
        n = sizes[c]
        if n == 0:
            out[c] = [None] * len(probs)
            continue
        out[c] = []
        for p in probs:
            pos = p * (n - 1)
            a, b = found[(c, int(np.floor(pos)))], found[(c, int(np.ceil(pos)))]
            out[c].append(a if a == b else a + (pos - np.floor(pos)) * (b - a))
    return out


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete moment sums for all column pairs in one scan, NULLs skipped pair by pair.

    Every partition adds up k x k matrices over its Arrow batches and hands on k*k rows; Spark sums
    those. Columns are shifted by their mean first, so large offsets do not cancel digits.
    """
    cols = [F.col(c).cast("double").alias(c) for c in columns]
    centre = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c))  # noqa: E731  (exact for constants)
    means = df.select(*cols).agg(*[F.coalesce(centre(c), F.lit(0.0)).alias(c) for c in columns]).first()
    shift = np.array([means[c] for c in columns])
    k = len(columns)

    def partial(batches):
        acc = None
        for batch in batches:
            x = np.column_stack([col.to_numpy(zero_copy_only=False) for col in batch.columns]).astype(float)
            ok = np.isfinite(x)
            x = np.where(ok, x - shift, 0.0)
            m = ok.astype(float)
            part = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
            acc = part if acc is None else acc + part
        if acc is not None:
            i, j = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32())]
                + [pa.array(acc[q].ravel()) for q in range(4)],
                names=["i", "j", "n", "sx", "sxx", "sxy"],
            )

    parts = df.select(*cols).mapInArrow(partial, "i int, j int, n double, sx double, sxx double, sxy double")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sxy")])
    flipped = sums.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))
    names = F.array(*[F.lit(c) for c in columns])
    return sums.join(flipped, ["i", "j"]).select(
        "i", "j", F.get(names, F.col("i")).alias("feature_1"), F.get(names, F.col("j")).alias("feature_2"),
        "n", "sx", "sy", "sxx", "syy", "sxy",
    )


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every ordered column pair (i, j), NULL where a variance is zero."""
    m = pair_moments(df, columns)
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    corr = F.when((n >= 2) & (vx > 1e-12 * F.abs(F.col("sxx"))) & (vy > 1e-12 * F.abs(F.col("syy"))), F.greatest(F.least(cov / F.sqrt(vx * vy), F.lit(1.0)), F.lit(-1.0)))
    return m.select("i", "j", "feature_1", "feature_2", corr.alias("correlation"))


def lag_across(df: DataFrame, keys: list[str], segment: str, order: list[str], value: str, out: str) -> DataFrame:
    """Previous row's `value` along a key that is cut into segments (see carry_forward)."""
    inside = Window.partitionBy(*keys, segment).orderBy(*order)
    last = df.groupBy(*keys, segment).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(segment)
    carried = last.withColumn("_carry", F.lag("_last").over(before)).drop("_last")
    return (
        df.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_lag", F.lag(value).over(inside))
        .join(carried, [*keys, segment], "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_first", "_lag", "_carry")
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equally named keys, NULL matching NULL; the keys come from the left side."""
    named = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") if c in keys else F.col(f"`{c}`") for c in right.columns])
    match = [left[f"`{k}`"].eqNullSafe(named[f"`_r_{k}`"]) for k in keys]
    return left.join(named, match, how).drop(*[f"_r_{k}" for k in keys])


def trailing_count(df: DataFrame, keys: list[str], ts: str, width_us: int, flag: Column | None = None, out: str = "trailing",
                   chunk_us: int | None = None) -> DataFrame:
    """Rows of the same key (those with `flag`) in (t - width, t], the row itself included.

    The count is the difference of two running totals, up to t and up to t - width. Both come from one pass over the
    distinct times of a key and these times less the width, cut into segments of `chunk_us` (an eighth of the window
    unless given), so the work is linear and a hot key is spread over its segments. NULL is a key like any other.
    """
    segment = max(1, int(chunk_us or 0) or int(width_us) // 8)
    one = F.lit(1) if flag is None else F.when(flag, 1).otherwise(0)
    times = df.groupBy(*keys, F.col(ts).alias("_t")).agg(F.sum(one).cast("long").alias("_n"))
    points = times.select(*keys, F.explode(F.array(
        F.struct(F.col("_t").alias("_at"), F.col("_t").alias("_for"), F.col("_n").alias("_add"), F.lit(True).alias("_upper")),
        F.struct((F.col("_t") - int(width_us)).alias("_at"), F.col("_t").alias("_for"), F.lit(0).cast("long").alias("_add"), F.lit(False).alias("_upper")),
    )).alias("_p")).select(*keys, "_p.*").withColumn("_seg", F.floor(F.col("_at") / F.lit(segment)).cast("long"))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = points.groupBy(*keys, "_seg").agg(F.sum("_add").alias("_n")).select(*keys, "_seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"))
    upto = Window.partitionBy(*keys, "_seg").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    running = null_safe_join(points.withColumn("_local", F.sum("_add").over(upto)), offsets, [*keys, "_seg"])
    total = F.col("_local") + F.col("_below")
    counts = running.groupBy(*keys, F.col("_for").alias(ts)).agg(F.sum(F.when(F.col("_upper"), total).otherwise(-total)).alias(out))
    return null_safe_join(df, counts, [*keys, ts])
