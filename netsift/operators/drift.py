"""Distribution drift between a baseline and a live batch.

All numeric features go through one long table of distinct values with their counts on both sides,
written once. It is cut into value ranges, so a feature is spread over tasks; sorted inside a range, its running
counts give the KS statistic and exact quantiles. Histograms are counted in tasks. Only numbers per feature and range
reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift import schema as S
from netsift.functions.cleaning import norm_text, normalise_names, to_number
from netsift.functions.stats import array_quantile, chi2_pvalue, ks_pvalue
from netsift.session import materialize

MAX_BINS = 15
BATCH_CELLS = 1 << 20  # numbers of an input that a task counts at once
RANGE_ROWS = 50_000  # distinct values of a range, as long as MAX_RANGES are enough
MAX_RANGES = 256
UNSEEN = "__unseen__"

RESULT_COLUMNS = [
    "feature", "feature_type", "drift_score", "ks_stat", "ks_pvalue", "js_divergence", "chi2_stat", "chi2_pvalue", "psi",
    "unseen_rate", "baseline_mean", "live_mean", "baseline_unique", "live_unique", "note",
]


# --- frames -------------------------------------------------------------------------------------

def prepare(df: DataFrame) -> DataFrame:
    """Clean names, text and numbers; keep the canonical columns in order."""
    df = normalise_names(df, blanks=None)
    cols = []
    for c in S.FLOW_COLUMNS:
        if c in df.columns:
            cols.append((norm_text(c) if c in S.DRIFT_CATEGORICAL else to_number(c)).alias(c))
    return df.select(*cols)


def prepare_numeric(df: DataFrame) -> DataFrame:
    """Every column as a number, anything else 0: the form used for engineered features."""
    df = normalise_names(df, blanks=None)
    return df.select(*[to_number(c, 0).alias(c) for c in df.columns])


# --- numeric features ---------------------------------------------------------------------------

@dataclass
class ValueTable:
    """Distinct values per feature with their counts on both sides, and what one pass over them yields."""

    table: DataFrame  # feature, x, n_base, n_live
    stats: dict       # feature -> dict(n_base, n_live, unique, unique_base, unique_live, lo, hi, mean_*, std_base, ks)
    at_rank: dict     # (feature, "pooled" | "base", 0-based rank) -> value


EMPTY = {"n_base": 0, "n_live": 0, "unique": 0, "unique_base": 0, "unique_live": 0, "lo": None, "hi": None,
         "mean_base": None, "mean_live": None, "std_base": None, "ks": 0.0}


def _rank_pairs(n: int, probs) -> set[int]:
    return {r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))} if n else set()


def _bin_probs(unique: int, max_bins: int = MAX_BINS) -> list[float]:
    """Quantiles bin_edges can ask for: quartiles and the steps of the quantile bins."""
    steps = {i / max_bins for i in range(max_bins + 1)}
    if 2 < unique < max_bins:
        steps |= {i / unique for i in range(unique + 1)}
    return sorted({0.25, 0.75, *steps})


def _batch_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, x, n): the distinct numbers of some rows together, so that tasks hand on counts, not cells."""
    most = max(BATCH_CELLS // max(len(features), 1), 1)

    def counted(held: list) -> pa.RecordBatch:
        found = []
        for i in range(len(features)):
            v = np.concatenate([b.column(i).drop_null().to_numpy(zero_copy_only=False) for b in held])
            found.append(np.unique(v[~np.isnan(v)] + 0.0, return_counts=True))
        names = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(features), dtype=np.int32), [len(x) for x, _ in found]), pa.array(features, pa.string()))
        return pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([n for _, n in found]), pa.int64())],
                                          names=["feature", "x", "n"])

    def count(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield counted(held)
                held, rows = [], 0
        if held:
            yield counted(held)

    if not features:
        return df.sparkSession.createDataFrame([], "feature string, x double, n long")
    numbers = df.select(*[to_number(c).cast("double").alias(c) for c in features])
    return numbers.mapInArrow(count, "feature string, x double, n long")


def count_values(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, x, n): distinct numbers with their counts."""
    return _batch_counts(df, features).groupBy("feature", "x").agg(F.sum("n").alias("n"))


def merged_sides(base: DataFrame, live: DataFrame, by: list[str]) -> DataFrame:
    """Counts `n` of both sides next to each other."""
    zero = F.lit(0).cast("long")
    both = base.select(*by, F.col("n").alias("n_base"), zero.alias("n_live")).unionByName(live.select(*by, zero.alias("n_base"), F.col("n").alias("n_live")))
    return both.groupBy(*by).agg(F.sum("n_base").alias("n_base"), F.sum("n_live").alias("n_live"))


def value_table(base: DataFrame, live: DataFrame, features: list[str], deciles: int = 10) -> ValueTable:
    """Counts every distinct value once, the only pass over the rows."""
    return value_table_of(merged_sides(_batch_counts(base, features), _batch_counts(live, features), ["feature", "x"]), features, deciles)


def _with_ranges(table: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """The value table with `part`, the number of a feature's cuts below a value."""
    bounds = {c: np.array(e, dtype=float) for c, e in cuts.items()}

    def place(batches):
        for batch in batches:
            codes = batch.column("feature").dictionary_encode()
            index, x = codes.indices.to_numpy(zero_copy_only=False), batch.column("x").to_numpy(zero_copy_only=False)
            part = np.zeros(batch.num_rows, np.int32)
            for i, name in enumerate(codes.dictionary.to_pylist()):
                if len(bounds[name]):
                    mine = np.flatnonzero(index == i)
                    part[mine] = np.searchsorted(bounds[name], x[mine], side="left")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=["feature", "x", "n_base", "n_live", "part"])

    placed = table.select("feature", "x", "n_base", "n_live").mapInArrow(place, "feature string, x double, n_base long, n_live long, part int")
    return materialize(placed, "drift-ranges")


def value_table_of(counts: DataFrame, features: list[str], deciles: int = 10) -> ValueTable:
    """Reads KS statistics, moments and exact quantiles off the counted values (feature, x, n_base, n_live)."""
    table = materialize(counts, "drift-values")
    x, nb, nl = F.col("x"), F.col("n_base"), F.col("n_live")
    rows = table.groupBy("feature").agg(
        F.sum(nb).alias("n_base"), F.sum(nl).alias("n_live"), F.count("*").alias("unique"), F.count_if(nb > 0).alias("unique_base"),
        F.count_if(nl > 0).alias("unique_live"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.try_divide(F.sum(x * nb), F.sum(nb)).alias("mean_base"),
        F.try_divide(F.sum(x * nl), F.sum(nl)).alias("mean_live"), F.percentile_approx(x, [i / MAX_RANGES for i in range(1, MAX_RANGES)], 2_000).alias("cuts")).collect()
    stats = {c: dict(EMPTY) for c in features}
    stats.update({r["feature"]: {**EMPTY, **{k: r[k] for k in r.asDict() if k not in ("feature", "cuts")}} for r in rows})
    cuts = {}
    for r in rows:  # any cuts are right; these keep a range in bounds
        ranges = min(max(math.ceil(r["unique"] / RANGE_ROWS), 1), MAX_RANGES)
        cuts[r["feature"]] = sorted({r["cuts"][i * MAX_RANGES // ranges - 1] for i in range(1, ranges)})
    placed = _with_ranges(table, cuts)
    below: dict[tuple[str, int], tuple[int, int]] = {}
    at_start = dict.fromkeys(cuts, (0, 0))
    for r in placed.groupBy("feature", "part").agg(F.sum(nb).alias("b"), F.sum(nl).alias("l")).orderBy("feature", "part").collect():
        b, l = below[(r["feature"], r["part"])] = at_start[r["feature"]]
        at_start[r["feature"]] = (b + r["b"], l + r["l"])
    facts = {r["feature"]: (r["n_base"], r["n_live"], r["mean_base"],
                            np.array(sorted(_rank_pairs(r["n_base"] + r["n_live"], _bin_probs(r["unique"]))), dtype=np.int64),
                            np.array(sorted(_rank_pairs(r["n_base"], [i / deciles for i in range(deciles + 1)])), dtype=np.int64)) for r in rows}

    def read(key: tuple, rows: pa.Table) -> pa.Table:
        name, part = key[0].as_py(), key[1].as_py()
        total_base, total_live, centre, pooled, own = facts[name]
        before_base, before_live = below[(name, part)]
        v, b, l = (rows.column(c).to_numpy() for c in ("x", "n_base", "n_live"))
        order = np.argsort(v, kind="stable")
        v, b, l = v[order], b[order], l[order]
        upto_base, upto_live = before_base + np.cumsum(b), before_live + np.cumsum(l)
        gap = np.abs(upto_base / total_base - upto_live / total_live).max() if total_base and total_live else None
        hits = []
        for of, ranks, upto, first in (("pooled", pooled, upto_base + upto_live, before_base + before_live), ("base", own, upto_base, before_base)):
            wanted = ranks[(ranks >= first) & (ranks < upto[-1])]
            hits += [{"of": of, "r": int(r), "x": float(v[i])} for r, i in zip(wanted, np.searchsorted(upto, wanted, side="right"))]
        with np.errstate(all="ignore"):
            square = float((b * (v - centre) * (v - centre)).sum()) if centre is not None else None
        return pa.Table.from_arrays([pa.array([name], pa.string()), pa.array([gap], pa.float64()), pa.array([square], pa.float64()),
                                     pa.array([hits], pa.list_(pa.struct([("of", pa.string()), ("r", pa.int64()), ("x", pa.float64())])))], names=["feature", "ks", "sq", "hits"])

    read_off = placed.groupBy("feature", "part").applyInArrow(read, "feature string, ks double, sq double, hits array<struct<of:string,r:bigint,x:double>>").collect()
    at, squares = {}, {}
    for r in read_off:  # a row per range; the lists hold one entry per wanted rank, a few dozen per feature
        s = stats[r["feature"]]
        s["ks"] = max(s["ks"], r["ks"] or 0.0)
        squares.setdefault(r["feature"], []).append(r["sq"])
        at.update({(r["feature"], h["of"], h["r"]): h["x"] for h in r["hits"]})
    for c, parts in squares.items():
        s = stats[c]
        s["std_base"] = (math.fsum(parts) / s["n_base"]) ** 0.5 if s["n_base"] else None
    return ValueTable(table, stats, at)


def ks_statistics(v: ValueTable) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value; an empty side gives (0, 1)."""
    spark = v.table.sparkSession
    out = spark.createDataFrame([(c, float(m["ks"]), float(m["n_base"]), float(m["n_live"])) for c, m in v.stats.items()], "feature string, ks_stat double, nb double, nl double")
    p = F.when((F.col("nb") > 0) & (F.col("nl") > 0), ks_pvalue(F.col("ks_stat"), F.col("nb"), F.col("nl"))).otherwise(1.0)
    return out.select("feature", "ks_stat", p.alias("ks_pvalue"))


def _quantile(v: ValueTable, feature: str, of: str, p: float) -> float:
    n = v.stats[feature]["n_base"] + (v.stats[feature]["n_live"] if of == "pooled" else 0)
    pos = p * (n - 1)
    a, b = v.at_rank[(feature, of, math.floor(pos))], v.at_rank[(feature, of, math.ceil(pos))]
    return a + (b - a) * (pos - math.floor(pos))


def bin_edges(v: ValueTable, max_bins: int = MAX_BINS) -> dict[str, list[float]]:
    """Histogram edges per feature on the pooled values: one bin for up to two values, else
    Freedman-Diaconis bins, else distinct quantiles when those are too few or too many."""
    out = {}
    for c, m in v.stats.items():
        lo, hi, unique, n = m["lo"], m["hi"], m["unique"], m["n_base"] + m["n_live"]
        if unique == 0:
            out[c] = [0.0, 1.0]
            continue
        if unique <= 2:
            out[c] = [lo - 0.5, hi + 0.5]
            continue
        at = lambda p, c=c: _quantile(v, c, "pooled", p)
        width = 2.0 * (at(0.75) - at(0.25)) * n ** (-1.0 / 3.0)
        bins = math.ceil((hi - lo) / width) if width > 0 else 1
        if 2 <= bins <= max_bins:
            out[c] = [lo + i * ((hi - lo) / bins) for i in range(bins)] + [hi]
            continue
        k = min(max_bins, unique) if bins < 2 else max_bins
        distinct = sorted({at(i / k) for i in range(k + 1)})
        out[c] = distinct if len(distinct) >= 2 else [lo - 0.5, hi + 0.5]
    return out


def _edge_column(edges: dict[str, list[float]]) -> Column:
    return F.element_at(F.create_map(*[x for c, e in edges.items() for x in (F.lit(c), F.array(*[F.lit(float(b)) for b in e]))]), F.col("feature"))


def histogram_distributions(v: ValueTable, edges: dict[str, list[float]]) -> DataFrame:
    """Share of each side per (feature, bin): bins closed on the left, the last one on both ends."""
    spark = v.table.sparkSession
    most = max((len(e) - 2 for e in edges.values()), default=0)
    inner = spark.createDataFrame([(c, *e[1:-1], *[float("inf")] * (most + 2 - len(e))) for c, e in edges.items()],
                                  ", ".join(["feature string", *[f"e{i} double" for i in range(most)]]))
    at = sum(((F.col("x") >= F.col(f"e{i}")).cast("int") for i in range(most)), F.lit(0))
    counts = v.table.join(F.broadcast(inner), "feature").groupBy("feature", at.alias("bin")).agg(F.sum("n_base").alias("n_base"), F.sum("n_live").alias("n_live"))
    grid = spark.createDataFrame([(c, i, e[i], e[i + 1]) for c, e in edges.items() for i in range(len(e) - 1)],
                                 "feature string, bin int, left_edge double, right_edge double")
    full = grid.join(counts, ["feature", "bin"], "left").fillna(0, ["n_base", "n_live"])
    w = Window.partitionBy("feature")

    def share(n):
        return F.coalesce(F.try_divide(F.col(n).cast("double"), F.sum(n).over(w)), F.lit(1.0) / F.count("*").over(w))

    return full.select("feature", "bin", "left_edge", "right_edge", share("n_base").alias("p"), share("n_live").alias("q"))


def _js_term(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    part = lambda a: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    return 0.5 * part(p) + 0.5 * part(q)


def _psi_term(p: Column, q: Column, eps: float = 1e-6) -> Column:
    return (q - p) * F.log((q + eps) / (p + eps))


def divergences(dist: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence (base 2) and population stability index per feature."""
    p, q = F.col("p"), F.col("q")
    return dist.groupBy("feature").agg(F.sum(_js_term(p, q)).alias("js_divergence"), F.sum(_psi_term(p, q)).alias("psi"))


def mean_shifts(v: ValueTable) -> DataFrame:
    spark = v.table.sparkSession
    rows = [(c, m["mean_base"], m["mean_live"], m["std_base"]) for c, m in v.stats.items()]
    t = spark.createDataFrame(rows, "feature string, baseline_mean double, live_mean double, std_base double")
    shift = F.when(F.col("std_base") <= 1e-9, 0.0).otherwise(
        F.least(F.abs(F.col("live_mean") - F.col("baseline_mean")) / (F.col("std_base") + 1e-9), F.lit(3.0)) / 3.0)
    return t.select("feature", "baseline_mean", "live_mean", shift.alias("mean_shift"))


def numeric_results(base: DataFrame, live: DataFrame, features: list[str]) -> DataFrame:
    """One result row per numeric feature; a side without values scores 0."""
    return numeric_results_of(value_table(base, live, features))


def numeric_results_of(v: ValueTable) -> DataFrame:
    spark = v.table.sparkSession
    unique = spark.createDataFrame(
        [(c, m["unique_base"], m["unique_live"], bool(m["n_base"] and m["n_live"])) for c, m in v.stats.items()],
        "feature string, baseline_unique long, live_unique long, filled boolean")
    r = (
        unique.join(ks_statistics(v), "feature").join(divergences(histogram_distributions(v, bin_edges(v))), "feature")
        .join(mean_shifts(v), "feature")
    )
    score = (0.35 * F.col("ks_stat") + 0.25 * F.least(F.abs("psi") / 0.25, F.lit(1.0)) + 0.25 * F.col("js_divergence")
             + 0.15 * F.coalesce("mean_shift", F.lit(0.0)))
    keep = lambda c, empty: F.when(F.col("filled"), c).otherwise(F.lit(empty))
    return r.select(
        "feature", F.lit("numeric").alias("feature_type"), keep(_clip(score), 0.0).alias("drift_score"),
        keep(F.col("ks_stat"), 0.0).alias("ks_stat"), keep(F.col("ks_pvalue"), 1.0).alias("ks_pvalue"),
        keep(F.col("js_divergence"), 0.0).alias("js_divergence"), F.lit(0.0).alias("chi2_stat"), F.lit(1.0).alias("chi2_pvalue"),
        keep(F.col("psi"), 0.0).alias("psi"), F.lit(0.0).alias("unseen_rate"), keep(F.col("baseline_mean"), None).alias("baseline_mean"),
        keep(F.col("live_mean"), None).alias("live_mean"), keep(F.col("baseline_unique"), 0).alias("baseline_unique"),
        keep(F.col("live_unique"), 0).alias("live_unique"), F.lit("").alias("note"))


def _clip(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def psi_deciles(base: DataFrame, live: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """PSI on the baseline's own quantile bins (open left, first closed); live values outside are left out."""
    v = value_table(base, live, features, deciles=bins)
    edges = {c: sorted({_quantile(v, c, "base", i / bins) for i in range(bins + 1)}) for c, m in v.stats.items() if m["n_base"]}
    usable = {c: e for c, e in edges.items() if len(e) >= 2 and v.stats[c]["unique_base"] > 1 and v.stats[c]["n_live"] > 0}
    spark = v.table.sparkSession
    fixed = [(c, 1.0 if v.stats[c]["unique_base"] == 1 and v.stats[c]["unique_live"] > 1 else 0.0) for c in features if c not in usable]
    done = spark.createDataFrame(fixed, "feature string, psi double")
    if not usable:
        return done
    x, e = F.col("x"), F.col("edges")
    at = F.greatest(F.size(F.filter(e, lambda b: b < x)) - 1, F.lit(0))
    inside = (
        v.table.where(F.col("feature").isin(*usable)).withColumn("edges", _edge_column(usable))
        .where((x >= F.get(e, F.lit(0))) & (x <= F.element_at(e, -1))).withColumn("bin", at)
    )
    counts = inside.groupBy("feature", "bin").agg(F.sum("n_base").alias("n_base"), F.sum("n_live").alias("n_live"))
    grid = spark.createDataFrame([(c, i) for c, ed in usable.items() for i in range(len(ed) - 1)], "feature string, bin int")
    w = Window.partitionBy("feature")
    share = lambda n: F.coalesce(F.try_divide(F.col(n).cast("double"), F.sum(n).over(w)), F.lit(0.0))
    full = grid.join(counts, ["feature", "bin"], "left").fillna(0, ["n_base", "n_live"]).select("feature", share("n_base").alias("p"), share("n_live").alias("q"))
    return full.groupBy("feature").agg(F.sum(_psi_term(F.col("p"), F.col("q"))).alias("psi")).unionByName(done)


# --- categorical features -----------------------------------------------------------------------

def count_categories(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, category, n)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in features]).unpivot([], features, "feature", "category")
    return long.where("category is not null").groupBy("feature", "category").agg(F.count("*").alias("n"))


def category_counts(base: DataFrame, live: DataFrame, features: list[str]) -> DataFrame:
    """(feature, category) with counts on both sides, which stands for the outer join."""
    return merged_sides(count_categories(base, features), count_categories(live, features), ["feature", "category"])


def _shares(counts: DataFrame) -> DataFrame:
    w = Window.partitionBy("feature")
    share = lambda n: F.coalesce(F.try_divide(F.col(n).cast("double"), F.sum(n).over(w)), F.lit(0.0))
    return counts.withColumn("p", share("n_base")).withColumn("q", share("n_live"))


def fold_unseen(counts: DataFrame) -> DataFrame:
    """Live categories the baseline never had become one `__unseen__` category."""
    name = F.when(F.col("n_base") == 0, F.lit(UNSEEN)).otherwise(F.col("category"))
    return counts.groupBy("feature", name.alias("category")).agg(F.sum("n_base").alias("n_base"), F.sum("n_live").alias("n_live"))


def unseen_rates(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature").agg(
        F.coalesce(F.try_divide(F.sum(F.when(F.col("n_base") == 0, F.col("n_live")).otherwise(0)).cast("double"), F.sum("n_live")), F.lit(0.0)).alias("unseen_rate"),
        F.count_if(F.col("n_base") > 0).alias("baseline_unique"), F.count_if(F.col("n_live") > 0).alias("live_unique"))


def aligned_shares(counts: DataFrame) -> DataFrame:
    return _shares(fold_unseen(counts)).select("feature", "category", "p", "q")


def psi_categories(counts: DataFrame) -> DataFrame:
    """PSI over the union of categories; 0 when a side is empty."""
    s = _shares(counts).groupBy("feature").agg(F.sum(_psi_term(F.col("p"), F.col("q"))).alias("psi"), F.sum("n_base").alias("b"), F.sum("n_live").alias("l"))
    return s.select("feature", F.when((F.col("b") > 0) & (F.col("l") > 0), F.col("psi")).otherwise(0.0).alias("psi"))


def chi_square(folded: DataFrame) -> DataFrame:
    """Independence of side and category on 2 x k counts, no continuity correction."""
    w = Window.partitionBy("feature")
    b, l = F.sum("n_base").over(w), F.sum("n_live").over(w)
    row = F.col("n_base") + F.col("n_live")
    expected = lambda side: row.cast("double") * side / (b + l)
    cell = lambda n, side: (F.col(n) - expected(side)) * (F.col(n) - expected(side)) / F.nullif(expected(side), F.lit(0.0))
    s = folded.select("feature", (cell("n_base", b) + cell("n_live", l)).alias("t"), b.alias("b"), l.alias("l")).groupBy("feature").agg(
        F.sum("t").alias("t"), F.count("*").alias("k"), F.max("b").alias("b"), F.max("l").alias("l"))
    ok = (F.col("k") >= 2) & (F.col("b") > 0) & (F.col("l") > 0)
    return s.select("feature", F.when(ok, F.col("t")).otherwise(0.0).alias("chi2_stat"), F.when(ok, F.col("k") - 1).otherwise(0).cast("int").alias("dof"))


def categorical_results(base: DataFrame, live: DataFrame, features: list[str]) -> DataFrame:
    return categorical_results_of(category_counts(base, live, features), features)


def categorical_results_of(counts: DataFrame, features: list[str]) -> DataFrame:
    folded = fold_unseen(counts)
    js = _shares(folded).groupBy("feature").agg(F.sum(_js_term(F.col("p"), F.col("q"))).alias("js_divergence"),
                                               F.sum("n_base").alias("b"), F.sum("n_live").alias("l"))
    names = counts.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    r = (
        names.join(unseen_rates(counts), "feature", "left").join(js, "feature", "left").join(chi_square(folded), "feature", "left")
        .withColumn("chi2_pvalue", chi2_pvalue(F.coalesce("chi2_stat", F.lit(0.0)), F.coalesce("dof", F.lit(0))))
    )
    filled = (F.col("b") > 0) & (F.col("l") > 0)
    score = 0.45 * F.col("js_divergence") + 0.35 * (1 - F.col("chi2_pvalue")) + 0.20 * F.col("unseen_rate")
    keep = lambda c, empty: F.when(filled, c).otherwise(F.lit(empty))
    none = F.lit(None).cast("double")
    return r.select(
        "feature", F.lit("categorical").alias("feature_type"), keep(_clip(score), 0.0).alias("drift_score"), F.lit(0.0).alias("ks_stat"),
        F.lit(1.0).alias("ks_pvalue"), keep(F.col("js_divergence"), 0.0).alias("js_divergence"), keep(F.col("chi2_stat"), 0.0).alias("chi2_stat"),
        keep(F.col("chi2_pvalue"), 1.0).alias("chi2_pvalue"), F.lit(0.0).alias("psi"), keep(F.col("unseen_rate"), 0.0).alias("unseen_rate"),
        none.alias("baseline_mean"), none.alias("live_mean"), F.coalesce("baseline_unique", F.lit(0)).alias("baseline_unique"),
        F.coalesce("live_unique", F.lit(0)).alias("live_unique"),
        F.lit("Unseen categories are tracked explicitly in the `__unseen__` bucket.").alias("note"))


def compare_features(base: DataFrame, live: DataFrame) -> DataFrame:
    """Result rows for every canonical column present on both sides."""
    b, l = prepare(base), prepare(live)
    shared = [c for c in b.columns if c in l.columns]
    numeric = [c for c in shared if c not in S.DRIFT_CATEGORICAL]
    text = [c for c in shared if c in S.DRIFT_CATEGORICAL]
    parts = ([numeric_results(b, l, numeric)] if numeric else []) + ([categorical_results(b, l, text)] if text else [])
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def compare_numeric(base: DataFrame, live: DataFrame) -> DataFrame:
    """Result rows with every shared column taken as a number (engineered features)."""
    b, l = prepare_numeric(base), prepare_numeric(live)
    return numeric_results(b, l, [c for c in b.columns if c in l.columns])


# --- importances, risk and severity --------------------------------------------------------------

def source_columns(name: str, onehot: list[str] = ()) -> list[str]:
    """Source columns a prepared feature goes back to."""
    for c in onehot:
        if name.startswith(f"{c}_"):
            return [c]
    if name in S.DERIVED_SOURCES:
        return S.DERIVED_SOURCES[name]
    if name in S.FLOW_COLUMNS:
        return [name]
    for mark in ("__", "_"):
        head = name.split(mark, 1)[0]
        if mark in name and head in S.FLOW_COLUMNS:
            return [head]
    return []


def collapse_importances(importances: DataFrame, present: list[str], onehot: list[str] = ()) -> DataFrame:
    """Prepared-feature importances (feature, importance) added up per source column and normalised;
    1.0 for every present column when nothing can be attributed."""
    spark = importances.sparkSession
    names = [r["feature"] for r in importances.select("feature").distinct().collect()]  # one row per model input
    pairs = [(n, s, 1.0 / len(src)) for n in names for src in [source_columns(n, onehot)] for s in src]
    target = spark.createDataFrame([(c,) for c in present], "feature string")
    if not pairs:
        return target.withColumn("importance", F.lit(1.0))
    links = spark.createDataFrame(pairs, "prepared string, source string, part double")
    sums = importances.join(F.broadcast(links), importances["feature"] == links["prepared"]).groupBy("source").agg(F.sum(F.col("importance") * F.col("part")).alias("s"))
    total = F.sum("s").over(Window.partitionBy())
    shares = sums.select(F.col("source").alias("feature"), F.col("s"), total.alias("total"))
    any_total = F.max("total").over(Window.partitionBy())
    return target.join(shares, "feature", "left").select(
        "feature", F.when(F.coalesce(any_total, F.lit(0.0)) <= 0, 1.0).otherwise(F.coalesce(F.col("s") / any_total, F.lit(0.0))).alias("importance"))


def with_risk(results: DataFrame, importances: DataFrame | None = None) -> DataFrame:
    if importances is None:
        r = results.withColumn("importance", F.lit(1.0))
    else:
        r = results.join(importances.select("feature", "importance"), "feature", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    return r.withColumn("risk_score", _clip(F.col("drift_score") * (0.5 + 0.5 * _clip(F.col("importance")))))


def thresholds(history: Column) -> Column:
    """Severity thresholds blended with the quantiles of past overall scores (an array column)."""
    low0, mod0, sev0 = S.SEVERITY_DEFAULTS
    blend = lambda d, p: F.coalesce(0.85 * F.lit(d) + 0.15 * array_quantile(history, p), F.lit(d))
    low = F.greatest(F.lit(low0), blend(low0, 0.60))
    moderate = F.greatest(low + 0.05, blend(mod0, 0.85))
    severe = F.greatest(moderate + 0.05, blend(sev0, 0.95))
    return F.struct(low.alias("low"), moderate.alias("moderate"), severe.alias("severe"))


def severity(score: Column, t: Column) -> Column:
    return (F.when(score >= t["severe"], "severe").when(score >= t["moderate"], "moderate")
            .when(score >= t["low"], "low").otherwise("stable"))


def with_severity(risked: DataFrame, t: Column) -> DataFrame:
    r = risked.withColumn("severity", severity(F.col("drift_score"), t))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in {"stable": 0, "low": 1, "moderate": 2, "severe": 3}.items() for x in kv]), F.col("severity"))
    return r.withColumn("alert", F.col("severity") == "severe").withColumn("severity_rank", rank)


def overall(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts, fractions and the importance-weighted overall score of one or many batches."""
    w = F.greatest("importance", F.lit(0.05))
    drifted, severe = F.count_if(F.col("severity") != "stable"), F.count_if(F.col("severity") == "severe")
    n = F.greatest(F.count("*"), F.lit(1))
    return results.groupBy(*by).agg(
        F.count("*").alias("feature_count"), drifted.alias("drift_count"), severe.alias("severe_count"),
        (drifted / n).alias("drift_fraction"), (severe / n).alias("severe_fraction"),
        F.coalesce(F.try_divide(F.sum(F.col("risk_score") * w), F.sum(w)), F.lit(0.0)).alias("overall_score"))


def trend(history: Column, score: Column) -> Column:
    """Trend label, delta to the last score and slope over the last four scores plus the current one."""
    known = F.filter(history, lambda x: x.isNotNull())
    recent = F.concat(F.slice(known, F.greatest(F.size(known) - 3, F.lit(1)), 4), F.array(score))
    n = F.size(recent)
    mid = (n - 1) / 2.0
    num = F.aggregate(F.zip_with(recent, F.sequence(F.lit(0), n - 1), lambda y, i: (i - mid) * y), F.lit(0.0), lambda a, b: a + b)
    slope = F.when(n >= 2, num / (n * (n * n - 1) / 12.0)).otherwise(0.0)
    delta = score - F.element_at(known, -1)
    label = (F.when((delta >= 0.18) & (score >= 0.35), "sudden").when((slope >= 0.04) & (score >= 0.25), "gradual").otherwise("stable"))
    empty = F.size(known) == 0
    return F.struct(
        F.when(empty, "new").otherwise(label).alias("label"),
        F.when(empty, 0.0).otherwise(delta).alias("delta"),
        F.when(empty, 0.0).otherwise(slope).alias("slope"))


def judge(batches: DataFrame, alert_fraction: float = 0.30) -> DataFrame:
    """Overall severity, trend and alert of batches with `history` (array of past scores)."""
    score, sf, df_ = F.col("overall_score"), F.col("severe_fraction"), F.col("drift_fraction")
    b = batches.withColumn("thresholds", thresholds(F.col("history"))).withColumn("trend", trend(F.col("history"), score))
    plain = severity(score, F.col("thresholds"))
    lifted = (F.when(sf >= 0.10, "severe")
              .when((df_ >= alert_fraction) & plain.isin("stable", "low"), "moderate").otherwise(plain))
    b = b.withColumn("overall_severity", lifted)
    pct = lambda c: F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))
    reasons = F.array_compact(F.array(
        F.when(sf >= 0.10, F.concat(pct(sf), F.lit(" of features are severe"))),
        F.when(df_ >= alert_fraction, F.concat(pct(df_), F.lit(" of features drifted"))),
        F.when(F.col("overall_severity") == "severe", F.lit("overall drift severity is severe")),
        F.when(F.col("trend.label") == "sudden", F.lit("sudden upward drift detected"))))
    b = b.withColumn("_reasons", reasons).withColumn("alert", F.size("_reasons") > 0)
    return (
        b.withColumn("alert_level", F.when((sf >= 0.2) | (F.col("overall_severity") == "severe"), "critical").when(F.col("alert"), "warning").otherwise("info"))
        .withColumn("alert_reason", F.when(F.col("alert"), F.concat_ws("; ", "_reasons")).otherwise("no alert conditions met"))
        .drop("_reasons")
    )


def top_features(results: DataFrame, n: int = 10, by: list[str] = ()) -> DataFrame:
    """The `n` riskiest features, per batch when `by` is given."""
    if not by:
        return results.orderBy(F.desc("risk_score"), "feature").limit(n)
    w = Window.partitionBy(*by).orderBy(F.desc("risk_score"), "feature")
    return results.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def report(base: DataFrame, live: DataFrame, importances: DataFrame | None = None, history: list[float] = ()) -> DataFrame:
    """Drift report: one row per feature with risk, severity and stable / drift status, riskiest first."""
    hist = _history_literal(history)
    r = with_severity(with_risk(compare_features(base, live), importances), thresholds(hist))
    return r.withColumn("status", F.when(F.col("severity") == "stable", "stable").otherwise("drift")).orderBy(F.desc("risk_score"), "feature")


def _history_literal(scores) -> Column:
    return F.array(*[F.lit(float(s)) for s in scores]).cast("array<double>")


def assess(results: DataFrame, *, batch_size: int, importances: DataFrame | None = None, history: DataFrame | None = None,
           top_n: int = 10, alert_fraction: float = 0.30, timestamp: str | None = None) -> DataFrame:
    """The assessment document of one batch as a nested row.

    `history` holds the last assessments (timestamp, overall_score, overall_severity, trend), at most
    twenty rows, see sources.history.load.
    """
    past = history.orderBy("timestamp").collect() if history is not None else []
    hist = _history_literal([h["overall_score"] for h in past if h["overall_score"] is not None])
    rated = with_severity(with_risk(results, importances), thresholds(hist))
    rated = materialize(rated, "drift-rated")
    one = overall(rated).withColumn("history", hist)
    doc = judge(one, alert_fraction)
    fields = [c for c in rated.columns if c != "severity_rank"]
    best = top_features(rated, top_n).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("risk_score")).alias("_o"), *fields)), ).alias("top"))
    best = best.select(F.transform("top", lambda t: F.struct(*[t[c].alias(c) for c in fields])).alias("top_features"))
    now = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    trail_schema = "array<struct<timestamp:string,overall_score:double,severity:string,trend:string>>"
    trail = F.array(*[F.struct(F.lit(h["timestamp"]).alias("timestamp"), F.lit(h["overall_score"]).cast("double").alias("overall_score"),
                               F.lit(h["overall_severity"]).alias("severity"), F.lit(h["trend"]).alias("trend")) for h in past[-10:]]).cast(trail_schema)
    one = F.lit(1).alias("_one")  # both sides are a single row
    doc = doc.select("*", one).join(best.select("*", one), "_one")
    doc = doc.select(
        now.alias("timestamp"), F.lit(int(batch_size)).cast("long").alias("batch_size"), "feature_count", "drift_count", "severe_count",
        "drift_fraction", "severe_fraction", "overall_score", "overall_severity", "alert", "alert_level", "alert_reason", "thresholds",
        F.col("trend.label").alias("trend"), F.col("trend.delta").alias("trend_delta"), F.col("trend.slope").alias("trend_slope"),
        F.lit(len(past)).alias("history_count"), "top_features", trail.alias("history"))
    return doc.withColumn("dashboard", dashboard())


def dashboard() -> Column:
    """The dashboard part of an assessment row."""
    c = F.col
    return F.struct(
        c("timestamp"),
        F.struct(c("overall_score").alias("score"), c("overall_severity").alias("severity"), c("alert"), c("alert_level").alias("level"),
                 c("alert_reason").alias("reason")).alias("overall"),
        F.struct(c("feature_count").alias("features"), c("drift_count").alias("drifted"), c("severe_count").alias("severe")).alias("counts"),
        F.struct(c("drift_fraction").alias("drifted"), c("severe_fraction").alias("severe")).alias("fractions"),
        c("thresholds"),
        F.struct(c("trend").alias("label"), c("trend_delta").alias("delta"), c("trend_slope").alias("slope")).alias("trend"),
        c("top_features"), c("history"))


def model_input_drift(base: DataFrame, live: DataFrame, prepare_model, importances: DataFrame | None = None,
                      history: DataFrame | None = None, top_n: int = 10) -> DataFrame:
    """Drift of the prepared features: both sides go through the fitted preparation first."""
    feats = prepare_model.featureNames()
    prepared = [prepare_model.transform(normalise_names(d, blanks=None).drop(*S.LABEL_COLUMNS)).select(*feats) for d in (base, live)]
    return assess(compare_numeric(*prepared), batch_size=live.count(), importances=importances, history=history, top_n=top_n)
