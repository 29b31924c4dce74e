"""Table profiling: one scan per family of statistics, results in long form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.functions.scaling import correlations, hash_first, order_hash, quantiles
from netsift.operators.information import neighbour_information

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t.startswith(NUMERIC_TYPES)]


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def _long(df: DataFrame, columns: list[str], stats: dict[str, callable], types: bool = False) -> DataFrame:
    """One aggregate row, turned into one row per column with the named statistics."""
    dtypes = dict(df.dtypes)
    row = df.agg(*[
        F.struct(F.lit(c).alias("column_name"), *([F.lit(dtypes[c]).alias("data_type")] if types else []),
                 *[fn(c).alias(name) for name, fn in stats.items()]).alias(f"s{i}")
        for i, c in enumerate(columns)
    ])
    return row.select(F.inline(F.array(*[f"s{i}" for i in range(len(columns))])))


def table_summary(df: DataFrame) -> DataFrame:
    """Per column: type, kind, row count, NULL count and percent."""
    s = _long(df, df.columns, {"row_count": lambda c: F.count(F.lit(1)), "present": lambda c: F.count(c)}, types=True)
    numeric = numeric_columns(df)
    return s.select(
        "column_name", "data_type",
        F.when(F.col("column_name").isin(*numeric) if numeric else F.lit(False), "numeric").otherwise("categorical").alias("kind"),
        "row_count", (F.col("row_count") - F.col("present")).alias("null_count"),
        F.coalesce(F.try_divide((F.col("row_count") - F.col("present")) * 100.0, F.col("row_count")), F.lit(0.0)).alias("null_pct"),
    )


def missing_ratios(df: DataFrame) -> DataFrame:
    return _long(df, df.columns, {"missing_ratio": lambda c: F.coalesce(F.avg(F.col(c).isNull().cast("int")), F.lit(0.0))})


def missing_over(df: DataFrame, threshold: float = 0.20) -> DataFrame:
    return missing_ratios(df).where(F.col("missing_ratio") > threshold)


def top_missing(df: DataFrame, n: int = 30) -> DataFrame:
    return missing_ratios(df).orderBy(F.desc("missing_ratio"), "column_name").limit(n)


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one value, NULL counting as a value. Min and max decide; no distinct needed."""
    return column_facts(df).where("constant").select("column_name")


def column_facts(df: DataFrame) -> DataFrame:
    """Missing ratio and constancy of every column from one scan."""
    stats = _long(df, df.columns, {
        "missing_ratio": lambda c: F.coalesce(F.avg(F.col(c).isNull().cast("int")), F.lit(0.0)), "n": lambda c: F.count(F.lit(1)),
        "present": lambda c: F.count(c), "same": lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(False))})
    constant = (F.col("present") == 0) | (F.col("same") & (F.col("present") == F.col("n")))
    return stats.select("column_name", "missing_ratio", constant.alias("constant"))


def binary_columns(df: DataFrame) -> DataFrame:
    """Columns with at most two non-NULL values: nothing lies apart from the minimum and maximum."""
    bounds = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in df.columns]).first()
    stats = _long(df, df.columns, {
        "third": lambda c: F.coalesce(F.max(~F.col(c).isin(F.lit(bounds[c]["lo"]), F.lit(bounds[c]["hi"]))), F.lit(False))})
    return stats.where(~F.col("third")).select("column_name")


def cardinalities(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct non-NULL values per column: distinct pairs are found before anything is counted."""
    if approximate:
        return _long(df, columns, {"distinct_values": lambda c: F.approx_count_distinct(c)})
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "v")
    found = long.where(F.col("v").isNotNull()).distinct().groupBy("column_name").agg(F.count("*").alias("distinct_values"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(found, "column_name", "left").fillna(0, ["distinct_values"])


def encoding_split(df: DataFrame, columns: list[str], threshold: int = 100, approximate: bool = False) -> DataFrame:
    c = cardinalities(df, columns, approximate)
    return c.withColumn("encoding", F.when(F.col("distinct_values") > threshold, "target").otherwise("onehot"))


def wide_range_columns(df: DataFrame, threshold: float, skip: list[str] = ()) -> DataFrame:
    cols = [c for c in numeric_columns(df) if c not in set(skip)]
    stats = _long(df, cols, {"value_range": lambda c: (F.max(c) - F.min(c)).cast("double")})
    return stats.where(F.col("value_range") > threshold)


def high_correlations(df: DataFrame, columns: list[str], threshold: float = 0.90) -> DataFrame:
    """Pairs above `threshold` in absolute Pearson correlation, strongest first."""
    pairs = correlations(df, columns).where("i < j").withColumn("correlation", F.abs("correlation"))
    return pairs.where(F.col("correlation") > threshold).select("feature_1", "feature_2", "correlation").orderBy(F.desc("correlation"), "feature_1", "feature_2")


def correlated_columns(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("feature_1", "feature_2")).alias("column_name")).distinct()


def binned_counts(df: DataFrame, columns: list[str], label: str, edges: dict[str, list[float]], fill: dict[str, float]) -> DataFrame:
    """(feature, bin, class, n): rows per bin (edges at or below the value) and class, gaps filled.

    Tasks bin whole Arrow batches with numpy and hand on their counts only.
    """
    cuts = [np.array(edges[c], dtype=float) for c in columns]
    fills = [float(fill[c]) for c in columns]

    def count(frames):
        totals = {}
        for pdf in frames:
            codes, names = pd.factorize(pdf["_class"])
            for i, c in enumerate(columns):
                v = pdf[c].to_numpy(dtype=float)
                at = np.searchsorted(cuts[i], np.where(np.isnan(v), fills[i], v), side="right")
                cells = np.bincount(at * len(names) + codes, minlength=(len(cuts[i]) + 1) * len(names))
                for cell in np.flatnonzero(cells):
                    key = (c, int(cell // len(names)), names[cell % len(names)])
                    totals[key] = totals.get(key, 0) + int(cells[cell])
        if totals:
            yield pd.DataFrame([(*k, n) for k, n in totals.items()], columns=["feature", "bin", "class", "n"])

    x = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_class"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return x.mapInPandas(count, "feature string, bin int, class string, n long").groupBy("feature", "bin", "class").agg(F.sum("n").alias("n"))


def information_probs(bins: int = 16) -> list[float]:
    return sorted({i / bins for i in range(bins + 1)} | {0.5})


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 16, exact: bool = True,
                       known: dict[str, list[float]] | None = None, neighbours: int | None = None) -> DataFrame:
    """Plug-in mutual information (nats) of every numeric column with a class.

    NULLs become the column median; columns are cut at their quantiles; only (column, bin, class) counts
    are shuffled, whatever the number of rows. `known` holds the quantiles at information_probs(bins)
    when the caller has them. With `neighbours` the estimate is that of operators.information instead.
    """
    if neighbours:
        return neighbour_information(df, columns, label, neighbours)
    probs = [i / bins for i in range(bins + 1)]
    order = information_probs(bins)
    q = known or quantiles(df, columns, order, exact=exact)
    inner = {c: sorted({q[c][order.index(p)] for p in probs[1:-1]} - {None}) for c in columns}
    medians = {c: q[c][order.index(0.5)] or 0.0 for c in columns}
    cell = binned_counts(df, columns, label, inner, medians)
    by = Window.partitionBy
    p = F.col("n") / F.sum("n").over(by("feature"))
    pb = F.sum("n").over(by("feature", "bin")) / F.sum("n").over(by("feature"))
    pc = F.sum("n").over(by("feature", "class")) / F.sum("n").over(by("feature"))
    terms = cell.select("feature", (p * F.log(p / (pb * pc))).alias("t"))
    return terms.groupBy("feature").agg(F.greatest(F.sum("t"), F.lit(0.0)).alias("mi"))


def low_information(scores: DataFrame, threshold: float = 0.005, protected: list[str] = ()) -> DataFrame:
    low = scores.where(F.col("mi") < threshold)
    return low.where(~F.col("feature").isin(*protected)) if protected else low


def top_information(scores: DataFrame, n: int = 30) -> DataFrame:
    return scores.orderBy(F.desc("mi"), "feature").limit(n)


def information_report(scores: DataFrame, threshold: float) -> DataFrame:
    """Rank, feature, score and whether the feature falls below the threshold."""
    return scores.select(
        F.row_number().over(Window.orderBy(F.desc("mi"), "feature")).alias("rank"), "feature", F.col("mi").alias("mi_score"),
        (F.col("mi") < threshold).alias("will_remove"))


def seeded_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """`n` rows, uniformly and repeatably: the first `n` in hash order."""
    return hash_first(df.withColumn("_h", order_hash(*key, seed=seed)), "_h", F.lit(n)).drop("_h")


def class_distribution(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", share).orderBy(F.desc("n"), col)


def class_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(col)


def top_variance(df: DataFrame, columns: list[str], n: int) -> list[str]:
    """Names of the `n` columns with the highest sample variance (one aggregate row is read)."""
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns]).first()
    known = [c for c in columns if row[c] is not None]
    return sorted(known, key=lambda c: (-row[c], c))[:n]


def correlation_matrix(df: DataFrame, columns: list[str], max_cols: int = 25) -> DataFrame:
    top = top_variance(df, columns, max_cols)
    return correlations(df, top).select("feature_1", "feature_2", "correlation")


def histograms(df: DataFrame, columns: list[str], max_cols: int = 8, bins: int = 50) -> DataFrame:
    """Equal-width counts of the most variable columns; the last bin includes the maximum."""
    top = top_variance(df, columns, max_cols)
    row = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in top]).first()
    index, edges = [], {}
    for c in top:
        lo, hi = row[c]["lo"], row[c]["hi"]
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        edges[c] = (lo, (hi - lo) / bins)
        pos = F.floor((F.col(c).cast("double") - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo))
        index.append(F.least(pos, F.lit(bins - 1)).cast("int").alias(c))
    counts = (
        df.select(*index).unpivot([], top, "feature", "bin").where(F.col("bin").isNotNull())
        .groupBy("feature", "bin").agg(F.count("*").alias("n"))
    )
    grid = df.sparkSession.createDataFrame(
        [(c, b, lo + b * w, lo + (b + 1) * w) for c, (lo, w) in edges.items() for b in range(bins)],
        "feature string, bin int, left_edge double, right_edge double")
    return grid.join(counts, ["feature", "bin"], "left").fillna(0, ["n"])


def profile_report(df: DataFrame, label: str = "label", drop: list[str] = ("attack_cat",), missing_threshold: float = 0.20,
                   correlation_threshold: float = 0.90, mi_threshold: float = 0.005, cardinality_threshold: int = 100,
                   wide_range_threshold: float = 1_000.0, preset_drop: list[str] = (), key: list[str] = (),
                   sample_size: int | None = None) -> DataFrame:
    """The full profile as one nested row. Only per-column results pass through the driver."""
    from netsift.functions.cleaning import coerce_mostly_numeric, label_flag

    spark = df.sparkSession
    y = df.withColumn("_y", label_flag(label)) if label in df.columns else df.withColumn("_y", F.lit(None).cast("int"))
    x = coerce_mostly_numeric(y.drop(label, *drop, *key))
    feats = x.drop("_y")
    names = lambda d: sorted(r["column_name"] for r in d.collect())  # noqa: E731  (one row per column)
    missing = names(missing_over(feats, missing_threshold))
    to_drop = sorted(set(preset_drop) | set(missing) | set(names(constant_columns(feats))))
    categorical = sorted(text_columns(feats))
    binary = names(binary_columns(feats))
    high = sorted(r["column_name"] for r in encoding_split(feats, categorical, cardinality_threshold).collect()
                  if r["encoding"] == "target") if categorical else []
    wide = names(wide_range_columns(feats, wide_range_threshold, binary))
    rows = df.count()
    numeric = numeric_columns(feats)
    sampled = x
    if sample_size is not None and sample_size < rows and key:
        sampled = coerce_mostly_numeric(seeded_sample(y, list(key), sample_size).drop(label, *drop, *key))
    pairs = high_correlations(sampled, numeric, correlation_threshold).collect() if len(numeric) > 1 else []
    scores = {r["feature"]: r["mi"] for r in mutual_information(sampled, numeric, "_y").collect()} if label in df.columns and numeric else {}
    low = sorted(f for f, m in scores.items() if m < mi_threshold)
    warnings = []
    if not pairs:
        warnings.append("No correlated feature pairs above threshold.")
    if not low:
        warnings.append("No low-MI numeric features under the given threshold.")
    if wide:
        warnings.append("Scaling suggested for wide-range numeric columns.")
    used = rows if sample_size is None else min(rows, sample_size)
    report = (
        to_drop, categorical, binary, high, [c for c in categorical if c not in high], binary, wide,
        [(p["feature_1"], p["feature_2"], p["correlation"]) for p in pairs],
        sorted({p["feature_1"] for p in pairs} | {p["feature_2"] for p in pairs}), low, scores,
        (missing_threshold, correlation_threshold, mi_threshold, float(wide_range_threshold)),
        (rows, len(df.columns), len(feats.columns) - len(to_drop), used, len(pairs), len(low)), warnings,
    )
    return spark.createDataFrame([report], """columns_to_drop array<string>, categorical_columns array<string>, binary_columns array<string>,
        target_encoding_columns array<string>, onehot_encoding_columns array<string>, skip_scaling_columns array<string>,
        wide_range_columns array<string>, correlated_pairs array<struct<feature_1:string,feature_2:string,correlation:double>>,
        correlated_to_drop array<string>, low_mi_features array<string>, mi_scores map<string,double>,
        thresholds struct<missing:double,correlation:double,mi:double,wide_range:double>,
        stats_summary struct<rows_loaded:bigint,cols_before:int,cols_after_drop:int,sample_size_used:bigint,corr_pairs_count:int,low_mi_count:int>,
        warnings array<string>""")

