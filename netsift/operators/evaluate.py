"""Classifier evaluation from (true, predicted) columns; `by` repeats everything per split or model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.functions.cleaning import quality_tag
from netsift.functions.scaling import bucket_index, running_sums


def cell_counts(df: DataFrame, y: str = "y", yhat: str = "yhat", by: list[str] = ()) -> DataFrame:
    """Non-empty confusion cells; everything below works on these few rows."""
    return df.groupBy(*by, F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, classes: list, y: str = "y", yhat: str = "yhat", normalise: bool = False) -> DataFrame:
    """Dense matrix in long form: every pair of listed classes, 0 where nothing fell."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[y]
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], f"y {kind}, yhat {kind}")
    dense = grid.join(cell_counts(df, y, yhat), ["y", "yhat"], "left").fillna(0, ["n"])
    if not normalise:
        return dense
    row = F.sum("n").over(Window.partitionBy("y"))
    return dense.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), row), F.lit(0.0)))


def wide_confusion(df: DataFrame, classes: list, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return confusion_matrix(df, classes, y, yhat).groupBy("y").pivot("yhat", classes).agg(F.first("n"))


def accuracy(df: DataFrame, y: str = "y", yhat: str = "yhat", by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy"))


def per_class(df: DataFrame, y: str = "y", yhat: str = "yhat", by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a denominator is 0."""
    cells = cell_counts(df, y, yhat, by)
    zero = F.lit(0).cast("bigint")
    marginals = (
        cells.select(*by, F.col("y").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(zero).alias("hit"))
        .unionByName(cells.select(*by, F.col("yhat").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hit")))
        .groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    m = marginals.withColumn("precision", ratio(F.col("hit"), F.col("predicted"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))
    return m.select(*by, "class", "precision", "recall", f1.alias("f1"), "support", "hit")


def averages(df: DataFrame, y: str = "y", yhat: str = "yhat", by: list[str] = ()) -> DataFrame:
    """Accuracy with macro and support-weighted precision, recall and F1."""
    p = per_class(df, y, yhat, by)
    weighted = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))
    return p.groupBy(*by).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")])


def tagged_f1(df: DataFrame, y: str = "y", yhat: str = "yhat", by: list[str] = ()) -> DataFrame:
    return per_class(df, y, yhat, by).select(*by, "class", "f1", "support", quality_tag("f1").alias("quality"))


def top_errors(df: DataFrame, n: int = 5, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return cell_counts(df, y, yhat).where(F.col("y") != F.col("yhat")).orderBy(F.desc("n"), "y", "yhat").limit(n)


def _auc_table(pairs: DataFrame, segments: int = 64) -> DataFrame:
    """Area under the ROC curve per `class` of (class, score, positive) rows, ties sharing their mean rank.

    Scores are counted first; ranks are running counts cut into score ranges, so one class is spread
    over many tasks.
    """
    grid = pairs.agg(F.percentile_approx("score", [i / segments for i in range(1, segments)], 1_000)).first()[0] or []
    counts = pairs.groupBy("class", "score").agg(F.count("*").alias("n"), F.count_if("positive").alias("pos"))
    ranked = running_sums(counts.withColumn("seg", bucket_index(F.col("score"), sorted(set(grid)))), ["class"], "seg", ["score"], {"cum": "n"})
    mean_rank = F.col("cum") - F.col("n") + (F.col("n") + 1) / 2.0
    sums = ranked.groupBy("class").agg(F.sum(mean_rank * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    neg = F.col("n") - F.col("p")
    return sums.select("class", F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.nullif(F.col("p") * neg, F.lit(0.0))).alias("auc"))


def roc_auc_per_class(df: DataFrame, scores: dict, y: str = "y") -> DataFrame:
    """One-vs-rest AUC; `scores` maps a class value to its score column."""
    cols = [F.struct(F.lit(k).alias("class"), F.col(c).cast("double").alias("score"), (F.col(y) == F.lit(k)).alias("positive")) for k, c in scores.items()]
    return _auc_table(df.select(F.inline(F.array(*cols))))


def roc_auc(df: DataFrame, scores: dict, y: str = "y") -> DataFrame:
    """Macro one-vs-rest AUC, or the plain AUC of the second class when there are two."""
    if len(scores) == 2:
        scores = dict(list(scores.items())[1:])
    return roc_auc_per_class(df, scores, y).agg(F.avg("auc").alias("roc_auc"))


def compare_models(df: DataFrame, y: str, models: dict[str, str]) -> DataFrame:
    """One row per model; `models` maps a model name to its prediction column. One scan for all."""
    cols = [F.struct(F.lit(m).alias("model"), F.col(c).alias("yhat")) for m, c in models.items()]
    long = df.select(F.col(y).alias("y"), F.inline(F.array(*cols)))
    return averages(long, by=["model"]).select("model", "accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro")


def comparison_long(table: DataFrame) -> DataFrame:
    return table.unpivot(["model"], ["accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro"], "metric", "value")


def metrics_document(df: DataFrame, model: str, names: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Model metrics as one nested row: overall averages, class labels, per-class entries."""
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("class").cast("int"))
    rows = per_class(df, y, yhat).select(F.struct(
        F.col("class").alias("code"), label.alias("class"), "precision", "recall", F.col("f1").alias("f1_score"), "support",
        quality_tag("f1").alias("quality")).alias("e"))
    entries = rows.agg(F.array_sort(F.collect_list("e")).alias("per_class_metrics"))
    overall = averages(df, y, yhat).select(F.struct("*").alias("overall_metrics"))
    one = F.lit(1).alias("_one")  # both sides are a single row
    return overall.select("*", one).join(entries.select("*", one), "_one").select(
        F.lit(model).alias("model_name"), "overall_metrics", F.array(*[F.lit(n) for n in names]).alias("class_labels"), "per_class_metrics")
