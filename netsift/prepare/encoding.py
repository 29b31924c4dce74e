"""Target, label, one-hot and hybrid encoding of categorical columns."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.functions.scaling import ordered_rank
from netsift.operators.profile import cardinalities, text_columns
from netsift.prepare.base import StateModel
from netsift.session import scratch_path


def _text(c: str):
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan"))


def _store(mapping: DataFrame, name: str) -> dict:
    """Keep a (category, value) mapping as a written table, whatever its size."""
    path = scratch_path(mapping.sparkSession, f"encoding-{name}")
    mapping.write.parquet(path)
    return {"table": path, "size": mapping.sparkSession.read.parquet(path).count()}


def _apply(df: DataFrame, c: str, stored: dict, default) -> DataFrame:
    """Replace column `c` by its mapped value, `default` for unseen categories. The optimizer knows the table's size."""
    side = df.sparkSession.read.parquet(stored["table"]).select(F.col("category").alias("_k"), F.col("value").alias("_v"))
    order = df.columns
    joined = df.withColumn("_c", _text(c)).join(side, F.col("_c") == F.col("_k"), "left")
    return joined.withColumn(c, F.coalesce("_v", F.lit(default))).select(*[f"`{x}`" for x in order])


def target_means(df: DataFrame, c: str, y: str, smoothing: float = 1.0, min_samples: int = 1, missing: bool = False) -> tuple[float, DataFrame]:
    """(global mean, (category, value)): category means pulled to the global mean by w = n / (n + smoothing).

    With `missing`, NULL is the category "nan" with a mean of its own; else it gets the global mean.
    """
    mean = df.agg(F.avg(F.col(y).cast("double"))).first()[0] or 0.0
    g = (df if missing else df.where(F.col(f"`{c}`").isNotNull())).groupBy(_text(c).alias("category")).agg(F.avg(F.col(y).cast("double")).alias("m"), F.count(y).alias("n"))
    w = F.col("n") / (F.col("n") + F.lit(float(smoothing)))
    return mean, g.select("category", F.when(F.col("n") >= min_samples, w * F.col("m") + (1 - w) * F.lit(mean)).otherwise(F.lit(mean)).alias("value"))


class TargetEncoder(Estimator):
    def __init__(self, column: str | None = None, target: str | None = None, smoothing: float = 1.0, min_samples: int = 1):
        super().__init__()
        self.column, self.target, self.smoothing, self.min_samples = column, target, smoothing, min_samples

    def _fit(self, df):
        mean, mapping = target_means(df, self.column, self.target, self.smoothing, self.min_samples)
        return TargetEncoderModel(column=self.column, mean=mean, mapping=_store(mapping, self.column))


class TargetEncoderModel(StateModel):
    def _transform(self, df):
        s = self.fitted
        return _apply(df, s["column"], s["mapping"], s["mean"])


def label_codes(df: DataFrame, c: str) -> DataFrame:
    """(category, value): codes 0.. in text order."""
    found = df.select(_text(c).alias("category")).distinct()
    return ordered_rank(found, ["category"], "value").withColumn("value", F.col("value") - 1)


class CategoricalEncoder(Estimator):
    """Strategies: label, onehot, target, hybrid. Hybrid sends listed columns to their list's encoding
    and the rest to target encoding above `threshold` distinct values, else to one-hot. `max_onehot` refuses
    more indicator columns than that; by default there is no bound."""

    def __init__(self, strategy: str = "hybrid", columns: list[str] | None = None, target: str | None = None, target_columns: list[str] = (),
                 onehot_columns: list[str] = (), threshold: int = 10, passthrough: list[str] = (), max_onehot: int | None = None):
        super().__init__()
        if strategy not in ("label", "onehot", "target", "hybrid"):
            raise ValueError(f"unknown encoding strategy: {strategy}")
        self.strategy, self.columns, self.target = strategy, columns, target
        self.target_columns, self.onehot_columns, self.threshold, self.passthrough = list(target_columns), list(onehot_columns), threshold, list(passthrough)
        self.max_onehot = max_onehot

    def _fit(self, df):
        skip = {*self.passthrough, self.target}
        cols = [c for c in (self.columns if self.columns is not None else text_columns(df)) if c in df.columns and c not in skip]
        if cols and self.strategy in ("target", "hybrid") and self.target is None:
            raise ValueError(f"a target column is required for {self.strategy} encoding")
        label, onehot, target = [], [], []
        if self.strategy == "label":
            label = cols
        elif self.strategy == "onehot":
            onehot = cols
        elif self.strategy == "target":
            target = cols
        else:
            open_cols = [c for c in cols if c not in self.target_columns and c not in self.onehot_columns]
            sizes = {r["column_name"]: r["distinct_values"] for r in cardinalities(df, open_cols).collect()} if open_cols else {}
            for c in cols:
                explicit_target = c in self.target_columns
                auto_target = c not in self.onehot_columns and sizes.get(c, 0) > self.threshold
                (target if explicit_target or auto_target else onehot).append(c)
        maps = {}
        for c in target:
            mean, mapping = target_means(df, c, self.target, missing=True)
            maps[c] = {"mean": mean, "mapping": _store(mapping, c)}
        codes = {c: _store(label_codes(df, c), c) for c in label}
        values = {}
        if onehot:
            long = df.select(*[_text(c).alias(c) for c in onehot]).unpivot([], onehot, "c", "v").distinct()
            head = (long if self.max_onehot is None else long.limit(self.max_onehot + 1)).collect()  # each is a column to be
            if self.max_onehot is not None and len(head) > self.max_onehot:
                raise ValueError(f"one-hot encoding of {onehot} needs more than {self.max_onehot} columns: use target encoding")
            values = {c: sorted(r["v"] for r in head if r["c"] == c) for c in onehot}
        return CategoricalEncoderModel(target=maps, label=codes, onehot=values)


class CategoricalEncoderModel(StateModel):
    def onehot_names(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.fitted["onehot"].items() for v in vs[1:]]

    def _transform(self, df):
        s = self.fitted
        for c, t in s["target"].items():
            if c in df.columns:
                df = _apply(df, c, t["mapping"], t["mean"])
        for c, t in s["label"].items():
            if c in df.columns:
                df = _apply(df, c, t, 0)
        hot = {c: v for c, v in s["onehot"].items() if c in df.columns}
        if hot:
            rest = [F.col(f"`{x}`") for x in df.columns if x not in hot]
            flags = [F.when(_text(c) == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for c, vs in hot.items() for v in vs[1:]]
            df = df.select(*rest, *flags)
        return df

    def report(self, spark) -> DataFrame:
        s = self.fitted
        rows = [(c, "target", t["mapping"]["size"]) for c, t in s["target"].items()]
        rows += [(c, "label", t["size"]) for c, t in s["label"].items()]
        rows += [(c, "onehot", len(self.onehot_names())) for c in s["onehot"]]
        return spark.createDataFrame(rows, "column_name string, encoding_type string, num_categories int")
