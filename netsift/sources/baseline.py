"""A stored drift baseline: counts of distinct values and categories, written once and merged with those of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift import schema as S
from netsift.operators import drift as I

PARTS = {"values": ["feature", "x"], "categories": ["feature", "category"]}
SCHEMAS = {"values": "feature string, x double, n long", "categories": "feature string, category string, n long"}


def _counted(prepared: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    numeric, text = [c for c in columns if c not in S.DRIFT_CATEGORICAL], [c for c in columns if c in S.DRIFT_CATEGORICAL]
    none = prepared.sparkSession.createDataFrame
    return {"values": I.count_values(prepared, numeric) if numeric else none([], SCHEMAS["values"]),
            "categories": I.count_categories(prepared, text) if text else none([], SCHEMAS["categories"])}


def _write(spark: SparkSession, columns: list[str], parts: dict[str, DataFrame], path: str) -> str:
    spark.createDataFrame(list(enumerate(columns)), "position int, name string").coalesce(1).write.parquet(f"{path}/columns")
    for name, part in parts.items():
        part.write.parquet(f"{path}/{name}")
    return path


def store(df: DataFrame, path: str) -> str:
    """Count a table of flows once; `path` must be new."""
    prepared = I.prepare(df)
    return _write(df.sparkSession, prepared.columns, _counted(prepared, prepared.columns), path)


def columns_of(spark: SparkSession, path: str) -> list[str]:
    return [r["name"] for r in spark.read.parquet(f"{path}/columns").orderBy("position").collect()]  # one row per column


def extend(df: DataFrame, path: str, new_path: str) -> str:
    """The baseline of the rows of `path` and of `df` together, at a new path: counts are added, no old row is read."""
    spark, columns = df.sparkSession, columns_of(df.sparkSession, path)
    missing = [c for c in columns if c not in I.prepare(df).columns]
    if missing:
        raise ValueError(f"columns of the baseline that the rows lack: {', '.join(missing)}")
    more = _counted(I.prepare(df), columns)
    parts = {name: spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}").unionByName(more[name]).groupBy(*by).agg(F.sum("n").alias("n")) for name, by in PARTS.items()}
    return _write(spark, columns, parts, new_path)


def compare(path: str, live: DataFrame) -> DataFrame:
    """The rows of operators.drift.compare_features for a batch against the stored baseline."""
    spark, prepared = live.sparkSession, I.prepare(live)
    shared = [c for c in columns_of(spark, path) if c in prepared.columns]
    more = _counted(prepared, shared)
    numeric, text = [c for c in shared if c not in S.DRIFT_CATEGORICAL], [c for c in shared if c in S.DRIFT_CATEGORICAL]
    both = {name: I.merged_sides(spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}").where(F.col("feature").isin(*shared)), more[name], by) for name, by in PARTS.items()}
    results = ([I.numeric_results_of(I.value_table_of(both["values"], numeric))] if numeric else []) + ([I.categorical_results_of(both["categories"], text)] if text else [])
    return results[0] if len(results) == 1 else results[0].unionByName(results[1])
