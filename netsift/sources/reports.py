"""Report sinks: one-row documents as JSON, ranked tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_document(doc: DataFrame, path: str) -> None:
    """A nested report (a handful of rows) as JSON."""
    doc.coalesce(1).write.mode("overwrite").json(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema is not None else spark.read.json(path)


def write_ranked_csv(report: DataFrame, path: str, by: str = "risk_score") -> None:
    """A per-feature report (one row per feature) as one CSV, highest `by` first."""
    report.coalesce(1).sortWithinPartitions(report[by].desc(), "feature").write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
