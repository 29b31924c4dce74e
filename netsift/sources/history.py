"""Drift history: an append-only table of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.sources.flows import exists

SCHEMA = "timestamp string, overall_score double, overall_severity string, trend string, batch_size long, feature_count long, drift_count long, severe_count long"


def append(record: DataFrame, path: str) -> None:
    """Add assessment rows (one per batch)."""
    record.coalesce(1).write.mode("append").json(path)


def load(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The newest `limit` entries, oldest first; malformed lines are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = rows.where("timestamp is not null and _bad is null").drop("_bad")
    return good.orderBy(F.desc("timestamp")).limit(limit).orderBy("timestamp")


def has_batch(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Whether an assessment of this micro-batch is in the history."""
    if not exists(spark, path):
        return False
    return not spark.read.schema("batch_id long").json(path).where(F.col("batch_id") == batch_id).isEmpty()


def last(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, 1)
