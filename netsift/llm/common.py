"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netsift.session import materialize, scratch_path  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def power_of_two(n: float) -> int:
    """The smallest power of two that is at least n (1 at least)."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, n))))


def rank_in_groups(df: DataFrame, key: str, order: list[str], spread: Column, name: str = "rank") -> DataFrame:
    """`df` with a gapless rank from 0 inside each group of `key`, however large a group is.

    A group is dealt over `spread` (one number per group) hash buckets of the `order` columns. A window numbers
    the rows of a bucket, and the counts of the buckets before it are added. The rank is a fixed numbering, not the
    order of the `order` columns; rows that agree in all of them are interchangeable.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), spread).cast("int"))
    sizes = dealt.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(key, "_bucket").orderBy(*order)
    return (dealt.withColumn("_in", F.row_number().over(within) - 1).join(sizes, [key, "_bucket"])
            .withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_bucket", "_in", "_base"))
