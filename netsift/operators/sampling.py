"""Sampling, de-duplication, splitting, class codes and class weights.

Every "take n of this class" is a cut in hash order (functions.scaling.hash_first), so results repeat
exactly and no class, however large, is sorted at all but for the hash bucket of the cut.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift import schema as S
from netsift.functions.cleaning import is_attack, is_normal, sizing_category
from netsift.session import materialize
from netsift.functions.scaling import hash_first, hash_rank, lookup, order_hash


def with_hash(df: DataFrame, key: list[str], seed: int = 42, out: str = "order_hash") -> DataFrame:
    return df.withColumn(out, order_hash(*key, seed=seed))


def cap_classes(df: DataFrame, col: str, key: list[str], caps: dict[str, int] | None = None, seed: int = 42) -> DataFrame:
    """At most `caps[class]` rows of each listed class; other classes stay whole."""
    caps = S.CLASS_CAPS if caps is None else caps
    limit = F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(int(v)))])
    return hash_first(with_hash(df, key, seed, "_h"), "_h", F.element_at(limit, F.col(col)), [col]).drop("_h")


def normal_target(df: DataFrame, ratio: float = 0.5, offset: int = 5_000, category: str | None = "attack_cat") -> int:
    """How many normal rows go with the attacks of `df`."""
    attacks = df.where(is_attack())
    total = max(1, int(attacks.count() * ratio) - offset)
    if category is None or category not in df.columns:
        return total
    top = attacks.groupBy(sizing_category(category).alias("c")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return total if top is None else min(total, max(1, top - offset))


def attack_normal_subset(df: DataFrame, key: list[str], ratio: float = 0.5, offset: int = 5_000, seed: int = 42,
                         category: str | None = "attack_cat") -> DataFrame:
    """All attacks plus a seeded sample of normals, in shuffled order (`shuffle_rank`)."""
    n = normal_target(df, ratio, offset, category)
    normals = hash_first(with_hash(df.where(is_normal()), key, seed, "_h"), "_h", F.lit(n)).drop("_h")
    return shuffle(df.where(is_attack()).unionByName(normals), key, seed)


def shuffle(df: DataFrame, key: list[str], seed: int = 42, out: str = "shuffle_rank") -> DataFrame:
    """Seeded shuffle: a repeatable random position for every row. Sort by `out` where order matters."""
    return hash_rank(with_hash(df, key, seed, "_h"), "_h", out=out, ties=list(key)).drop("_h")


def drop_duplicates(df: DataFrame, features: list[str], order: str) -> DataFrame:
    """One row per distinct feature tuple: the first in `order`, with its other columns.

    A mergeable minimum replaces a window, so a tuple that makes up much of the table collapses
    before the shuffle.
    """
    rest = [c for c in df.columns if c not in features]
    first = df.groupBy(*features).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*[F.col(c) if c in features else F.col(f"_first.{c}").alias(c) for c in df.columns])


def _allocate(counts: DataFrame, col: str, total: int, draws: int, out: str, size: str = "n") -> DataFrame:
    """Split `draws` over classes in proportion to `size`: floors plus largest remainders."""
    share = F.col(size) * F.lit(float(draws)) / F.lit(float(total))
    w = Window.orderBy(F.desc("_rem"), col)
    left = F.lit(draws) - F.sum("_base").over(Window.partitionBy())
    return (
        counts.withColumn("_base", F.floor(share).cast("long")).withColumn("_rem", share - F.floor(share))
        .withColumn(out, F.col("_base") + (F.row_number().over(w) <= left).cast("long"))
        .drop("_base", "_rem")
    )


def stratified_split(df: DataFrame, col: str, key: list[str], test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `split` (train / test): ceil(fraction * n) test rows, shared over classes by largest remainder."""
    counts = materialize(df.groupBy(col).agg(F.count("*").alias("n")), "class-counts")
    n = counts.agg(F.sum("n")).first()[0] or 0
    quota = _allocate(counts, col, max(n, 1), n - math.ceil(test_fraction * n), "_train")
    ranked = hash_rank(with_hash(df, key, seed, "_h"), "_h", [col], "_r")
    return (
        lookup(ranked, quota.select(col, "_train"), [col])
        .withColumn("split", F.when(F.col("_r") <= F.col("_train"), "train").otherwise("test"))
        .drop("_h", "_r", "_train")
    )


def three_way_split(df: DataFrame, col: str, key: list[str], seed: int = 42) -> DataFrame:
    """40 / 20 / 40 train, val and test. Classes under three rows are pooled as RARE for the quotas;
    a pool of a single row is dropped."""
    sizes = df.groupBy(col).agg(F.count("*").alias("_size"))
    pooled = lookup(df, sizes, [col]).withColumn("_strat", F.when(F.col("_size") < 3, "RARE").otherwise(F.col(col))).drop("_size")
    counts = materialize(pooled.groupBy("_strat").agg(F.count("*").alias("n")), "class-counts")
    counts = counts.where(~((F.col("_strat") == "RARE") & (F.col("n") < 2)))
    n = counts.agg(F.sum("n")).first()[0] or 0
    n_tmp = math.ceil(0.6 * n)
    n_test = math.ceil(n_tmp * 2 / 3)
    quota = _allocate(counts, "_strat", max(n, 1), n - n_tmp, "_train").withColumn("_rest", F.col("n") - F.col("_train"))
    quota = _allocate(quota, "_strat", max(n_tmp, 1), n_tmp - n_test, "_val", "_rest")
    ranked = hash_rank(with_hash(pooled, key, seed, "_h"), "_h", ["_strat"], "_r")
    return (
        lookup(ranked, quota.select("_strat", "_train", "_val"), ["_strat"], "inner")
        .withColumn("split", F.when(F.col("_r") <= F.col("_train"), "train")
                    .when(F.col("_r") <= F.col("_train") + F.col("_val"), "val").otherwise("test"))
        .drop("_h", "_r", "_train", "_val", "_strat")
    )


def class_codes(df: DataFrame, col: str, first_by: str | None = None) -> DataFrame:
    """(class, code): codes by first appearance along `first_by`, or alphabetical."""
    if first_by:
        seen = df.groupBy(col).agg(F.min(first_by).alias("_o"))
        w = Window.orderBy("_o")
    else:
        seen = df.select(col).distinct()
        w = Window.orderBy(col)
    return seen.select(col, (F.row_number().over(w) - 1).alias("code"))


def encode_classes(df: DataFrame, col: str, codes: DataFrame, out: str = "target") -> DataFrame:
    return lookup(df, codes.select(col, F.col("code").alias(out)), [col])


def undersample(df: DataFrame, col: str, key: list[str], seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest one."""
    smallest = df.groupBy(col).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    return hash_first(with_hash(df, key, seed, "_h"), "_h", F.lit(smallest), [col]).drop("_h")


def balanced_weights(df: DataFrame, col: str, out: str = "weight") -> DataFrame:
    """Row weight n / (classes * class count). The weights, one row per class, are broadcast: a shuffle by class would
    put a class into one task."""
    counts = df.groupBy(col).agg(F.count("*").alias("_n"))
    every = Window.partitionBy()
    weights = counts.select(col, (F.sum("_n").over(every) / (F.count("*").over(every) * F.col("_n"))).alias(out))
    return lookup(df, F.broadcast(weights), [col])
