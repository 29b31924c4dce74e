"""Importance resampling towards a target distribution, with an exact cut by weighted medians of medians.

Features are runs of 1 to `grams` consecutive words, hashed into `buckets`. A bucket's gain is the scaled logarithm of
its share in the target's features over its share in the documents'; a document's weight is the sum of its features'
gains, an array look-up and a sum. A Gumbel draw from the doc_id is added, so the highest scores are a sample without
replacement in proportion to the exponential of the weights.

`cutoff` finds the key of the last row drawn without sorting: every task gives the median of its remaining keys and
their number; the median of these medians, weighted by the numbers, has at least a quarter of the remaining keys on
either side, so every round discards a quarter at least, until the key itself is found. Rounds are logarithmic in the
rows, and once an eighth of the rows read remains they are written anew, so all rounds together read the keys a
bounded number of times. Only the winners are sorted.

The driver holds the counts of the buckets (`buckets` rows) and one median for GROUP keys or a task.

Edge cases: a null text has no words; a document without features has weight 0; a null doc_id draws by the empty
text and comes after all others in ties; rows that repeat doc_id and text are drawn each for itself (their order among
themselves is the written one); an empty target or table gives gains by the formula, and an empty result for an empty
table. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netsift.llm.common import materialize, text_or_empty

GROUP = 1 << 20  # keys that a task holds at once
CACHED, CACHED_BYTES = 400_000, 48  # features a task remembers the bucket of, and their length at most
LAST = (1 << 63) - 1
#: digits, letters (lower-cased) and all bytes of other characters stay, all else separates words
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Buckets(dict):
    """The bucket of a feature."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(feature) <= CACHED_BYTES and len(self) < CACHED:
            self[feature] = found
        return found


def bucketed(text: bytes, grams: int, known: Buckets) -> tuple[int, np.ndarray]:
    """The number of words, and the buckets of all features."""
    words = text.translate(WORDS).split()
    features = [words] + [list(map(b" ".join, zip(*(words[i:] for i in range(g))))) for g in range(2, grams + 1)]
    return len(words), np.concatenate([np.fromiter(map(known.__getitem__, f), np.uint32, len(f)) for f in features])


def features(docs: DataFrame, grams: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, buckets binary, of 32-bit numbers, or of 16-bit ones if they suffice)."""
    dtype = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for batch in batches:
            found = [bucketed(t, grams, known) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()),
                                   pa.array([b.astype(dtype).tobytes() for _, b in found], pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, buckets binary")


def counts(featured: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs, one row of counts at most for a bucket and a task."""
    dtype = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in featured.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # `buckets` rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    s_all, t_all, buckets = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(scale * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: str, scale: int = 1000) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(featured: DataFrame, gain: np.ndarray, seed: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score)."""
    dtype = np.dtype("<u2" if len(gain) <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.array([int(gain[np.frombuffer(b, dtype)].sum()) for b in batch.column(3).to_pylist()], np.int64)
            drawn = np.array([gumbel(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.record_batch([*batch.columns[:3], pa.array(weight), pa.array(weight + drawn)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return featured.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


Key = tuple[int, int, int, int]  # in rising order: the negative score, the doc_id, the number of features, the row


def _parts() -> list[Column]:
    return [-F.col("score"), F.coalesce("doc_id", F.lit(LAST)), F.col("n_features"), F.col("row")]


def _before(key: Key, or_at: bool = False) -> Column:
    """Whether a row's key is smaller than `key`."""
    found = F.lit(or_at)
    for part, value in reversed(list(zip(_parts(), key))):
        found = (part < F.lit(value)) | ((part == F.lit(value)) & found)
    return found


def _within(columns: list[np.ndarray], key: Key) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a smaller key, and which a larger one."""
    less, equal = np.zeros(len(columns[0]), bool), np.ones(len(columns[0]), bool)
    for column, value in zip(columns, key):
        less |= equal & (column < value)
        equal &= column == value
    return less, ~less & ~equal


def medians(keys: DataFrame, low: Key | None, high: Key | None, pivot: Key | None) -> list[tuple[int, int, Key]]:
    """(side, number, median) of groups of the keys between `low` and `high`; side 1 has those after `pivot`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        held: list[list[list[np.ndarray]]] = [[], []]

        def close(side: int) -> None:
            own = [np.concatenate(c) for c in zip(*held[side])]
            held[side] = []
            if own and len(own[0]):
                middle = np.lexsort(own[::-1])[(len(own[0]) - 1) // 2]
                found.append((side, len(own[0]), *(int(c[middle]) for c in own)))

        for batch in batches:
            columns = [np.asarray(c).astype(np.int64) for c in batch.columns]
            stays = np.ones(batch.num_rows, bool)
            if low is not None:
                stays &= _within(columns, low)[1]
            if high is not None:
                stays &= _within(columns, high)[0]
            columns = [c[stays] for c in columns]
            sides = [np.ones(len(columns[0]), bool)] if pivot is None else _within(columns, pivot)
            for side, own in enumerate(sides):
                if own.any():
                    held[side].append([c[own] for c in columns])
                    if sum(len(c[0]) for c in held[side]) >= GROUP:
                        close(side)
        close(0)
        close(1)
        yield pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in range(6)], names=["side", "n", "a", "b", "c", "d"])

    out = keys.select(*[p.alias(name) for p, name in zip(_parts(), "abcd")]).mapInArrow(run, "side long, n long, a long, b long, c long, d long")
    return [(r[0], r[1], (r[2], r[3], r[4], r[5])) for r in out.collect()]  # one row for a task and side, or for GROUP keys


def cutoff(keys: DataFrame, k: int) -> Key:
    """The key of rank k (from 1) among `keys` (score, doc_id, n_features, row), which has k rows at least."""
    low = high = pivot = None
    read = None
    while True:
        found = medians(keys, low, high, pivot)
        sizes = [sum(n for side, n, _ in found if side == s) for s in (0, 1)]
        if pivot is None:
            side, read = 0, sizes[0]
        elif k <= sizes[0]:
            side, high = 0, pivot
        elif k == sizes[0] + 1:
            return pivot
        else:
            side, low, k = 1, pivot, k - sizes[0] - 1
        ours = sorted((key, n) for s, n, key in found if s == side)
        passed = 0
        for key, n in ours:
            passed += n
            if 2 * passed >= sizes[side]:
                pivot = key
                break
        if sizes[side] * 8 <= read:
            rest = keys if low is None else keys.filter(~_before(low, or_at=True))
            keys = materialize(rest if high is None else rest.filter(_before(high)), "remaining-keys")
            read = sizes[side]


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` with their rank from 1 in `order`: sorted over all tasks, numbered inside each, with the tasks before it added."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "sorted")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row for a task of the sort
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_base"))
    return (dealt.withColumn("_part", part).join(F.broadcast(sizes), "_part")
            .withColumn("rank", (F.col("_base") + at + 1).cast("long")).drop("_part", "_base", "_at"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, grams: int = 1, buckets: int = 10_000, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; of those with `least_words` words, `percent` of a hundred have a rank."""
    featured = materialize(features(docs, grams, buckets), "features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), grams, buckets)
    gain = gains(counts(featured, buckets), counts(wanted, buckets))
    rows = materialize(scored(featured, gain, seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    fit = rows.filter(F.col("n_words") >= least_words)
    k = percent * fit.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & _before(cutoff(fit.select("score", "doc_id", "n_features", "row"), k), or_at=True)
    winners = ranked(rows.filter(drawn), _parts())
    return winners.select(*columns, "rank").unionByName(rows.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
