"""Exact deduplication with a sharded, persistent index of live digests.

The digests of a corpus are dealt over shards. A shard holds a cuckoo filter of its live digests and, beside it,
the bucketed content: one stored key per live digest (SHA-256 of the normalised text) with the document that
stays and the number of copies. A digest that the filter doesn't know is new and needs no lookup. A hit is
verified against the stored keys. A copy with a larger doc_id takes the place of the live one: the live digest
is deleted, the new one inserted. A filter that overflows is rebuilt at twice the size from the stored keys.

Edge cases: a null text is the empty text; the empty text is a text like any other; a null doc_id is smaller
than any other; rows that repeat both doc_id and text are one row for `kept` (all say the same) and count one by
one in `group_size`. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm.common import materialize, power_of_two, scratch_path, text_or_empty
from netsift.llm.cuckoo import CuckooFilter, Overflow

_GROUP = "shard int, digest binary, keep_id long, copies long"
_DIGESTED = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])
_COPIES = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("copies", pa.int64())])


def _larger(a: int | None, b: int | None) -> bool:
    return a is not None and (b is None or a > b)


class LiveDigests:
    """The live digests of one shard: cuckoo filter in front, stored keys behind it."""

    def __init__(self, stored: dict[bytes, list] | None = None, filter_: CuckooFilter | None = None, expect: int = 0):
        self.stored = stored if stored is not None else {}
        self.filter = filter_ or CuckooFilter.for_keys(max(expect, len(self.stored), 64))
        self.resized = 0
        if filter_ is None and self.stored:
            self._rebuild(self.filter.n_buckets)

    @staticmethod
    def key(digest: bytes) -> int:
        return int.from_bytes(digest[8:16], "little")

    def _rebuild(self, buckets: int) -> None:
        while True:
            self.filter = CuckooFilter(buckets)
            try:
                for digest in self.stored:
                    self.filter.insert(self.key(digest))
                return
            except Overflow:
                buckets *= 2

    def _enter(self, digest: bytes) -> None:
        try:
            self.filter.insert(self.key(digest))
        except Overflow:
            self.resized += 1
            self._rebuild(self.filter.n_buckets * 2)

    def add(self, digest: bytes, doc_id: int | None, copies: int = 1) -> None:
        """Enter `copies` documents with this digest, the largest of which is doc_id."""
        live = self.stored.get(digest) if self.key(digest) in self.filter else None  # only hits are looked up
        if live is None:
            self.stored[digest] = [doc_id, copies]
            self._enter(digest)
            return
        live[1] += copies
        if _larger(doc_id, live[0]):
            self.filter.delete(self.key(digest))
            live[0] = doc_id
            self._enter(digest)

    def remove(self, digest: bytes) -> bool:
        """Take a digest out of the index; False if it isn't live."""
        if self.key(digest) not in self.filter or digest not in self.stored:
            return False
        self.filter.delete(self.key(digest))
        del self.stored[digest]
        return True


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row: SHA-256 of the text with A-Z lower-cased, in UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([hashlib.sha256(t.lower()).digest() for t in texts], pa.binary())], schema=_DIGESTED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, digest binary")


def _collapsed(rows: DataFrame, most: int) -> DataFrame:
    """Copies inside each partition made one row (digest, keep_id, copies), so that no digest is hot in the shuffle.

    At most `most` live digests are held; then they are emitted and the index starts anew.
    """

    def emit(index: LiveDigests) -> pa.RecordBatch:
        live = index.stored
        return pa.record_batch([pa.array(live.keys(), pa.binary()), pa.array([v[0] for v in live.values()], pa.int64()), pa.array([v[1] for v in live.values()], pa.int64())], schema=_COPIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LiveDigests(expect=4096)
        for batch in batches:
            for doc_id, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index.add(digest, doc_id)
            if len(index.stored) >= most:
                yield emit(index)
                index = LiveDigests(expect=4096)
        if index.stored:
            yield emit(index)

    return rows.mapInArrow(run, "digest binary, keep_id long, copies long")


class ExactIndex:
    """The index in the folder `path`, as generations of two tables: stored keys and one filter per shard.

    Every change writes a new generation and then names it as the current one; a change that is lost half way
    leaves the previous generation in place. `shards` is fixed when the index is made; give it so that a shard
    (the unit of memory) keeps some 50,000 digests.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 256):
        self.spark, self.path, self.shards, self.generation = spark, path.rstrip("/"), shards, 0

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self.generation:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.generation}/{name}")

    def stored(self) -> DataFrame:
        return self._read("stored", _GROUP)

    def filters(self) -> DataFrame:
        return self._read("filters", "shard int, used long, slots binary")

    def _shard(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int"))

    def _change(self, incoming: DataFrame) -> None:
        """Apply rows (digest, keep_id, copies); copies 0 takes the digest out."""

        def apply(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            keys = old[old["slots"].isnull()]
            stored = {d: [None if pd.isna(k) else int(k), int(c)] for d, k, c in zip(keys["digest"], keys["keep_id"], keys["copies"])}
            saved = old[old["slots"].notnull()]
            filter_ = CuckooFilter.from_bytes(saved["slots"].iloc[0], len(stored)) if len(saved) else None
            index = LiveDigests(stored, filter_, expect=len(stored) + len(new))
            for digest, doc_id, copies in zip(new["digest"], new["keep_id"], new["copies"]):
                if copies:
                    index.add(digest, None if pd.isna(doc_id) else int(doc_id), int(copies))
                else:
                    index.remove(digest)
            shard = int((new["shard"] if len(new) else old["shard"]).iloc[0])
            out = pd.DataFrame({"shard": shard, "digest": list(index.stored), "keep_id": pd.array([v[0] for v in index.stored.values()], dtype="Int64"),
                                "copies": [v[1] for v in index.stored.values()]})
            out["slots"] = None
            return pd.concat([out, pd.DataFrame({"shard": [shard], "keep_id": pd.array([None], dtype="Int64"), "copies": [index.filter.used], "slots": [index.filter.to_bytes()]})])

        state = (self.stored().select("shard", "digest", "keep_id", "copies", F.lit(None).cast("binary").alias("slots"))
                 .unionByName(self.filters().select("shard", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("keep_id"), F.col("used").alias("copies"), "slots")))
        changed = materialize(state.groupBy("shard").cogroup(self._shard(incoming).groupBy("shard"))
                              .applyInPandas(apply, _GROUP + ", slots binary"), "exact-index")
        target = f"{self.path}/{self.generation + 1}"
        changed.filter("slots is null").drop("slots").write.mode("overwrite").parquet(f"{target}/stored")
        changed.filter("slots is not null").select("shard", F.col("copies").alias("used"), "slots").write.mode("overwrite").parquet(f"{target}/filters")
        self.generation += 1

    def ingest(self, rows: DataFrame, most_local: int = 200_000) -> None:
        """Enter rows (doc_id, digest)."""
        self._change(_collapsed(rows, most_local))

    def remove(self, digest_rows: DataFrame) -> None:
        """Take the digests of `digest_rows` (digest) out of the index."""
        gone = digest_rows.select("digest").groupBy("digest").agg(F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("copies"))
        self._change(gone)


def exact_duplicates(docs: DataFrame, per_shard: int = 50_000, least_shards: int = 256) -> DataFrame:
    """One row per document: the row of its group of equal texts that stays, and the size of the group."""
    spark = docs.sparkSession
    rows = materialize(digests(docs), "digests")
    shards = max(least_shards, power_of_two(rows.count() / per_shard))
    index = ExactIndex(spark, scratch_path(spark, "live-digests"), shards)
    index.ingest(rows)
    live = index.stored().select("digest", "keep_id", F.col("copies").alias("group_size"))
    return (rows.join(live, "digest")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))
