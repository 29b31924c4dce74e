"""Exact top-k inner products by distributed histogram selection.

Queries are worked on in blocks of bounded size, each against all rows. Every pass scores the whole block against
every row. The first passes count scores in histograms per query, coarse over the whole range of possible scores,
then finer inside the one bin that holds the k-th value, until a bin is a single score. The last pass gives the
rows above a query's k-th score and, of those equal to it, the ones with the smallest ids.

A task leaves out the bins below the one of its own k-th score: the k-th score over all rows can't be lower.
Histograms are summed by Spark; per query only the bin of the k-th value comes to the driver, for one block.

Edge cases: vectors that are null or hold a null or non-finite component take no part, neither as query nor as row;
a null id takes no part; vectors of different lengths are compared as if filled with zeros; a row whose id equals
the query's is never its result; a row that is repeated is a result as often as it is there, and a query for each time
(its results come as often, each with its own ranks); with fewer than k rows all are results; components whose scores
would not fit 64 bits raise an error; no queries or no rows give no results. Columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netsift.llm.common import materialize, scratch_path

BINS = 256
_HISTOGRAM = pa.schema([("q", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])
_RESULT = pa.schema([("q", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of every component, only of vectors that can take part."""
    usable = F.col(vector_column).isNotNull() & F.col(id_column).isNotNull() & ~F.exists(
        vector_column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))

    def whole(x: Column) -> Column:
        scaled = F.lit(scale) * x.cast("double")
        return F.when(F.abs(scaled) < 2.0**62, F.floor(scaled)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits"))).cast("long")

    return vectors.filter(F.coalesce(usable, F.lit(False))).select(
        F.col(id_column).cast("long").alias("vec_id"), F.transform(vector_column, whole).alias("v"))


@dataclass
class Block:
    """Queries of one block with what is known of their k-th score: it lies in [low, high), cut in bins of `width`."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    width: np.ndarray
    need: np.ndarray  # how many results are still wanted from that range


def _matrix(column: pa.Array, dims: int, dtype) -> np.ndarray:
    lists = column if not isinstance(column, pa.ChunkedArray) else column.combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(sizes), dims), dtype)
    values = np.asarray(lists.flatten())
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = values
    return out


def _scored(batches: Iterator[pa.RecordBatch], block: Block, dims: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores queries x rows as int64) for slices of the rows; a query's own row scores the least number."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            ids = np.asarray(part.column(0))
            scores = (block.vectors @ _matrix(part.column(1), dims, block.vectors.dtype).T).astype(np.int64)
            scores[block.ids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
            yield ids, scores


def _histograms(rows: DataFrame, block: Block, dims: int, k: int, slice_rows: int) -> DataFrame:
    """(q, bin, n): bins of all rows from the bin of a task's own k-th score upwards."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        total = np.zeros((len(b.ids), BINS), np.int64)
        for _, scores in _scored(batches, b, dims, slice_rows):
            for q in range(0, len(b.ids), 256):
                s, low = scores[q:q + 256], b.low[q:q + 256, None]
                row, col = np.nonzero((s >= low) & (s < b.high[q:q + 256, None]))
                flat = row * BINS + (s[row, col] - b.low[q + row]) // b.width[q + row]
                total[q:q + 256] += np.bincount(flat, minlength=len(s) * BINS).reshape(len(s), BINS)
        above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total  # in higher bins of this task
        q, bins = np.nonzero((total > 0) & (above < b.need[:, None]))
        yield pa.record_batch([pa.array(q.astype(np.int32)), pa.array(bins.astype(np.int32)), pa.array(total[q, bins])], schema=_HISTOGRAM)

    return rows.mapInArrow(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _narrow(found: DataFrame, block: Block) -> None:
    """Set every query's range to the bin that holds its k-th score."""
    higher = F.coalesce(F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = found.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(block.need)], "q int, need long")
    ranked = found.withColumn("higher", higher).join(F.broadcast(wanted), "q")  # one row for each query of the block
    at = ranked.filter("higher < need").groupBy("q").agg(F.min_by(F.struct("bin", "higher"), "bin").alias("b")).select("q", "b.*").toPandas()
    q, bins = at["q"].to_numpy(), at["bin"].to_numpy().astype(np.int64)
    block.low[q] += bins * block.width[q]
    block.high[q] = np.minimum(block.high[q], block.low[q] + block.width[q])
    block.need[q] -= at["higher"].to_numpy().astype(np.int64)
    block.width = np.maximum(1, -(-block.width // BINS))


def _selected(rows: DataFrame, block: Block, dims: int, slice_rows: int) -> DataFrame:
    """Rows above the k-th score and, from each task, the smallest ids of those equal to it."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        tied: dict[int, np.ndarray] = {}
        for ids, scores in _scored(batches, b, dims, slice_rows):
            q, r = np.nonzero(scores > b.low[:, None])
            yield pa.record_batch([pa.array(q, pa.int32()), pa.array(b.ids[q]), pa.array(ids[r]), pa.array(scores[q, r])], schema=_RESULT)
            q, r = np.nonzero(scores == b.low[:, None])
            cuts = np.flatnonzero(np.diff(q)) + 1
            for own, some in zip(q[np.append([0], cuts)] if len(q) else [], np.split(ids[r], cuts)):
                some = np.concatenate([tied[own], some]) if own in tied else some
                tied[own] = np.partition(some, b.need[own] - 1)[:b.need[own]] if len(some) > b.need[own] else some
        for own, some in tied.items():
            yield pa.record_batch([pa.array(np.full(len(some), own, np.int32)), pa.array(np.full(len(some), b.ids[own])), pa.array(some), pa.array(np.full(len(some), b.low[own]))], schema=_RESULT)

    return rows.mapInArrow(run, "q int, query_id long, vec_id long, score long")


def _blocks(queries: DataFrame, size: int) -> Iterator[list]:
    block = []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, block_size: int = 4096, slice_rows: int = 512) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k best rows of each row of `vectors` (vec_id, v) that is a query.

    A block of `block_size` queries is what the driver and a task hold at once.
    """
    spark = vectors.sparkSession
    rows = materialize(vectors, "vectors")
    facts = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    dims, most = facts[0] or 0, facts[1] or 0
    if dims * most * most >= 2**63:
        raise ValueError(f"components up to {most} give scores beyond 64 bits")
    # sums below 2**53 are exact as doubles, whose product is the fast one
    dtype = np.float64 if dims * most * most < 2**53 else np.int64
    out = scratch_path(spark, "top-k")
    spark.createDataFrame([], "q int, query_id long, vec_id long, score long").write.parquet(f"{out}/block=-1")
    for number, block_rows in enumerate(_blocks(rows.filter(is_query), block_size)):
        v = np.zeros((len(block_rows), dims), dtype)
        for i, r in enumerate(block_rows):
            v[i, :len(r["v"])] = r["v"]
        bound = np.abs(v).sum(axis=1).astype(np.int64) * most + 1
        block = Block(np.array([r["vec_id"] for r in block_rows], np.int64), v, -bound, bound + 1, -(-(2 * bound + 1) // BINS), np.full(len(v), k, np.int64))
        single = False
        while not single:
            single = bool((block.width == 1).all())
            _narrow(_histograms(rows, block, dims, k, slice_rows), block)
        _selected(rows, block, dims, slice_rows).write.parquet(f"{out}/block={number}")
    ranked = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    return (spark.read.schema("q int, query_id long, vec_id long, score long, block int").parquet(out)
            .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
