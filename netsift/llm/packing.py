"""Packing of tokenised documents into sequences of a fixed capacity, by cutting stock.

A document's ids, with an end id, are cut into full pieces of the capacity and one shorter piece. The histogram of
piece lengths (at most `capacity` rows) goes to one task, where `cutting_stock` finds how many sequences to fill by
which pattern. Each length's demand becomes intervals of ranks, one for each pattern that takes the length; the
pieces are ranked inside their length, and rank and interval give a piece its sequence and its place.

Edge cases: a null text is empty; an empty text has the end id alone; rows that repeat a doc_id are packed each for
itself; an empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm import byte_tokens
from netsift.llm.common import materialize, rank_in_groups, text_or_empty
from netsift.llm.cutting_stock import Pattern, cut

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_TAKEN = pa.schema([(name, pa.int64()) for name in ("length", "first", "last", "per", "sequence_base", "place")])


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, docs_at_once: int = 128) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_tokens.loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, docs_at_once):
                part = batch.slice(at, docs_at_once)
                out: list[list] = [[], [], [], [], []]
                for doc_id, packed in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    packed += end
                    for start in range(0, len(packed), 4 * capacity):
                        own = packed[start:start + 4 * capacity]
                        for column, value in zip(out, (doc_id, start // 4, len(own) // 4, zlib.crc32(own), len(packed) // 4)):
                            column.append(value)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def intervals(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length of each pattern: the ranks [first, last) it takes, pieces per sequence, first sequence, offset."""
    out, used, base = [], {}, 0
    for pattern, times in patterns:
        place = 0
        for length in sorted(pattern, reverse=True):
            per, first = pattern[length], used.get(length, 0)
            used[length] = first + per * times
            out.append((length, first, used[length], per, base, place))
            place += per * length
        base += times
    return out


def plan(histogram: DataFrame, capacity: int) -> DataFrame:
    """The intervals for a histogram (length, n), found in one task from its at most `capacity` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        demand = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            np.add.at(demand, np.asarray(batch.column(0)), np.asarray(batch.column(1)))
        found = intervals(cut(demand, capacity))
        yield pa.record_batch([pa.array([row[k] for row in found], pa.int64()) for k in range(6)], schema=_TAKEN)

    return histogram.coalesce(1).mapInArrow(run, ", ".join(f"{f.name} long" for f in _TAKEN))


def packed(docs: DataFrame, path: str, capacity: int = 1024, per_bucket: int = 2000) -> DataFrame:
    """Every piece with the sequence it is in and its offset there."""
    cut_up = materialize(pieces(docs, path, capacity), "pieces")
    histogram = materialize(cut_up.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    taken = materialize(plan(histogram, capacity), "intervals")
    spread = histogram.select("length", F.greatest(F.lit(16), F.ceil(F.col("n") / per_bucket)).cast("long").alias("spread"))
    # both tables are bounded by the capacity: a row per length, and a row per length and pattern
    ranked = rank_in_groups(cut_up.join(F.broadcast(spread), "length"), "length", ["doc_id", "start", "ids_crc32", "doc_tokens"], F.col("spread"))
    inside = (F.col("t.length") == F.col("p.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    at = F.col("rank") - F.col("first")
    return ranked.alias("p").join(F.broadcast(taken.alias("t")), inside).select(
        "doc_id", "start", F.col("p.length").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("sequence_base") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("place") + at % F.col("per") * F.col("p.length")).cast("long").alias("offset"))
