"""What the two classifiers share: the bounded training sample, training in one task, and scoring whole tables."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import materialize, text_or_empty


def fold(parts: int) -> Column:
    """crc32(doc_id as text) mod `parts`; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % parts


def sample(docs: DataFrame, labels: DataFrame, column: str, train: Column, most: int, text: Column | None = None) -> DataFrame:
    """(label int, text) of at most about `most` labelled documents that `train` allows, chosen by a hash of doc_id.

    Several labels of a document count as their largest. The chosen labels are few, so they go to the documents.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & train)
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    known = materialize(known, "known-labels")
    share = min(1.0, most / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), (text if text is not None else text_or_empty()).alias("text"))
            .join(F.broadcast(chosen), "doc_id").select("label", "text"))


def trained(rows: DataFrame, fit: Callable[[np.ndarray, list[str]], dict[str, np.ndarray]]) -> bytes:
    """The model `fit` makes of the rows (label, text), found in one task; the rows must be a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: list[int] = []
        texts: list[str] = []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))  # the same model however the rows came
        model = packed(fit(np.array([labels[i] for i in order], np.int64), [texts[i] for i in order]))
        yield pa.record_batch([pa.array([model], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return bytes(found[0]) if found else packed(fit(np.zeros(0, np.int64), []))  # no rows, no task


def packed(model: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def unpacked(model: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(model)) as found:
        return {name: found[name] for name in found.files}


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def scored(docs: DataFrame, held_out: Column, scores: Callable[[list[str]], np.ndarray], threshold: float, at_once: int = 64) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                score = scores(part.column(2).to_pylist())
                yield pa.record_batch([part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                                      names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, scores: Callable[[list[str]], np.ndarray], keep: Callable[[np.ndarray], np.ndarray], at_once: int = 64) -> DataFrame:
    """The rows of `docs` whose score `keep` accepts, all columns as they are."""
    position = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                score = scores([t or "" for t in part.column(position).to_pylist()])
                yield part.filter(pa.array(keep(score)))

    return docs.mapInArrow(run, docs.schema)
