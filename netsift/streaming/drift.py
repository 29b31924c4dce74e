"""Drift of every micro-batch against a fixed baseline, with the history appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.operators import drift as I
from netsift.session import scratch_path
from netsift.sources import baseline as stored
from netsift.sources import history


def assess_batch(batch: DataFrame, baseline: DataFrame | str, path: str, importances: DataFrame | None = None, top_n: int = 10,
                 timestamp: str | None = None, batch_id: int | None = None) -> DataFrame | None:
    """Assess one batch against the baseline and append the result to the history; None when it is empty.

    The baseline is a table, or the path of a stored one (sources.baseline), of which only the counts are read.
    A batch that the stream repeats after a failure is known by its id and isn't entered twice.
    """
    if batch_id is not None and history.has_batch(batch.sparkSession, path, batch_id):
        return None
    n = batch.count()
    if n == 0:
        return None
    spark = batch.sparkSession
    results = stored.compare(baseline, batch) if isinstance(baseline, str) else I.compare_features(baseline, batch)
    doc = I.assess(results, batch_size=n, importances=importances, history=history.load(spark, path, 20), top_n=top_n, timestamp=timestamp)
    history.append(doc.drop("history", "dashboard").withColumn("batch_id", F.lit(batch_id).cast("long")), path)
    return doc


def monitor(stream: DataFrame, baseline: DataFrame | str, path: str, checkpoint: str, importances: DataFrame | None = None,
            on_assessment: Callable[[DataFrame, int], None] | None = None, top_n: int = 10):
    """A stream writer that assesses each micro-batch; start it with a trigger of your choice.

    A baseline given as a table is counted once and stored, so no batch reads its rows again.
    """
    if not isinstance(baseline, str):
        baseline = stored.store(baseline, scratch_path(baseline.sparkSession, "baseline"))

    def run(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        try:
            doc = assess_batch(held, baseline, path, importances, top_n=top_n, batch_id=epoch)
            if doc is not None and on_assessment is not None:
                on_assessment(doc, epoch)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
