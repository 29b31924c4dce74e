"""Removal of repeated runs of lines, by winnowing.

A gram is the shortest run of whole lines from a line on with `noise` words, a window the shortest one with `guarantee`
words. Of the grams inside a window, up to the last window of the text, the one with the smallest hash is selected; so
two documents that share such a run select the same gram in it. The first occurrence of a gram in the corpus, by (doc_id, line), is its anchor. Every later occurrence is
compared with the anchor line by line to both sides, and the lines of the common run are removed from the later one.

The anchor may have other lines around a gram than two later documents share. So a gram stands for the windows that
selected it, from their first line on and back from their last one, and a window that reaches beyond the run in
common with the anchor has its own first occurrence, by the hashes of the gram and of all its lines. These windows
cover every shared run with `guarantee` words.

A removed line always has an equal line before it, so each line keeps its first occurrence. Runs with fewer than
`noise` words are never removed; of those with `guarantee` words none is missed; those between are removed where
their gram is selected. The comparison goes `guarantee` words beyond the gram, within which the next selected gram
of a longer run lies.

Edge cases: lines without words are never compared; inside a removed run they go with it. A null text stays null
and has no lines. A null doc_id is smaller than any other. Rows that repeat both doc_id and text are one document:
what is removed is removed from all. A document may become empty; it stays as a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from netsift.llm.common import materialize, text_or_empty

NOISE, GUARANTEE = 16, 32
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_MARKS = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line", pa.int32()), ("lines", pa.int32()),
                    ("before", _LONGS), ("after", _LONGS), ("before_at", _INTS), ("after_at", _INTS),
                    ("windows", _LONGS), ("window_first", _INTS), ("window_last", _INTS)])


def selected(text: str, noise: int = NOISE, guarantee: int = GUARANTEE) -> Iterator[tuple]:
    """(gram, line, lines in the gram, hashes before it backwards, hashes from it on, where those lines are, and the hashes,
    first and last lines of the windows it stands for)."""
    at, hashes, words = [], [], [0]
    for number, line in enumerate(text.split("\n")):
        if n := len(line.split()):
            at.append(number)
            hashes.append(xxhash.xxh64_intdigest(line) - (1 << 63))
            words.append(words[-1] + n)
    total = len(at)
    if words[-1] < noise:
        return
    packed = np.array(hashes, np.int64).tobytes()
    grams, ends, end = [], [], 0
    for i in range(total):
        while end < total and words[end] - words[i] < noise:
            end += 1
        if words[end] - words[i] < noise:
            break
        grams.append(xxhash.xxh64_intdigest(packed[8 * i:8 * end]) - (1 << 63))
        ends.append(end)
    chosen: dict[int, set[tuple[int, int]]] = {}  # gram -> the windows it stands for
    of_line, last, close = [], 0, 0
    for i in range(len(grams)):
        while close < total and words[close] - words[i] < guarantee:
            close += 1
        if i and words[close] - words[i] < guarantee:
            break  # too few words for a window
        last = max(last, i)
        while last + 1 < len(grams) and ends[last + 1] <= close:
            last += 1
        of_line.append(min(range(last, i - 1, -1), key=grams.__getitem__))  # the last of equal ones
        chosen.setdefault(of_line[-1], set()).add((i, close))
    back = 0
    for close in range(1, total + 1):  # the shortest windows that end after a line
        if words[close] >= guarantee:
            while words[close] - words[back + 1] >= guarantee:
                back += 1
            chosen[of_line[back]].add((back, close))
    for i in sorted(chosen):
        lo = hi = i
        while lo and words[i] - words[lo] < guarantee:
            lo -= 1
        hi = ends[i]
        while hi < total and words[hi] - words[ends[i]] < guarantee:
            hi += 1
        own = sorted(chosen[i]) if words[-1] >= guarantee else []
        yield (grams[i], at[i], ends[i] - i, hashes[lo:i][::-1], hashes[i:hi], at[lo:i][::-1], at[i:hi],
               [xxhash.xxh64_intdigest(packed[8 * a:8 * b], 1) - (1 << 63) for a, b in own], [at[a] for a, _ in own], [at[b - 1] for _, b in own])


def marks(docs: DataFrame, noise: int, guarantee: int) -> DataFrame:
    """The selected grams of all documents with the lines around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [(gram, doc_id, text_hash, *rest)
                        for doc_id, text_hash, text in zip(*(c.to_pylist() for c in part.columns))
                        for gram, *rest in selected(text, noise, guarantee)]
                columns = list(zip(*rows)) if rows else [[]] * len(_MARKS)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _MARKS)], schema=_MARKS)

    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        run, "gram long, doc_id long, text_hash long, line int, lines int, before array<long>, after array<long>, before_at array<int>, after_at array<int>, windows array<long>, window_first array<int>, window_last array<int>")


def _common(a: Column, b: Column) -> Column:
    """How many elements two arrays share from their beginning."""
    apart = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(apart == 0, F.size(a)).otherwise(apart - 1).cast("int")


def repeated_runs(docs: DataFrame, noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """(doc_id, text_hash, first, last): runs of lines that repeat an earlier run."""
    found = materialize(marks(docs, noise, guarantee), "line-marks")
    place = F.struct("doc_id", "text_hash", "line", "before", "after")
    anchors = (found.groupBy("gram").agg(F.min(place).alias("anchor"), F.count("*").alias("n")).filter("n > 1").select("gram", "anchor"))
    met = found.join(materialize(anchors, "line-anchors"), "gram")
    same = _same_row("anchor") & (F.col("line") == F.col("anchor.line"))
    met = (met.withColumn("left", _common(F.col("before"), F.col("anchor.before"))).withColumn("right", _common(F.col("after"), F.col("anchor.after")))
           .withColumn("equal", F.col("right") >= F.col("lines")))  # the lines themselves, not their hashes in a gram, decide
    met = (met.withColumn("first", F.when(F.col("left") > 0, F.element_at("before_at", F.greatest("left", F.lit(1)))).otherwise(F.col("line")))
           .withColumn("last", F.when(F.col("right") > 0, F.element_at("after_at", F.greatest("right", F.lit(1))))))
    # windows that reach beyond what the line has in common with the anchor have anchors of their own
    window = F.arrays_zip(F.col("windows").alias("hash"), F.col("window_first").alias("first"), F.col("window_last").alias("last"))
    beyond = F.filter(window, lambda w: ~F.col("equal") | (w["first"] < F.col("first")) | (w["last"] > F.col("last")))
    met = materialize(met.select("gram", "doc_id", "text_hash", "first", "last", (F.col("equal") & ~same).alias("repeats"), beyond.alias("beyond")), "line-matches")
    runs = met.filter("repeats").select("doc_id", "text_hash", "first", "last")
    windows = met.select("gram", "doc_id", "text_hash", F.explode("beyond").alias("w")).select("gram", "doc_id", "text_hash", "w.*")
    place = F.struct("doc_id", "text_hash", F.col("first").alias("line"))
    again = windows.groupBy("gram", "hash").agg(F.min(place).alias("anchor"), F.count("*").alias("n")).filter("n > 1").select("gram", "hash", "anchor")
    later = windows.join(materialize(again, "window-anchors"), ["gram", "hash"]).filter(~(_same_row("anchor") & (F.col("first") == F.col("anchor.line"))))
    return runs.unionByName(later.select("doc_id", "text_hash", "first", "last"))


def _same_row(anchor: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(f"{anchor}.doc_id")) & (F.col("text_hash") == F.col(f"{anchor}.text_hash"))


@F.pandas_udf(StringType())
def _without(texts: pd.Series, runs: pd.Series) -> pd.Series:
    """The texts without their runs of lines; null where there are none."""
    out = []
    for text, own in zip(texts, runs):
        if text is None or own is None:
            out.append(None)
            continue
        lines = text.split("\n")
        gone = np.zeros(len(lines) + 1, np.int64)
        for run in own:
            gone[run["first"]] += 1
            gone[run["last"] + 1] -= 1
        keep = np.cumsum(gone)[:-1] == 0
        out.append("\n".join(line for line, k in zip(lines, keep) if k))
    return pd.Series(out, dtype=object)


def without_repeats(docs: DataFrame, noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """`docs` with repeated runs removed from `text`; other columns as they are."""
    # a run may be found from several grams and from repeated rows
    runs = repeated_runs(docs, noise, guarantee).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    runs = materialize(runs, "line-runs").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "runs")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"), F.xxhash64(text_or_empty()).alias("hash"))
    met = whole.join(runs.hint("shuffle_hash"), F.col("hash").eqNullSafe(F.col("_hash")) & F.col("key").eqNullSafe(F.col("_id")), "left")
    text = F.col("row").getField("text").cast("string")
    left = F.coalesce(_without(F.when(F.col("runs").isNotNull(), text), F.col("runs")), text)
    return met.select(*[(left if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
