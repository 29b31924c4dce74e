"""Decisions that depend on earlier decisions: rate limit, alert cooldown, service-health breaker.

The step functions are pure and shared with the streaming forms. In batch, a key's history is cut at
points where the state is known without looking back, so the pieces run in parallel; each piece is
read as a sorted stream of batches and keeps only the small state, never its rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.functions.scaling import null_safe_join, trailing_count
from netsift.session import materialize

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


class SlidingLimit:
    """At most `limit` accepted events per (t - window, t]; refused events do not count."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def start(self) -> list:
        return []

    def step(self, state: list, ts: int) -> tuple[list, bool]:
        del state[:bisect_right(state, ts - self.window_us)]
        accepted = len(state) < self.limit
        if accepted:
            state.append(ts)
        return state, accepted


class Breaker:
    """Service health: closed, open after `threshold` failures, half open after `recovery_us`, closed again
    after `probes` successes. Gated calls refused by the breaker are not recorded."""

    def __init__(self, threshold: int = 5, recovery_us: int = 30_000_000, probes: int = 3, gated: bool = True):
        self.threshold, self.recovery_us, self.probes, self.gated = threshold, recovery_us, probes, gated

    def start(self) -> list:
        return [CLOSED, 0, None, 0]  # state, failures, last failure, successful probes

    def check(self, state: list, ts: int) -> list:
        name, failures, last, probes = state
        if name == OPEN and last is not None and ts - last >= self.recovery_us:
            return [HALF_OPEN, failures, last, 0]
        return state

    def step(self, state: list, ts: int, success: bool) -> tuple[list, tuple[str, bool]]:
        """Returns the new state and (state seen by the call, executed)."""
        state = self.check(state, ts)
        seen = state[0]
        executed = seen == CLOSED or (seen == HALF_OPEN and state[3] < self.probes)
        if executed or not self.gated:
            state = self._record(state, ts, success)
        return state, (seen, executed)

    def _record(self, state: list, ts: int, success: bool) -> list:
        name, failures, last, probes = state
        if success:
            if name == HALF_OPEN:
                probes += 1
                return [CLOSED, 0, last, probes] if probes >= self.probes else [name, failures, last, probes]
            return [name, max(0, failures - 1) if name == CLOSED else failures, last, probes]
        failures += 1
        trip = name == HALF_OPEN or (name == CLOSED and failures >= self.threshold)
        return [OPEN if trip else name, failures, ts, probes]


def _stream_fold(df: DataFrame, keys: list[str], order: list[str], needs: list[str], extra: str, start: Callable, advance: Callable) -> DataFrame:
    """Runs `advance(state, *needs) -> (state, output tuple)` along each key's sorted rows, batch by batch.

    Rows of a key are together and sorted inside a partition; the state is carried from one Arrow batch
    to the next, so memory does not grow with the key. `extra` names the output columns as DDL.
    """
    names = [part.split()[0] for part in extra.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in frames:
            outputs = []
            for key, args in zip(zip(*[pdf[k] for k in keys]), zip(*[pdf[c].tolist() for c in needs])):
                key = tuple(None if k is None or k != k else k for k in key)  # pandas writes a missing number as NaN
                if key != current:
                    current, state = key, start()
                state, out = advance(state, *args)
                outputs.append(out)
            yield pdf.assign(**{n: [o[i] for o in outputs] for i, n in enumerate(names)})

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", " + extra)


def rate_limit(df: DataFrame, key: str, ts: str, order: list[str], limit: int = 100, window_us: int = 60_000_000,
               chunk_us: int | None = None, out: str = "allowed") -> DataFrame:
    """Adds `allowed` per event. `ts` is in microseconds; `order` breaks ties of `ts`.

    Where the plain count of all events in the window stays within the limit, every event is certainly
    accepted. Only chunks of time with a larger count need the fold, together with the accepted events
    of the window before them; a run of such chunks is one independent piece.
    """
    chunk = max(int(chunk_us or 10 * window_us), window_us)
    own_chunk = F.floor(F.col(ts) / F.lit(chunk)).cast("long")
    counted = trailing_count(df, [key], ts, window_us, out="_c").withColumn("_chunk", own_chunk)
    chunks = counted.groupBy(key, "_chunk").agg(F.max(F.col("_c") > limit).alias("_hot"))
    w = Window.partitionBy(key).orderBy("_chunk")
    gap = F.coalesce(F.col("_chunk") - F.lag("_chunk").over(w) > 1, F.lit(True))
    hot = (
        chunks.where("_hot").withColumn("_new", gap)
        .select(key, "_chunk", F.sum(F.col("_new").cast("int")).over(w).alias("_piece"), "_new")
    )
    hot = materialize(hot, "hot-chunks")  # one row per hot chunk, read several times below
    # the chunk before a piece is calm: the tail of it is the piece's known starting state
    warm = hot.where("_new").select(key, (F.col("_chunk") - 1).alias("_chunk"), F.col("_piece").alias("_warm_piece"))
    tagged = null_safe_join(null_safe_join(df.withColumn("_chunk", own_chunk), hot.drop("_new"), [key, "_chunk"], "left"), warm, [key, "_chunk"], "left")
    tail = F.col(ts) > (F.col("_chunk") + 1) * chunk - window_us
    part = tagged.where(F.col("_piece").isNotNull()).select(*df.columns, "_piece", F.lit(False).alias("_warm")).unionByName(
        tagged.where(F.col("_warm_piece").isNotNull() & tail).select(*df.columns, F.col("_warm_piece").alias("_piece"), F.lit(True).alias("_warm")))
    rule = SlidingLimit(limit, window_us)

    def advance(state, at):
        state, ok = rule.step(state, at)
        return state, (ok,)

    folded = _stream_fold(part, [key, "_piece"], [ts, *order], [ts], f"{out} boolean", rule.start, advance)
    calm = tagged.where(F.col("_piece").isNull()).select(*df.columns, F.lit(True).alias(out))
    return calm.unionByName(folded.where(~F.col("_warm")).select(*df.columns, out))


def cooldown(df: DataFrame, key: str, ts: str, order: list[str], seconds: float = 30.0, chunk_us: int | None = None, out: str = "fired") -> DataFrame:
    """Fire iff at least `seconds` since the last fired alert of the key: a limit of one per window."""
    return rate_limit(df, key, ts, order, 1, int(seconds * 1_000_000), chunk_us, out)


def denied_total(decided: DataFrame) -> DataFrame:
    return decided.agg(F.count_if(~F.col("allowed")).alias("denied"))


def remaining_quota(decided: DataFrame, key: str, ts: str, limit: int, window_us: int) -> DataFrame:
    """Quota left right after each event: the limit minus accepted events in the window."""
    c = trailing_count(decided, [key], ts, window_us, F.col("allowed"), "_used")
    return c.withColumn("remaining", F.greatest(F.lit(limit) - F.col("_used"), F.lit(0)).cast("int")).drop("_used")


def service_health(df: DataFrame, key: str, ts: str, order: list[str], success: str, threshold: int = 5, recovery_us: int = 30_000_000,
                   probes: int = 3, gated: bool = True, chunk_us: int | None = None) -> DataFrame:
    """Adds `state` (seen by the call), `executed` and `state_after` per call of a service.

    A chunk of time without failures that holds enough successes after the recovery time leaves the
    breaker closed with no failures, whatever it was before: histories are cut after such chunks.
    """
    rule = Breaker(threshold, recovery_us, probes, gated)
    chunk = max(int(chunk_us or 10 * recovery_us), recovery_us + 1)
    tagged = df.withColumn("_chunk", F.floor(F.col(ts) / F.lit(chunk)).cast("long"))
    late = F.col(ts) >= F.col("_chunk") * chunk + recovery_us
    settled = tagged.groupBy(key, "_chunk").agg(
        (F.min(F.col(success).cast("int")) == 1).alias("_calm"), F.count_if(late).alias("_late"))
    need = max(probes, threshold - 1, 1)
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    pieces = settled.withColumn("_cut", (F.col("_calm") & (F.col("_late") >= need)).cast("int")).select(
        key, "_chunk", F.coalesce(F.sum("_cut").over(before), F.lit(0)).alias("_piece"))
    part = null_safe_join(tagged, pieces, [key, "_chunk"]).drop("_chunk")

    def advance(state, at, ok):
        state, (seen, executed) = rule.step(state, at, bool(ok))
        return state, (seen, executed, state[0])

    out = _stream_fold(part, [key, "_piece"], [ts, *order], [ts, success], "state string, executed boolean, state_after string", rule.start, advance)
    return out.drop("_piece")


def request_gate(df: DataFrame, client: str, service: str, ts: str, order: list[str], success: str, limit: int, window_us: int,
                 threshold: int, recovery_us: int, probes: int = 3, chunk_us: int | None = None) -> DataFrame:
    """The full gate: rate limit per client first (its quota is spent even when the breaker then refuses),
    then the breaker on what the limit let through."""
    limited = rate_limit(df, client, ts, order, limit, window_us, chunk_us)
    passed = service_health(limited.where("allowed"), service, ts, order, success, threshold, recovery_us, probes, True, chunk_us)
    none = F.lit(None)
    refused = limited.where(~F.col("allowed")).select("*", none.cast("string").alias("state"), F.lit(False).alias("executed"), none.cast("string").alias("state_after"))
    return passed.unionByName(refused)
