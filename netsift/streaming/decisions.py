"""Rate limit, cooldown, service health and the request gate on streams whose events come out of order.

The rules of operators.folds, run behind the watermark: a decision is emitted once no earlier event of its key can
come, so the result is that of the batch operators on all events the watermark has passed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from netsift.operators.folds import Breaker, SlidingLimit
from netsift.streaming.ordered import Rule, fold_in_order, in_order


class Limited(Rule):
    """State: the times of the accepted events in the window. It is dropped when the window has passed them."""

    def __init__(self, limit: int, window_us: int):
        self.fold = SlidingLimit(limit, window_us)

    def step(self, state, event):
        state, accepted = self.fold.step(state or self.fold.start(), event[0])
        return state, [(*event, accepted)]

    def deadline(self, state):
        return state[-1] + self.fold.window_us if state else None

    def close(self, state):
        return []


class Health(Rule):
    """State: (breaker state, failures, last failure, probes). The last column of an event tells its success."""

    def __init__(self, breaker: Breaker):
        self.breaker = breaker

    def step(self, state, event):
        state, (seen, executed) = self.breaker.step(state or self.breaker.start(), event[0], bool(event[-1]))
        return state, [(*event, seen, executed, state[0])]

    def deadline(self, state):
        return None

    def close(self, state):
        return []


def _decide(stream: DataFrame, rule: Rule, key: str, ts: str, columns: list[str], extra: str, lateness: str) -> DataFrame:
    types = dict(stream.dtypes)
    return fold_in_order(stream, rule, [key], ts, columns, ", ".join([f"{c} {types[c]}" for c in (ts, *columns)] + [extra]), lateness)


def ordered_rate_limit(stream: DataFrame, key: str, ts: str, order: list[str], limit: int = 100, window_us: int = 60_000_000, carry: list[str] | None = None,
                       lateness: str = "1 minute", out: str = "allowed") -> DataFrame:
    """(key, ts, order, carry, allowed) of every event, in the order of (ts, order); `ts` in microseconds."""
    return _decide(stream, Limited(limit, window_us), key, ts, [*order, *(carry or [])], f"{out} boolean", lateness)


def ordered_cooldown(stream: DataFrame, key: str, ts: str, order: list[str], seconds: float = 30.0, lateness: str = "1 minute") -> DataFrame:
    """Fire iff at least `seconds` since the last fired alert of the key."""
    return ordered_rate_limit(stream, key, ts, order, 1, int(seconds * 1_000_000), lateness=lateness, out="fired")


def ordered_service_health(stream: DataFrame, key: str, ts: str, order: list[str], success: str, threshold: int = 5, recovery_us: int = 30_000_000, probes: int = 3,
                           gated: bool = True, lateness: str = "1 minute") -> DataFrame:
    """(key, ts, order, success, state, executed, state_after) of every call of a service."""
    rule = Health(Breaker(threshold, recovery_us, probes, gated))
    return _decide(stream, rule, key, ts, [*order, success], "state string, executed boolean, state_after string", lateness)


class GateProcessor(StatefulProcessor):
    """The breaker behind the limit. The limit emits all events up to the watermark in one micro-batch, so every batch is
    later than the one before and is put in order by itself; calls that the limit refused pass by unrecorded."""

    def __init__(self, breaker: Breaker, ts: str, order: list[str], success: str, columns: list[str]):
        self.breaker, self.ts, self.order, self.success, self.columns = breaker, ts, order, success, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.breaker.start()
        at, allowed, success = self.columns.index(self.ts), self.columns.index("allowed"), self.columns.index(self.success)
        order = [at, *[self.columns.index(c) for c in self.order]]
        calls = []
        for pdf in rows:
            calls += [tuple(None if pd.isna(v) else v for v in r) for r in pdf[self.columns].itertuples(index=False, name=None)]
        calls.sort(key=lambda r: in_order(tuple(r[i] for i in order)))
        out = []
        for r in calls:
            if r[allowed]:
                state, (seen, executed) = self.breaker.step(state, int(r[at]), bool(r[success]))
                out.append((*r, seen, executed, state[0]))
            else:
                out.append((*r, None, False, None))
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=[*self.columns, "state", "executed", "state_after"])

    def close(self) -> None:
        pass


def ordered_request_gate(stream: DataFrame, client: str, service: str, ts: str, order: list[str], success: str, limit: int, window_us: int, threshold: int,
                         recovery_us: int, probes: int = 3, lateness: str = "1 minute") -> DataFrame:
    """The full gate in one query, two stateful operators in a chain: the limit per client, then the breaker per service."""
    limited = ordered_rate_limit(stream, client, ts, order, limit, window_us, [service, success], lateness)
    cols = limited.columns
    schema = ", ".join([f"`{c}` {t}" for c, t in limited.dtypes] + ["state string", "executed boolean", "state_after string"])
    return limited.groupBy(service).transformWithStateInPandas(
        statefulProcessor=GateProcessor(Breaker(threshold, recovery_us, probes, True), ts, order, success, cols), outputStructType=schema, outputMode="append", timeMode="none")
