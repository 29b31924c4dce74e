"""Stateful decisions on streams: the batch step functions behind one stateful processor.

Rows of a key are put in order within each micro-batch; the state store keeps only the small state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from netsift.operators.folds import Breaker, SlidingLimit


class FoldProcessor(StatefulProcessor):
    def __init__(self, rule, key: str, ts: str, order: list[str], success: str | None, columns: list[str], outputs: list[str]):
        self.rule, self.key, self.ts, self.order, self.success, self.columns, self.outputs = rule, key, ts, order, success, columns, outputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values([self.ts, *self.order], kind="stable")
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.rule.start()
        out = []
        for row in pdf.to_dict("records"):
            if self.success is None:
                state, ok = self.rule.step(state, int(row[self.ts]))
                out.append((ok,))
            else:
                state, (seen, executed) = self.rule.step(state, int(row[self.ts]), bool(row[self.success]))
                out.append((seen, executed, state[0]))
        self.state.update((json.dumps(state),))
        yield pdf[self.columns].assign(**{n: [o[i] for o in out] for i, n in enumerate(self.outputs)})

    def close(self) -> None:
        pass


def _run(stream: DataFrame, rule, key: str, ts: str, order: list[str], success: str | None, outputs: list[tuple[str, str]]) -> DataFrame:
    cols = stream.columns
    schema = ", ".join([f"`{c}` {t}" for c, t in stream.dtypes] + [f"{n} {t}" for n, t in outputs])
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=FoldProcessor(rule, key, ts, order, success, cols, [n for n, _ in outputs]), outputStructType=schema, outputMode="append", timeMode="none")


def stream_rate_limit(stream: DataFrame, key: str, ts: str, order: list[str], limit: int = 100, window_us: int = 60_000_000) -> DataFrame:
    return _run(stream, SlidingLimit(limit, window_us), key, ts, order, None, [("allowed", "boolean")])


def stream_cooldown(stream: DataFrame, key: str, ts: str, order: list[str], seconds: float = 30.0) -> DataFrame:
    return _run(stream, SlidingLimit(1, int(seconds * 1_000_000)), key, ts, order, None, [("fired", "boolean")])


def stream_service_health(stream: DataFrame, key: str, ts: str, order: list[str], success: str, threshold: int = 5, recovery_us: int = 30_000_000,
                          probes: int = 3, gated: bool = True) -> DataFrame:
    return _run(stream, Breaker(threshold, recovery_us, probes, gated), key, ts, order, success,
                [("state", "string"), ("executed", "boolean"), ("state_after", "string")])
