"""Connected intervals of sources from a stream of connect, heartbeat and disconnect events."""

from __future__ import annotations

from pyspark.sql import DataFrame

from netsift.streaming.ordered import Rule, fold_in_order


class Silence(Rule):
    """The runs of operators.alerts.liveness: a run ends with a disconnect, or a silence longer than the timeout.

    State: (first connect or None, last event).
    """

    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us

    def step(self, state, event):
        at, kind = event[0], event[-1]
        since = state[0] if state else None
        if since is None and kind == "connect":
            since = at
        if kind == "disconnect":
            return None, [] if since is None else [(since, at)]
        return (since, at), []

    def deadline(self, state) -> int:
        return state[1] + self.timeout_us

    def close(self, state):
        return [] if state[0] is None else [(state[0], self.deadline(state))]


def stream_liveness(events: DataFrame, source: str, ts: str, kind: str, order: list[str], timeout_us: int = 90_000_000, lateness: str = "1 minute") -> DataFrame:
    """(source, connected_from, connected_until) as soon as the watermark has passed the end of an interval."""
    return fold_in_order(events, Silence(timeout_us), [source], ts, [*order, kind], "connected_from long, connected_until long", lateness)
