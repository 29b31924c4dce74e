"""Rules that need their events in order, on streams whose events are not.

A stateful processor keeps the events of a key until the watermark has passed them, so that no earlier one can come,
then hands them to the rule in order. They wait in sorted, packed pieces. Event-time timers wake a key when the watermark
reaches its next event, or the moment at which silence closes its state. The store holds the events of a key that are ahead
of the watermark and a small state, never a whole history.

Spark's first watermark is 1970-01-01: events at or before it count as late and are dropped, as are those that come later
than the lateness allows.
"""

from __future__ import annotations

import json
import pickle
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


AT_ONCE = 50_000  # events of a key that are sorted together (when due, more only where pieces overlap)
PIECE = 500  # waiting events of a key that are stored together
TOGETHER = 64  # pieces that go to the store together
PACKED = 64_000_000  # bytes of due pieces that are in memory together
WHOLE = "tinyint|smallint|int|integer|bigint|byte|short|long"


class Rule:
    """A fold over the events of a key. An event is (microseconds, further columns ..); a state can be written as JSON."""

    def step(self, state, event: tuple) -> tuple[object, list[tuple]]:
        """The next state (None: nothing is open) and the rows to emit."""
        raise NotImplementedError

    def deadline(self, state) -> int | None:
        """The microsecond at which `state` closes if nothing comes; None: silence doesn't close it."""
        raise NotImplementedError

    def close(self, state) -> list[tuple]:
        raise NotImplementedError


def in_order(event: tuple) -> tuple:
    """A sort key of events, nulls first."""
    return tuple((v is not None, v) for v in event)


def _piece(events: list[tuple]) -> tuple:
    """What a piece of sorted events covers, and the events."""
    return events[0][0], events[-1][0], pickle.dumps(events, pickle.HIGHEST_PROTOCOL)


class OrderedProcessor(StatefulProcessor):
    def __init__(self, rule: Rule, key: list[str], columns: list[str], schema: str, outputs: list[str]):
        self.rule, self.key, self.columns, self.outputs = rule, key, columns, outputs
        self.whole = [re.search(rf"(^|[\s,`]){re.escape(c)}`? ({WHOLE})\b", schema) is not None for c in columns]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "least long, most long, events binary")
        self.open = handle.getValueState("open", "state string")

    def _wake(self, micros: int) -> None:
        # a timer fires when the watermark is beyond it; all keys must emit a moment with the same watermark
        self.handle.registerTimer(-(-micros // 1000) - 1)

    def _events(self, pdf: pd.DataFrame) -> list[tuple]:
        columns = []
        for name, whole in zip(self.columns, self.whole):
            values = pdf[name].tolist()
            if pdf[name].hasnans:
                values = [None if pd.isna(v) else v for v in values]
            # pandas writes whole numbers beside a missing one as floats, which a state column of whole numbers does not hold:
            # in such a chunk the column counts as missing
            columns.append([None] * len(values) if whole and pdf[name].dtype.kind == "f" else values)
        return list(zip(*columns))

    def _keep(self, pieces: list[tuple]) -> None:
        for at in range(0, len(pieces), TOGETHER):
            self.waiting.appendList(pieces[at:at + TOGETHER])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, events = None, []
        for pdf in rows:  # a chunk of the batch at a time
            events += self._events(pdf)
            if len(events) >= AT_ONCE:
                first, events = self._store(events, first), []
        first = self._store(events, first)
        if first is not None:
            self._wake(first)
        yield pd.DataFrame()

    def _store(self, events: list[tuple], first: int | None) -> int | None:
        if not events:
            return first
        events.sort(key=in_order)
        self._keep([_piece(events[at:at + PIECE]) for at in range(0, len(events), PIECE)])
        return events[0][0] if first is None else min(first, events[0][0])

    def _due(self, passed: int) -> Iterator[list[tuple]]:
        """The events up to `passed` in order, AT_ONCE at a time; they leave the store.

        A first pass over the pieces finds what they cover; every further one takes due pieces of about PACKED bytes.
        """
        sizes = sorted((p[0], len(p[2])) for p in self.waiting.get() if p[0] <= passed) if self.waiting.exists() else []
        if not sizes:
            return
        ends, size = [], 0  # every pass takes the pieces that begin before its end
        for (least, n), following in zip(sizes, [*sizes[1:], (passed + 1, 0)]):
            size += n
            if size >= PACKED and least < following[0]:
                ends.append(following[0])
                size = 0
        ends = [*[e for e in ends if e <= passed], passed + 1]
        kept, held, begin = [], [], sizes[0][0]
        for end in ends:
            pieces = sorted((tuple(p) for p in self.waiting.get() if begin <= p[0] < end), key=lambda p: p[0])
            for at, (_, most, packed) in enumerate(pieces):
                events = pickle.loads(packed)
                if most > passed:
                    cut = bisect_right(events, passed, key=lambda e: e[0])
                    kept.append(_piece(events[cut:]))
                    events = events[:cut]
                held += events
                upto = pieces[at + 1][0] if at + 1 < len(pieces) else end  # no event of the pieces to come is before it
                if len(held) >= AT_ONCE or at + 1 == len(pieces):
                    held.sort(key=in_order)
                    cut = bisect_left(held, upto, key=lambda e: e[0])
                    for first in range(0, cut, AT_ONCE):
                        yield held[first:min(first + AT_ONCE, cut)]
                    held = held[cut:]
            begin = end
        kept += [tuple(p) for p in self.waiting.get() if p[0] > passed]
        self.waiting.clear()
        self._keep(kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        state = json.loads(self.open.get()[0]) if self.open.exists() else None
        for due in self._due(passed):  # a slice of time is in memory, not all that a hot key has waiting
            out = []
            for event in due:
                until = None if state is None else self.rule.deadline(state)
                if until is not None and until < event[0]:
                    out += self.rule.close(state)
                    state = None
                state, emitted = self.rule.step(state, event)
                out += emitted
            if out:
                yield self._frame(key, out)
        until = None if state is None else self.rule.deadline(state)
        if until is not None and until <= passed:
            out = self.rule.close(state)
            state = until = None
            if out:
                yield self._frame(key, out)
        later = min((p[0] for p in self.waiting.get()), default=None) if self.waiting.exists() else None
        if later is not None:
            self._wake(later)
        if state is None:
            self.open.clear()
        else:
            self.open.update((json.dumps(state),))
            if until is not None:
                self._wake(until)
        yield pd.DataFrame()

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=self.outputs)
        for name, value in reversed(list(zip(self.key, key))):
            frame.insert(0, name, value)
        return frame

    def close(self) -> None:
        pass


def fold_in_order(stream: DataFrame, rule: Rule, key: list[str], micros: str, columns: list[str], outputs: str, lateness: str) -> DataFrame:
    """The rows that `rule` emits for the events (`micros`, `columns` ..) of every key; `columns` begin with those that order
    events of the same microsecond."""
    held = [micros, *columns]
    types = dict(stream.dtypes)
    timed = stream.select(*key, *held, F.timestamp_micros(F.col(micros)).alias("event_time")).withWatermark("event_time", lateness)
    schema = ", ".join(f"`{c}` {types[c]}" for c in held)
    names = [part.split()[0] for part in outputs.split(", ")]
    return timed.groupBy(*key).transformWithStateInPandas(
        statefulProcessor=OrderedProcessor(rule, key, held, schema, names), outputStructType=", ".join([*[f"`{k}` {types[k]}" for k in key], outputs]),
        outputMode="append", timeMode="EventTime")
