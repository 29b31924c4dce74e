"""Ordered decisions on streams in small slices, and the cursor source over restarts."""

import random

from pyspark.sql import functions as F

from netsift.operators.folds import Breaker, SlidingLimit
from netsift.streaming import decisions, feed
from netsift.streaming.decisions import Limited, in_order
from netsift.streaming.ordered import OrderedProcessor


class Cells:
    """A state variable of one key, in memory."""

    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(list(self.rows)) if self.many else self.rows[0]

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows += rows

    def update(self, row):
        self.rows = [row]

    def clear(self):
        self.rows = []


class Handle:
    def __init__(self):
        self.timers, self.states = [], {}

    def getListState(self, name, schema):
        self.states[name] = Cells()
        self.states[name].many = True
        return self.states[name]

    def getValueState(self, name, schema):
        self.states[name] = Cells()
        self.states[name].many = False
        return self.states[name]

    def registerTimer(self, at):
        self.timers.append(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_hot_key_is_folded_in_slices(monkeypatch):
    import pandas as pd

    from netsift.streaming import ordered

    monkeypatch.setattr(ordered, "AT_ONCE", 7)
    rng = random.Random(3)
    events = [(rng.randrange(0, 90) * 1_000_000 + rng.choice([0, 0, 250_000]), i) for i in range(400)]
    p = OrderedProcessor(Limited(3, 10_000_000), ["k"], ["ts", "no"], "ts long, no long", ["ts", "no", "allowed"])
    handle = Handle()
    p.init(handle)
    got = []
    for ms, part in ((30_000, events[:0] + [e for e in events if e[0] < 45_000_000]), (95_000, [e for e in events if e[0] >= 45_000_000])):
        rng.shuffle(part)
        list(p.handleInputRows(("a",), iter([pd.DataFrame(part[:50], columns=["ts", "no"]), pd.DataFrame(part[50:], columns=["ts", "no"])]), None))
        frames = [f for f in p.handleExpiredTimer(("a",), Mark(ms), None) if len(f)]
        assert len(frames) > 3
        got += [tuple(r) for f in frames for r in f[["ts", "no", "allowed"]].itertuples(index=False, name=None)]
    fold, state, want = SlidingLimit(3, 10_000_000), [], []
    for e in sorted(events):
        state, ok = fold.step(state, e[0])
        want.append((*e, ok))
    assert got == want and not handle.states["waiting"].exists()


def test_in_order_takes_nulls_first():
    assert sorted([(2, None), (1, "b"), (1, None), (1, "a")], key=in_order) == [(1, None), (1, "a"), (1, "b"), (2, None)]


def test_the_gate_records_only_what_the_limit_lets_through(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(8)
    start = 86_400_000_000  # Spark's first watermark is the epoch, events at or before it count as late
    calls = [(start + rng.randrange(0, 400) * 1_000_000, i, f"c{rng.randrange(4)}", f"s{rng.randrange(2)}", rng.random() < 0.5) for i in range(294)]
    end = max(c[0] for c in calls) - 200_000_000
    calls += [(end, 294 + i, f"d{i}", "s0", i % 2 == 0) for i in range(6)]  # at the very last watermark, of other clients
    calls.sort()
    ddl = "ts long, no long, client string, service string, ok boolean"
    for lo, hi in ((0, 100), (100, 200), (200, 300)):  # rows of a batch are shuffled, batches overlap by nothing
        part = calls[lo:hi]
        rng.shuffle(part)
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = decisions.ordered_request_gate(stream, "client", "service", "ts", ["no"], "ok", 5, 40_000_000, 3, 20_000_000, lateness="200 seconds")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()
    got = {r["no"]: (r["allowed"], r["state"], r["executed"]) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    limit, breaker, limits, states, want = SlidingLimit(5, 40_000_000), Breaker(3, 20_000_000, 3, True), {}, {}, {}
    for ts, no, client, service, ok in calls:
        limits[client], allowed = limit.step(limits.get(client, []), ts)
        seen, executed = None, False
        if allowed:
            states[service], (seen, executed) = breaker.step(states.get(service, breaker.start()), ts, ok)
        want[no] = (allowed, seen, executed)
    last = max(c[0] for c in calls) - 200_000_000
    assert got == {c[1]: want[c[1]] for c in calls if c[0] <= last} and any(not w[0] for w in got.values()) and any(w[1] == "open" for w in got.values())


def test_a_restarted_cursor_gives_each_row_once(spark, tmp_path):
    path, ddl = f"{tmp_path}/feed", "no long, ts_us long, text string"

    def add(rows):
        spark.createDataFrame(rows, ddl).repartition(2).write.mode("append").parquet(path)

    def run():
        s = feed.read_feed(spark, path, ddl, 5)
        s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["no"] for r in spark.read.schema(ddl).parquet(f"{tmp_path}/out").collect())

    add([(i, i, "x") for i in range(10)] + [(100, None, "no time")])
    assert run() == [6, 7, 8, 9]  # strictly after the cursor
    assert run() == [6, 7, 8, 9]  # nothing new
    add([(i, i, None) for i in range(10, 25)])
    add([(50, 7, "late")])  # behind the stored offset
    assert run() == list(range(6, 25))
    reader = feed.FeedReader(spark.read.parquet(path).schema, {"path": path})
    assert reader.latestOffset() == {"after": 24} and reader.partitions({"after": 24}, {"after": 24}) == []
    empty = feed.FeedReader(spark.read.parquet(path).schema, {"path": f"{tmp_path}/none", "after": "3"})
    assert empty.latestOffset() == empty.initialOffset() == {"after": 3}


def test_a_hot_key_reads_and_writes_its_waiting_events_a_few_times(monkeypatch):
    import pandas as pd

    from netsift.streaming import ordered

    monkeypatch.setattr(ordered, "AT_ONCE", 100)
    monkeypatch.setattr(ordered, "PIECE", 20, raising=False)
    monkeypatch.setattr(ordered, "PACKED", 2_000, raising=False)
    touched = []

    class Counted(Cells):
        def get(self):
            return (touched.append(1) or r for r in list(self.rows)) if self.many else self.rows[0]

    monkeypatch.setitem(globals(), "Cells", Counted)
    events = [(s * 1_000_000, i) for i, s in enumerate(range(4_000))]
    p = OrderedProcessor(Limited(3, 10_000_000), ["k"], ["ts", "no"], "ts long, no long", ["ts", "no", "allowed"])
    p.init(Handle())
    part = events[:]
    random.Random(4).shuffle(part)
    list(p.handleInputRows(("a",), iter([pd.DataFrame(part[at:at + 1_000], columns=["ts", "no"]) for at in range(0, 4_000, 1_000)]), None))
    frames = [f for f in p.handleExpiredTimer(("a",), Mark(3_000_500), None) if len(f)]
    assert [no for f in frames for no in f["no"].tolist()] == list(range(3_001)) and max(len(f) for f in frames) <= 100
    assert len(touched) < 4_000 * 3
    frames = [f for f in p.handleExpiredTimer(("a",), Mark(9_000_000), None) if len(f)]
    assert [no for f in frames for no in f["no"].tolist()] == list(range(3_001, 4_000)) and not p.waiting.exists()


def test_the_columns_of_whole_numbers_are_known_by_the_schema():
    p = OrderedProcessor(Limited(3, 10), ["k"], ["ts", "no", "x"], "`ts` bigint, `no` int, `x` decimal(10, 2)", [])
    assert p.whole == [True, True, False]
