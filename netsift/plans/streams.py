"""J stream forms: each runs a real stream over the whole event table to its end and returns the written result."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift import schema as S
from netsift.operators import packets as P
from netsift.operators.drift import RESULT_COLUMNS
from netsift.plans import views as V
from netsift.plans.drift import _RES_COLS, _RESULT_SQL, _res
from netsift.plans.monitoring import _LIMIT_SQL, DAY_US, HOUR_US, IDLE, LIMIT, TIMEOUT_US, _FEED, alerts, beats, feed
from netsift.plans.packets import _COUNT_SQL, _ID, _PORT_CASE, KEYED_SQL
from netsift.plans.registry import ORACLES, query
from netsift.session import scratch_path
from netsift.streaming.decisions import ordered_cooldown, ordered_request_gate, ordered_service_health
from netsift.streaming.drift import monitor
from netsift.streaming.feed import read_feed
from netsift.streaming.flows import stream_flow_records, stream_flows
from netsift.streaming.folds import stream_rate_limit
from netsift.streaming.liveness import stream_liveness

QUERY_J1 = ORACLES["j1_flow_sessions"]
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _source(spark, df, name: str, parts: int = 3, cuts: list[float] | None = None):
    """The table as a stream of several micro-batches: parts of the time line, written one after the other and read in
    that order, so that event time advances from batch to batch. `cuts` gives the borders, else they are quantiles."""
    path = scratch_path(spark, name)
    ts = next(c for c in ("ts", "ts_us") if c in df.columns)
    cuts = cuts or sorted(set(df.select(F.col(ts).cast("double").alias("t")).approxQuantile("t", [i / parts for i in range(1, parts)], 0.01)))
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        t = F.col(ts).cast("double")
        part = df.where((F.lit(True) if lo is None else t >= lo) & (F.lit(True) if hi is None else t < hi))
        part.repartition(2, ts).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _drain(spark, stream, name: str, mode: str = "append"):
    sink, mark = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


@query("j1_stream_flow_sessions", QUERY_J1 + f" HAVING max(ts) + {IDLE} <= (SELECT max(ts) FROM packets) - 60")
def j1_stream(spark, sf_dir):
    # append mode emits only closed sessions; those still open at the end of the stream stay out
    out = _drain(spark, stream_flows(_source(spark, V.packets(spark, sf_dir), "packets"), IDLE), "flow-sessions")
    return out.select(*P.FLOW_KEY, F.round("stime", 3).alias("stime"), "spkts", "dpkts", "sbytes", "dbytes")


_CUT_SECONDS = 901_756_800  # 1998-07-30: the live flows come in two batches


def _batch_sql(batch: int, part: str) -> str:
    sides = V.SIDES_SQL.replace("live AS (", "live0 AS (", 1) + f", live AS (SELECT * FROM live0 WHERE {part})"
    return f"SELECT * FROM (WITH {sides}{_RESULT_SQL[len(V.SIDES_SQL):]} SELECT {batch} AS batch, (SELECT count(*) FROM live) AS batch_size, {_RES_COLS} FROM res)"


@query("j2_stream_drift", " UNION ALL ".join(_batch_sql(i, f"stime {sign} {_CUT_SECONDS}") for i, sign in enumerate(("<", ">="))))
def j2(spark, sf_dir):
    # the baseline is counted and stored before the stream starts; a batch is merged with its counts
    path, mark, out = scratch_path(spark, "drift-history"), scratch_path(spark, "drift-state"), scratch_path(spark, "drift-results")
    cols = [c for c in S.FLOW_COLUMNS if c in V.FLOW_TYPES]
    source = _source(spark, V.live(spark, sf_dir).select("stime", *[c for c in cols if c != "stime"]).withColumnRenamed("stime", "ts"), "live-flows", cuts=[_CUT_SECONDS])
    stream = source.withColumnRenamed("ts", "stime")

    def keep(doc, epoch):
        doc.select(F.lit(epoch).alias("batch"), "batch_size", F.explode("top_features").alias("f")).select("batch", "batch_size", "f.*").write.mode("overwrite").parquet(f"{out}/{epoch}")

    writer = monitor(stream, V.baseline(spark, sf_dir).select(*cols), path, mark, on_assessment=keep, top_n=len(cols))
    writer.trigger(availableNow=True).start().awaitTermination()
    return _res(spark.read.parquet(f"{out}/*").select("batch", "batch_size", *RESULT_COLUMNS))


@query("j3_stream_rate_limit", f"WITH RECURSIVE {_LIMIT_SQL} SELECT request_id, allowed FROM lim")
def j3_stream(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    s = _source(spark, V.requests(spark, sf_dir), "requests")
    return _drain(spark, stream_rate_limit(s, "client_id", "ts_us", ["request_id"], LIMIT, DAY_US), "limited").select("request_id", "allowed")


@query("j18_stream_class_counts", f"WITH {_FEED} SELECT prediction, count(*) AS n FROM feed GROUP BY prediction")
def j18_stream(spark, sf_dir):
    s = _source(spark, feed(spark, sf_dir), "feed")
    path = scratch_path(spark, "class-counts")

    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(path)

    counts = s.groupBy("prediction").agg(F.count("*").alias("n"))
    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch_path(spark, "counts-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


# an interval is emitted when the watermark, a minute behind the last event, has passed its end
_PASSED = "(SELECT (max(epoch_us(ts)) // 1000 - 60000) * 1000 FROM events)"


@query("j19_stream_liveness", f"SELECT * FROM ({ORACLES['j19_source_liveness']}) WHERE connected_until <= {_PASSED}")
def j19_stream(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    s = _source(spark, beats(spark, sf_dir), "beats")
    return _drain(spark, stream_liveness(s, "source", "ts_us", "kind", ["event_id"], TIMEOUT_US), "liveness")


# the flows of c15 by session: the session is a part of the key from the first packet of a flow on
_KEYED, _AFTER = KEYED_SQL.split("directed AS (", 1)
_SESSIONS_SQL = f"""{_KEYED.rstrip().rstrip(',').replace("keyed AS (", "keyed0 AS (")}, keyed AS (SELECT *, sum(brk) OVER (PARTITION BY lo_ip, lo_port, hi_ip, hi_port, proto ORDER BY ts, seq_no) AS sess
  FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY lo_ip, lo_port, hi_ip, hi_port, proto ORDER BY ts, seq_no) <= {IDLE} THEN 0 ELSE 1 END AS brk FROM keyed0)),
directed AS ({_AFTER.replace("hi_port, proto", "hi_port, proto, sess").replace("dsport, proto", "dsport, proto, sess")}"""
_MEASURED = ["stime", "ltime", "dur", "sload", "dload", "smeansz", "dmeansz", "sintpkt", "dintpkt", "sjit", "djit", "synack", "ackdat", "tcprtt"]
_COUNTED = ["sbytes", "dbytes", "spkts", "dpkts", "sttl", "dttl", "swin", "dwin", "stcpb", "dtcpb", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd", "is_sm_ips_ports", *P.CONNECTION_COUNTS]
_NEVER = ["sloss", "dloss", "trans_depth", "res_bdy_len"]


@query("j1_stream_flow_records", f"""WITH {_SESSIONS_SQL}, closed AS (SELECT *, {_PORT_CASE} AS service, greatest(ltime - stime, 1e-6) AS dur, CAST(srcip = dstip OR sport = dsport AS BIGINT) AS is_sm_ips_ports
  FROM counters JOIN gaps USING ({_ID}, sess) LEFT JOIN (SELECT {_ID}, sess, synack AS synack0, ackdat AS ackdat0 FROM shake) USING ({_ID}, sess)
  WHERE ltime + {IDLE} <= (SELECT max(ts) FROM packets) - 60),
f AS (SELECT * EXCLUDE (sess), sbytes / dur AS sload, dbytes / dur AS dload, CASE WHEN spkts > 0 THEN sbytes / spkts ELSE 0 END AS smeansz, CASE WHEN dpkts > 0 THEN dbytes / dpkts ELSE 0 END AS dmeansz,
  coalesce(synack0, 0) AS synack, coalesce(ackdat0, 0) AS ackdat, coalesce(ackdat0, 0) AS tcprtt, {_COUNT_SQL} FROM closed)
SELECT {_ID}, service, state, {', '.join(_COUNTED)}, {', '.join(f'0 AS {c}' for c in _NEVER)}, {', '.join(f'round({c}, 3) AS {c}' for c in _MEASURED)} FROM f""")
def j1_records(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    closed = _drain(spark, stream_flow_records(_source(spark, V.packets(spark, sf_dir), "packets"), IDLE), "flow-records")
    f = P.align(P.connection_counts(closed))
    return f.select(*[F.round(c, 3).alias(c) if c in _MEASURED else F.col(c) for c in f.columns])


def _decided(name: str) -> str:
    """The batch twin of decisions, on the requests that the watermark has passed."""
    sql = ORACLES[name]
    head, tail = sql.rsplit("\nSELECT request_id, ", 1) if "\nSELECT request_id, " in sql else sql.rsplit(" SELECT request_id, ", 1)
    return f"{head} SELECT * FROM (SELECT request_id, {tail}) WHERE request_id IN (SELECT request_id FROM requests WHERE ts_us <= {_PASSED})"


def _calls(spark, sf_dir):
    return _source(spark, V.requests(spark, sf_dir).withColumn("success", F.col("status") < 500).select("request_id", "client_id", "service", "ts_us", "success"), "calls")


@query("j5_stream_service_health", _decided("j5_service_health"))
def j5_stream(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    out = ordered_service_health(_calls(spark, sf_dir), "service", "ts_us", ["request_id"], "success", 3, 2 * HOUR_US)
    return _drain(spark, out, "health").select("request_id", "state", "executed", "state_after")


@query("j5_stream_request_gate", _decided("j5_request_gate"))
def j5_gate_stream(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    out = ordered_request_gate(_calls(spark, sf_dir), "client_id", "service", "ts_us", ["request_id"], "success", LIMIT, DAY_US, 3, 2 * HOUR_US)
    return _drain(spark, out, "gate").select("request_id", "allowed", "state", "executed")


@query("j11_stream_alert_cooldown", _decided("j11_alert_cooldown"))
def j11_stream(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return _drain(spark, ordered_cooldown(_source(spark, alerts(spark, sf_dir), "alerts"), "scenario", "ts_us", ["request_id"], 3_600.0), "fired").select("request_id", "fired")


@query("j17_stream_cursor", ORACLES["j17_cursor_read"])
def j17_stream(spark, sf_dir):
    # the feed grows in three steps; after each the same query is started again and goes on at its stored offset
    path, sink, mark = (scratch_path(spark, f"feed-{part}") for part in ("rows", "read", "state"))
    df = feed(spark, sf_dir)
    cuts = df.select(F.col("ts_us").cast("double").alias("t")).approxQuantile("t", [0.4, 0.8], 0.01)
    ddl = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = df.where((F.lit(True) if lo is None else F.col("ts_us") >= lo) & (F.lit(True) if hi is None else F.col("ts_us") < hi))
        part.write.mode("append").parquet(path)
        stream = read_feed(spark, path, ddl, 1_705_363_200_000_000)
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ddl).parquet(sink)
