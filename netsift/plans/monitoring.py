"""J: request log, alerting and feed queries over the whole event and page tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.operators import alerts as A
from netsift.operators import folds as J
from netsift.operators import packets as P
from netsift.operators import requests as R
from netsift.plans import views as V
from netsift.plans.packets import KEYED_SQL
from netsift.plans.registry import query

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
_R = V.REQUESTS_SQL


def _r(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- J1: flows that close after an idle gap, the batch twin of the streaming form -----------------

IDLE = 21_600.0


@query("j1_flow_sessions", f"""WITH {KEYED_SQL}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= {IDLE} THEN 0 ELSE 1 END AS brk FROM keyed WINDOW w AS (PARTITION BY lo_ip, lo_port, hi_ip, hi_port, proto ORDER BY ts)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY lo_ip, lo_port, hi_ip, hi_port, proto ORDER BY ts) AS sess FROM g),
f AS (SELECT *, from_lo = first_value(from_lo) OVER (PARTITION BY lo_ip, lo_port, hi_ip, hi_port, proto, sess ORDER BY ts, seq_no) AS fwd FROM s)
SELECT lo_ip, lo_port, hi_ip, hi_port, proto, round(min(ts), 3) AS stime, count(*) FILTER (fwd) AS spkts, count(*) FILTER (NOT fwd) AS dpkts,
  coalesce(sum(length) FILTER (fwd), 0) AS sbytes, coalesce(sum(length) FILTER (NOT fwd), 0) AS dbytes FROM f GROUP BY lo_ip, lo_port, hi_ip, hi_port, proto, sess""")
def j1(spark, sf_dir):
    from netsift.streaming.flows import session_flows

    p = V.packets(spark, sf_dir)
    s = session_flows(P.key_packets(p).withColumn("event_time", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long"))), IDLE)
    return s.select(*P.FLOW_KEY, F.round("stime", 3).alias("stime"), "spkts", "dpkts", "sbytes", "dbytes")


# --- J3..J5: decisions ----------------------------------------------------------------------------

LIMIT = 3


def limited(spark, sf_dir):
    return J.rate_limit(V.requests(spark, sf_dir), "client_id", "ts_us", ["request_id"], LIMIT, DAY_US)


_LIMIT_SQL = f"""{_R}, acc AS (SELECT client_id, arg_min(request_id, ts_us) AS request_id, min(ts_us) AS ts_us, [min(ts_us)] AS recent FROM requests GROUP BY client_id
  UNION ALL SELECT client_id, request_id, ts_us, CASE WHEN len(recent) >= {LIMIT} THEN list_append(recent[2:], ts_us) ELSE list_append(recent, ts_us) END
  FROM (SELECT a.client_id, arg_min(r.request_id, r.ts_us) AS request_id, min(r.ts_us) AS ts_us, a.recent FROM acc a JOIN requests r ON r.client_id = a.client_id AND r.ts_us > a.ts_us
    AND (len(a.recent) < {LIMIT} OR r.ts_us >= a.recent[1] + {DAY_US}) GROUP BY a.client_id, a.recent)),
lim AS (SELECT r.*, a.request_id IS NOT NULL AS allowed FROM requests r LEFT JOIN acc a USING (request_id))"""


@query("j3_rate_limit", f"WITH RECURSIVE {_LIMIT_SQL} SELECT request_id, allowed FROM lim")
def j3(spark, sf_dir):
    return limited(spark, sf_dir).select("request_id", "allowed")


@query("j3_denied_total", f"WITH RECURSIVE {_LIMIT_SQL} SELECT count(*) FILTER (NOT allowed) AS denied FROM lim")
def j3_total(spark, sf_dir):
    return J.denied_total(limited(spark, sf_dir))


@query("j4_remaining_quota", f"WITH RECURSIVE {_LIMIT_SQL} SELECT request_id, CAST({LIMIT} - count(*) FILTER (allowed) OVER (PARTITION BY client_id ORDER BY ts_us RANGE BETWEEN {DAY_US - 1} PRECEDING AND CURRENT ROW) AS INTEGER) AS remaining FROM lim")
def j4(spark, sf_dir):
    return J.remaining_quota(limited(spark, sf_dir), "client_id", "ts_us", LIMIT, DAY_US).select("request_id", "remaining")


def breaker(spark, sf_dir, gate=False):
    r = V.requests(spark, sf_dir).withColumn("success", F.col("status") < 500)
    if gate:
        return J.request_gate(r, "client_id", "service", "ts_us", ["request_id"], "success", LIMIT, DAY_US, 3, 2 * HOUR_US, chunk_us=DAY_US)
    return J.service_health(r, "service", "ts_us", ["request_id"], "success", 3, 2 * HOUR_US, chunk_us=12 * HOUR_US)


_CB_STEP = """SELECT service, n, ts_us, request_id, seen, seen <> 'open' AS executed,
  CASE WHEN seen = 'open' THEN 'open' WHEN ok THEN CASE WHEN seen = 'half_open' AND pr + 1 >= 3 THEN 'closed' ELSE seen END WHEN seen = 'half_open' OR f + 1 >= 3 THEN 'open' ELSE 'closed' END AS st,
  CASE WHEN seen = 'open' THEN f WHEN ok THEN CASE WHEN seen = 'half_open' THEN CASE WHEN pr + 1 >= 3 THEN 0 ELSE f END ELSE greatest(f - 1, 0) END ELSE f + 1 END AS f,
  CASE WHEN seen <> 'open' AND NOT ok THEN ts_us ELSE last END AS last, CASE WHEN seen = 'half_open' AND ok THEN pr + 1 ELSE pr END AS pr"""


def _cb_sql(source: str) -> str:
    return f"""rq AS (SELECT service, ts_us, request_id, status < 500 AS ok, row_number() OVER (PARTITION BY service ORDER BY ts_us, request_id) AS n FROM {source}),
cb AS (SELECT DISTINCT service, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ts_us, CAST(-1 AS BIGINT) AS request_id, 'closed' AS seen, true AS executed, 'closed' AS st, CAST(0 AS BIGINT) AS f, CAST(NULL AS BIGINT) AS last, CAST(0 AS BIGINT) AS pr FROM rq
  UNION ALL {_CB_STEP} FROM (SELECT r.service, r.n, r.ts_us, r.request_id, r.ok, c.f, c.last, CASE WHEN c.st = 'open' AND r.ts_us - c.last >= {2 * HOUR_US} THEN 'half_open' ELSE c.st END AS seen,
    CASE WHEN c.st = 'open' AND r.ts_us - c.last >= {2 * HOUR_US} THEN 0 ELSE c.pr END AS pr FROM cb c JOIN rq r ON r.service = c.service AND r.n = c.n + 1))"""


@query("j5_service_health", f"WITH RECURSIVE {_R}, {_cb_sql('requests')} SELECT request_id, seen AS state, executed, st AS state_after FROM cb WHERE n > 0")
def j5(spark, sf_dir):
    return breaker(spark, sf_dir).select("request_id", "state", "executed", "state_after")


@query("j5_request_gate", f"""WITH RECURSIVE {_LIMIT_SQL}, passed AS (SELECT * FROM lim WHERE allowed), {_cb_sql('passed')}
SELECT request_id, allowed, seen AS state, coalesce(executed, false) AS executed FROM lim LEFT JOIN (SELECT request_id, seen, executed FROM cb WHERE n > 0) USING (request_id)""")
def j5_gate(spark, sf_dir):
    return breaker(spark, sf_dir, gate=True).select("request_id", "allowed", "state", "executed")


# --- J6..J9: metrics ------------------------------------------------------------------------------

@query("j6_request_metrics", f"""WITH {_R}, n AS (SELECT max(ts_us) AS now, min(ts_us) AS first FROM requests), rec AS (SELECT latency_ms FROM requests, n WHERE ts_us > now - CAST({5 * DAY_US} AS BIGINT))
SELECT count(*) AS total_requests, count(*) FILTER (status < 500) AS successful_requests, count(*) FILTER (status >= 500) AS failed_requests, (SELECT round(avg(latency_ms), 6) FROM rec) AS avg_latency_ms,
  (SELECT list_sort(list(latency_ms))[least(CAST(floor(count(*) * 95 / 100.0) AS BIGINT), count(*) - 1) + 1] FROM rec) AS p95_latency_ms, (SELECT list_sort(list(latency_ms))[least(CAST(floor(count(*) * 99 / 100.0) AS BIGINT), count(*) - 1) + 1] FROM rec) AS p99_latency_ms,
  round(count(*) / ((max(ts_us) - min(ts_us)) / 1e6), 6) AS requests_per_second, 0 AS rate_limited_requests FROM requests""")
def j6(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    now = r.agg(F.max("ts_us")).first()[0]
    return _r(R.metrics(r, now, 5 * 86_400, success=F.col("status") < 500))


@query("j6_windowed_metrics", f"WITH {_R} SELECT ts_us // {DAY_US} AS day, count(*) AS total_requests, count(*) FILTER (status >= 500) AS failed_requests, round(avg(latency_ms), 6) AS avg_latency_ms FROM requests GROUP BY 1")
def j6_windows(spark, sf_dir):
    r = V.requests(spark, sf_dir).withColumn("ts", F.timestamp_micros("ts_us"))
    m = R.windowed_metrics(r, 86_400, F.col("status") < 500)
    return _r(m.select(F.floor(F.unix_micros("w.start") / DAY_US).alias("day"), "total_requests", "failed_requests", "avg_latency_ms"))


_IDX = "list_sort(list(latency_ms))[greatest(least(CAST({0} AS BIGINT), count(*) - 1), 0) + 1]"


@query("j7_latency_percentiles", f"WITH {_R} SELECT service, {_IDX.format('floor(count(*) * 95 / 100.0)')} AS p95, {_IDX.format('floor(count(*) * 99 / 100.0)')} AS p99 FROM requests GROUP BY service")
def j7(spark, sf_dir):
    return R.percentile_by_index(V.requests(spark, sf_dir), "latency_ms", [95, 99], ["service"])


@query("j7_nearest_rank", f"WITH {_R} SELECT service, {_IDX.format('ceil(count(*) * 95 / 100.0) - 1')} AS p95, {_IDX.format('ceil(count(*) * 99 / 100.0) - 1')} AS p99 FROM requests GROUP BY service")
def j7_nearest(spark, sf_dir):
    return R.percentile_by_index(V.requests(spark, sf_dir), "latency_ms", [95, 99], ["service"], nearest_rank=True)


@query("j8_health_verdict", f"""WITH RECURSIVE {_R}, {_cb_sql('requests')}, st AS (SELECT service, arg_max(st, n) AS circuit_state FROM cb GROUP BY service)
SELECT service, circuit_state, count(*) AS total_requests, CASE WHEN circuit_state = 'open' OR count(*) FILTER (status >= 500) > count(*) FILTER (status < 500) * 0.1 THEN 'degraded' ELSE 'healthy' END AS status,
  round(count(*) FILTER (status >= 500) / count(*), 6) AS error_rate FROM requests JOIN st USING (service) GROUP BY service, circuit_state""")
def j8(spark, sf_dir):
    d = breaker(spark, sf_dir)
    counts = d.groupBy("service").agg(F.count("*").alias("total_requests"), F.count_if("success").alias("successful_requests"), F.count_if(~F.col("success")).alias("failed_requests"))
    return _r(R.health_verdict(counts.join(R.latest_state(d, "service", "ts_us", ["request_id"]), "service")).drop("successful_requests", "failed_requests"))


@query("j9_load_summary", f"WITH {_R} SELECT count(*) AS requests, count(*) FILTER (status >= 500) AS failures, round(count(*) FILTER (status >= 500) / count(*), 6) AS fail_ratio, round(avg(latency_ms), 6) AS avg_ms, round(quantile_cont(latency_ms, 0.5), 6) AS median_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms, round(count(*) / ((max(ts_us) - min(ts_us)) / 1e6), 6) AS rps FROM requests")
def j9(spark, sf_dir):
    return _r(R.load_summary(V.requests(spark, sf_dir), F.col("status") >= 500))


# --- J10..J13: watch list -------------------------------------------------------------------------

_MATCH = "CASE WHEN {0} IN ('m.ththth.example.net') THEN 'dos' WHEN {0} = 'example.com' OR ends_with({0}, '.example.com') THEN 'exploits' WHEN {0} = 'example.net' OR ends_with({0}, '.example.net') THEN 'recon' WHEN {0} = 'example.org' OR ends_with({0}, '.example.org') THEN 'generic' END"
_D = V.DNS_SQL + ", m AS (SELECT *, " + _MATCH.format("qname") + " AS scenario FROM dns)"
POLL_US = 6 * HOUR_US


@query("j10_watch_list_match", f"WITH {_D} SELECT qname, scenario, count(*) AS n FROM m GROUP BY 1, 2")
def j10(spark, sf_dir):
    d = V.dns(spark, sf_dir).withColumn("qname", F.concat(F.upper("qname"), F.lit(".")))
    return d.groupBy(A.clean_host("qname").alias("qname"), A.match_scenario("qname", V.WATCH).alias("scenario")).agg(F.count("*").alias("n"))


def alerts(spark, sf_dir):
    e = V.requests(spark, sf_dir)
    return e.select("request_id", "ts_us", F.concat(F.lit("s"), F.col("client_id").cast("long") % 5).alias("scenario"))


@query("j11_alert_cooldown", f"""WITH RECURSIVE {_R}, al AS (SELECT request_id, ts_us, 's' || (CAST(client_id AS BIGINT) % 5) AS scenario FROM requests),
fr AS (SELECT scenario, min(ts_us) AS ts_us FROM al GROUP BY scenario UNION ALL SELECT fr.scenario, min(al.ts_us) FROM fr JOIN al ON al.scenario = fr.scenario AND al.ts_us >= fr.ts_us + {HOUR_US} GROUP BY fr.scenario)
SELECT request_id, f.ts_us IS NOT NULL AS fired FROM al LEFT JOIN fr f ON f.scenario = al.scenario AND f.ts_us = al.ts_us""")
def j11(spark, sf_dir):
    return J.cooldown(alerts(spark, sf_dir), "scenario", "ts_us", ["request_id"], 3_600.0).select("request_id", "fired")


@query("j12_newly_seen_domains", f"""WITH {_D}, sn AS (SELECT DISTINCT host_id, ts_us // {POLL_US} AS snapshot, qname AS domain, scenario FROM m WHERE scenario IS NOT NULL)
SELECT host_id, snapshot, domain, scenario FROM sn a WHERE snapshot > (SELECT min(snapshot) FROM sn b WHERE b.host_id = a.host_id) AND NOT EXISTS (SELECT 1 FROM sn b WHERE b.host_id = a.host_id AND b.domain = a.domain AND b.snapshot = a.snapshot - 1)""")
def j12(spark, sf_dir):
    return A.new_watched_domains(V.dns(spark, sf_dir), POLL_US, V.WATCH)


@query("j13_watched_connections", f"""WITH {_D}, ip AS (SELECT remote_ip, arg_max(scenario, ts_us) AS scenario FROM m WHERE scenario IS NOT NULL GROUP BY remote_ip), sn AS (SELECT DISTINCT host_id, ts_us // {POLL_US} AS snapshot, remote_ip FROM m)
SELECT a.host_id, a.snapshot, a.remote_ip, ip.scenario FROM sn a JOIN ip USING (remote_ip) WHERE NOT EXISTS (SELECT 1 FROM sn b WHERE b.host_id = a.host_id AND b.remote_ip = a.remote_ip AND b.snapshot = a.snapshot - 1)""")
def j13(spark, sf_dir):
    d = V.dns(spark, sf_dir)
    return A.new_watched_connections(d, A.watched_addresses(d, V.WATCH), POLL_US)


# --- J14..J19: scenarios, feed, liveness ----------------------------------------------------------

DURATIONS = {"exploits": 4_500, "dos": 3_000, "recon": 4_000, "generic": 3_500}
_TAG = f"""{V.TRIGGERS_SQL}, {_R}, j AS (SELECT r.*, t.ts_us AS t0, t.scenario_key AS k FROM requests r ASOF LEFT JOIN triggers t ON r.ts_us >= t.ts_us),
tag AS (SELECT request_id, ts_us, CASE WHEN ts_us <= t0 + CASE k WHEN 'exploits' THEN 4500000000 WHEN 'dos' THEN 3000000000 WHEN 'recon' THEN 4000000000 WHEN 'generic' THEN 3500000000 END THEN k END AS scenario_key FROM j)"""


def tagged(spark, sf_dir):
    return A.tag_scenarios(V.requests(spark, sf_dir), V.triggers(spark, sf_dir), DURATIONS)


@query("j14_scenario_window_tag", f"WITH {_TAG} SELECT request_id, scenario_key FROM tag")
def j14(spark, sf_dir):
    return tagged(spark, sf_dir).select("request_id", "scenario_key")


@query("j15_scenario_enrichment", f"WITH {_TAG} SELECT scenario_key, CASE scenario_key WHEN 'exploits' THEN 'Exploits' WHEN 'dos' THEN 'DoS' WHEN 'recon' THEN 'Reconnaissance' WHEN 'generic' THEN 'Generic' END AS label, CASE scenario_key WHEN 'exploits' THEN 45 WHEN 'dos' THEN 30 WHEN 'recon' THEN 40 WHEN 'generic' THEN 35 END AS duration, count(*) AS n FROM tag GROUP BY 1")
def j15(spark, sf_dir):
    return A.enrich_scenarios(tagged(spark, sf_dir)).groupBy("scenario_key", "label", "duration").agg(F.count("*").alias("n"))


def feed(spark, sf_dir, since_us: int | None = None):
    r = V.requests(spark, sf_dir, since_us)
    return r.select(F.col("request_id").alias("flow_no"), "ts_us", F.when(F.col("status") == 200, "Normal").when(F.col("latency_ms") > 40, "DoS").otherwise("Exploits").alias("prediction"))


_FEED = f"{_R}, feed AS (SELECT request_id AS flow_no, ts_us, CASE WHEN status = 200 THEN 'Normal' WHEN latency_ms > 40 THEN 'DoS' ELSE 'Exploits' END AS prediction FROM requests)"


@query("j16_latest_flows", f"WITH {_FEED} SELECT * FROM feed ORDER BY ts_us DESC LIMIT 200")
def j16(spark, sf_dir):
    return A.latest(feed(spark, sf_dir), 500)


@query("j17_cursor_read", f"WITH {_FEED} SELECT * FROM feed WHERE ts_us > epoch_us(TIMESTAMP '2024-01-16')")
def j17(spark, sf_dir):
    return feed(spark, sf_dir, since_us=1_705_363_200_000_000)


@query("j18_feed_stats", f"""WITH {_FEED} SELECT count(*) AS total_flows, count(*) FILTER (prediction = 'Normal') AS normal_flows, count(*) FILTER (prediction <> 'Normal') AS attack_flows, round(100.0 * count(*) FILTER (prediction <> 'Normal') / count(*), 2) AS attack_rate_pct,
  (SELECT '{{' || string_agg('"' || prediction || '":' || n, ',' ORDER BY prediction) || '}}' FROM (SELECT prediction, count(*) AS n FROM feed GROUP BY prediction)) AS class_counts FROM feed""")
def j18(spark, sf_dir):
    return A.feed_stats(feed(spark, sf_dir)).withColumn("class_counts", F.to_json("class_counts"))


@query("j18_class_counts", f"WITH {_FEED} SELECT prediction, count(*) AS n FROM feed GROUP BY prediction")
def j18_counts(spark, sf_dir):
    return A.class_counts(feed(spark, sf_dir))


TIMEOUT_US = 4 * HOUR_US


def beats(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "connect").when(F.col("event_type") == "error", "disconnect").otherwise("heartbeat")
    from netsift.functions.cleaning import epoch_micros

    return e.select("event_id", (F.col("user_id") % 7).alias("source"), epoch_micros("ts").alias("ts_us"), kind.alias("kind"))


@query("j19_source_liveness", f"""WITH hb AS (SELECT event_id, user_id % 7 AS source, epoch_us(ts) AS t, CASE event_type WHEN 'signup' THEN 'connect' WHEN 'error' THEN 'disconnect' ELSE 'heartbeat' END AS kind FROM events),
c AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR lag(kind) OVER w = 'disconnect' OR t - lag(t) OVER w > {TIMEOUT_US} THEN 1 ELSE 0 END AS cut FROM hb WINDOW w AS (PARTITION BY source ORDER BY t)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY source ORDER BY t) AS run FROM c)
SELECT source, min(t) FILTER (kind = 'connect') AS connected_from, CASE WHEN arg_max(kind, t) = 'disconnect' THEN max(t) ELSE max(t) + {TIMEOUT_US} END AS connected_until FROM r GROUP BY source, run HAVING count(*) FILTER (kind = 'connect') > 0""")
def j19(spark, sf_dir):
    return A.liveness(beats(spark, sf_dir), "source", "ts_us", "kind", ["event_id"], TIMEOUT_US)
