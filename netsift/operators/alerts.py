"""Watch-list matching, snapshots, scenario windows, live feed queries and source liveness."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift import schema as S
from netsift.functions.scaling import carry_forward, lag_across


def clean_host(qname) -> Column:
    q = F.col(qname) if isinstance(qname, str) else qname
    return F.rtrim(F.lower(q), F.lit("."))


def match_scenario(qname, watch: list[tuple[str, str]] = S.WATCH_DOMAINS) -> Column:
    """Scenario of a host name: the exact domain first, else the first listed parent domain, else NULL.

    The name's own suffixes are looked up in the (fixed, short) list, so matching is row-local.
    """
    listed = F.create_map(*[x for i, (d, s) in enumerate(watch) for x in (F.lit(d), F.struct(F.lit(i).alias("pos"), F.lit(s).alias("scenario")))])
    labels = F.split(clean_host(qname), "\\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(labels, i, n), ".").alias("d")))
    hits = F.filter(F.transform(suffixes, lambda s: F.struct(
        F.when(s["i"] == 1, -1).otherwise(F.element_at(listed, s["d"])["pos"]).alias("rank"), F.element_at(listed, s["d"])["scenario"].alias("scenario"))),
        lambda h: h["scenario"].isNotNull())
    return F.array_min(hits)["scenario"]


def snapshots(df: DataFrame, host: str, value: str, ts: str, poll_us: int) -> DataFrame:
    """Distinct values per host and poll number."""
    return df.select(host, F.floor(F.col(ts) / F.lit(poll_us)).cast("long").alias("snapshot"), value).distinct()


def newly_seen(snaps: DataFrame, host: str, value: str, skip_first: bool) -> DataFrame:
    """Values in a snapshot that the host's previous poll did not have.

    With `skip_first` the host's first snapshot only sets the scene and reports nothing.
    """
    before = snaps.select(host, (F.col("snapshot") + 1).alias("snapshot"), value)
    fresh = snaps.join(before, [host, "snapshot", value], "left_anti")
    if not skip_first:
        return fresh
    first = snaps.groupBy(host).agg(F.min("snapshot").alias("_first"))
    return fresh.join(first, host).where(F.col("snapshot") > F.col("_first")).drop("_first")


def new_watched_domains(dns: DataFrame, poll_us: int, watch=S.WATCH_DOMAINS) -> DataFrame:
    matched = dns.withColumn("domain", clean_host("qname")).withColumn("scenario", match_scenario("qname", watch)).where("scenario is not null")
    fresh = newly_seen(snapshots(matched, "host_id", "domain", "ts_us", poll_us), "host_id", "domain", skip_first=True)
    return fresh.withColumn("scenario", match_scenario("domain", watch))


def watched_addresses(dns: DataFrame, watch=S.WATCH_DOMAINS) -> DataFrame:
    """remote ip -> scenario, from look-ups of watched names; the latest look-up wins."""
    m = dns.withColumn("scenario", match_scenario("qname", watch)).where("scenario is not null")
    return m.groupBy("remote_ip").agg(F.max_by("scenario", F.struct("ts_us", "qname")).alias("scenario"))


def new_watched_connections(connections: DataFrame, addresses: DataFrame, poll_us: int) -> DataFrame:
    """Connections that opened since the host's previous poll and lead to a watched address."""
    fresh = newly_seen(snapshots(connections, "host_id", "remote_ip", "ts_us", poll_us), "host_id", "remote_ip", skip_first=False)
    return fresh.join(addresses, "remote_ip")


def scenario_table(spark) -> DataFrame:
    return spark.createDataFrame(S.SCENARIOS, "scenario_key string, label string, source_domain string, description string, hint string, duration int")


def tag_scenarios(flows: DataFrame, triggers: DataFrame, durations: dict[str, int], ts: str = "ts_us", bucket_us: int = 900_000_000) -> DataFrame:
    """Adds `scenario_key` of the scenario active at each flow: the latest trigger at or before it, while
    its duration (seconds) lasts. A "normal" trigger clears.

    A trigger is active over an interval that ends with its duration or before the next trigger. Intervals are
    entered under the time buckets they touch, and flows look in their bucket; flows are neither sorted nor shuffled
    by time alone.
    """
    length = F.element_at(F.create_map(*[x for k, s in durations.items() for x in (F.lit(k), F.lit(int(s) * 1_000_000))]), F.col("scenario_key"))
    # the next trigger is the previous one on the reversed line, which is cut into days
    back = triggers.select("ts_us", "scenario_key", (-F.col("ts_us")).alias("_back"), (-F.col("trigger_id")).alias("_id"), F.floor(-F.col("ts_us") / F.lit(86_400_000_000)).alias("_seg"))
    back = lag_across(back, [], "_seg", ["_back", "_id"], "ts_us", "_next")
    following = F.col("_next")
    spans = (back.select(F.col("ts_us").alias("_from"), "scenario_key", F.least(F.col("ts_us") + length, F.coalesce(following - 1, F.col("ts_us") + length)).alias("_to"))
             .where((F.col("_to") >= F.col("_from")) & F.col("scenario_key").isin(list(durations))))
    bucket = lambda t: F.floor(t / F.lit(bucket_us)).cast("long")
    entered = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_from")), bucket(F.col("_to")))))
    rows = flows.withColumn("_at", bucket(F.col(ts)))
    inside = (F.col("_at") == F.col("_bucket")) & (F.col(ts) >= F.col("_from")) & (F.col(ts) <= F.col("_to"))
    return rows.join(entered, inside, "left").select(*flows.columns, "scenario_key")


def enrich_scenarios(flows: DataFrame) -> DataFrame:
    """Label, domain, description, hint and duration of the scenario (five fixed rows, broadcast)."""
    return flows.join(F.broadcast(scenario_table(flows.sparkSession)), "scenario_key", "left")


def latest(flows: DataFrame, n: int = 50, ts: str = "ts_us", tie: str = "flow_no") -> DataFrame:
    """The newest n flows (n clamped to 1..200), oldest first."""
    return flows.orderBy(F.desc(ts), F.desc(tie)).limit(max(1, min(int(n), 200))).orderBy(ts, tie)


def since(flows: DataFrame, ts: str, cursor_us: int) -> DataFrame:
    """Rows later than the cursor. `ts` is a stored time or number of microseconds, which is compared with a constant
    of its own type, so that the scan can skip what is older."""
    kind = flows.schema[ts].dataType.simpleString()
    moment = datetime(1970, 1, 1) + timedelta(microseconds=cursor_us)
    if kind == "timestamp_ntz":
        return flows.where(F.col(ts) > F.lit(moment).cast("timestamp_ntz"))
    if kind == "timestamp":
        return flows.where(F.col(ts) > F.lit(moment.replace(tzinfo=timezone.utc)))
    return flows.where(F.col(ts) > cursor_us)


def class_counts(flows: DataFrame, col: str = "prediction") -> DataFrame:
    return flows.groupBy(col).agg(F.count("*").alias("n"))


def feed_stats(flows: DataFrame, col: str = "prediction") -> DataFrame:
    """Total (at least 1), normal and attack counts, attack rate in percent, counts per class."""
    per = class_counts(flows, col)
    s = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(F.col(col) == "Normal", F.col("n"))), F.lit(0)).alias("normal_flows"),
                F.map_from_entries(F.array_sort(F.collect_list(F.struct(col, "n")))).alias("class_counts"))
    total = F.greatest("t", F.lit(1))
    attack = F.col("t") - F.col("normal_flows")
    return s.select(total.alias("total_flows"), "normal_flows", attack.alias("attack_flows"), F.round(100 * attack / total, 2).alias("attack_rate_pct"), "class_counts")


def liveness(events: DataFrame, source: str, ts: str, kind: str, order: list[str], timeout_us: int = 90_000_000, segment_us: int | None = None) -> DataFrame:
    """Connected intervals per source from connect / heartbeat / disconnect events.

    A run of events ends after a disconnect or a silence longer than the timeout. In a run, the source is
    connected from its first connect until the disconnect, or until the timeout after the last event.
    """
    seg = max(int(segment_us or 0), 10 * timeout_us)
    e = events.withColumn("_seg", F.floor(F.col(ts) / F.lit(seg))).withColumn("_pair", F.struct(F.col(ts).alias("t"), F.col(kind).alias("k")))
    e = lag_across(e, [source], "_seg", [ts, *order], "_pair", "_prev")
    cut = F.col("_prev").isNull() | (F.col("_prev.k") == "disconnect") | (F.col(ts) - F.col("_prev.t") > timeout_us)
    run = F.when(cut, F.struct(F.col(ts), *order))
    e = carry_forward(e, [source], "_seg", [ts, *order], run, "_run")
    per = e.groupBy(source, "_run").agg(
        F.min(F.when(F.col(kind) == "connect", F.col(ts))).alias("connected_from"), F.max(ts).alias("_last"),
        F.max_by(kind, F.struct(ts, *order)).alias("_kind"))
    until = F.when(F.col("_kind") == "disconnect", F.col("_last")).otherwise(F.col("_last") + timeout_us)
    return per.where("connected_from is not null").select(source, "connected_from", until.alias("connected_until"))


def connected_at(intervals: DataFrame, at_us: int, source: str) -> DataFrame:
    on = (F.col("connected_from") <= at_us) & (F.col("connected_until") >= at_us)
    return intervals.groupBy(source).agg(F.max(on).alias("connected"))

