"""Flow assembly over event time: a flow closes after an idle gap. Counters alone by session windows, full records by a fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.operators.packets import FLOW_KEY, _oriented, has_ftp, has_http_method, is_ftp_login, key_packets, rates, same_endpoint, service_of, tcp_state
from netsift.streaming.ordered import Rule, fold_in_order


def session_flows(keyed: DataFrame, idle_seconds: float = 60.0) -> DataFrame:
    """Flow sessions of keyed packets (operators.packets.key_packets) with an `event_time` timestamp.

    The same plan runs on a table and on a stream. Whether the lower endpoint opened the session is
    itself an aggregate, so both directions are added up and swapped at the end.
    """
    order = F.struct("ts", "seq_no")
    lo = F.col("from_lo")
    # a session includes a packet exactly one gap after the last one, hence the extra microsecond
    gap = F.session_window("event_time", f"{int(round(idle_seconds * 1_000_000)) + 1} microseconds")
    s = keyed.groupBy(*FLOW_KEY, gap.alias("session")).agg(
        F.min_by("from_lo", order).alias("first_lo"), F.min("ts").alias("stime"), F.max("ts").alias("ltime"),
        F.count_if(lo).alias("lo_pkts"), F.count_if(~lo).alias("hi_pkts"),
        F.coalesce(F.sum(F.when(lo, F.col("length"))), F.lit(0)).alias("lo_bytes"), F.coalesce(F.sum(F.when(~lo, F.col("length"))), F.lit(0)).alias("hi_bytes"),
        F.coalesce(F.max_by(F.when(F.col("proto") == "tcp", tcp_state("flags")), order), F.lit("INT")).alias("state"))
    first = F.col("first_lo")
    swap = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return s.select(
        *FLOW_KEY, "session", swap("lo_ip", "hi_ip").alias("srcip"), swap("lo_port", "hi_port").alias("sport"), swap("hi_ip", "lo_ip").alias("dstip"),
        swap("hi_port", "lo_port").alias("dsport"), "stime", "ltime", F.greatest(F.col("ltime") - F.col("stime"), F.lit(1e-6)).alias("dur"),
        swap("lo_pkts", "hi_pkts").alias("spkts"), swap("hi_pkts", "lo_pkts").alias("dpkts"), swap("lo_bytes", "hi_bytes").alias("sbytes"),
        swap("hi_bytes", "lo_bytes").alias("dbytes"), "state")


def stream_flows(packets: DataFrame, idle_seconds: float = 60.0, lateness: str = "1 minute") -> DataFrame:
    """Streaming form: packets with a `ts` in epoch seconds; closed flows are emitted in append mode."""
    timed = key_packets(packets).withColumn("event_time", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long")))
    return session_flows(timed.withWatermark("event_time", lateness), idle_seconds)


class FlowFold(Rule):
    """The features of operators.packets that depend on order, for one flow: counters, first and last values, gaps and handshake.

    An event is (micros, seq_no, ts, from_lo, length, ttl, window, tcp_seq, flags, state, http, login, ftp); state is null
    for a packet that isn't TCP. The state of a flow is one small document, however long the flow is.
    """

    OUTPUTS = ("first_lo boolean, stime double, ltime double, sbytes long, dbytes long, spkts long, dpkts long, sttl long, dttl long, swin long, dwin long, stcpb long, dtcpb long, "
               "state string, ct_flw_http_mthd long, is_ftp_login long, ct_ftp_cmd long, sintpkt double, sjit double, dintpkt double, djit double, synack double, ackdat double")

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def step(self, state, event):
        micros, _, ts, from_lo, length, ttl, window, tcp_seq, flags, tcp, http, login, ftp = event
        s = state or {"first": bool(from_lo), "stime": ts, "state": "INT", "http": 0, "login": 0, "ftp": 0, "syn": None, "reply": None, "ackdat": None,
                      "sides": [{"bytes": 0, "pkts": 0, "ttl": 0, "win": 0, "seq": 0, "last": None, "mean": 0.0, "m2": 0.0} for _ in range(2)]}
        fwd = bool(from_lo) == s["first"]
        side = s["sides"][0 if fwd else 1]
        if side["last"] is not None:  # mean and squared deviations of the gaps, one at a time
            gap = ts - side["last"]
            away = gap - side["mean"]
            side["mean"] += away / side["pkts"]
            side["m2"] += away * (gap - side["mean"])
        side["last"], side["pkts"], side["bytes"], side["ttl"] = ts, side["pkts"] + 1, side["bytes"] + int(length or 0), int(ttl or 0)
        if tcp is not None:
            flags = int(flags or 0)
            s["state"], side["win"] = tcp, int(window or 0)
            side["seq"] = side["seq"] or int(tcp_seq or 0)
            if fwd and flags & 0x02 and not flags & 0x10:
                s["syn"] = ts
            seen = s["syn"] or None
            if not fwd and flags & 0x12 and seen is not None:
                s["reply"] = max(ts - seen, 0.0)
            wait = max(ts - (ts if seen is None else seen), 0.0)
            if fwd and flags & 0x10 and (s["reply"] or 0) > 0 and wait > 0 and s["ackdat"] is None:
                s["ackdat"] = wait
        s["http"], s["login"], s["ftp"] = max(s["http"], int(http)), max(s["login"], int(login)), s["ftp"] + int(ftp)
        s["ltime"], s["until"] = ts, int(micros) + self.idle_us + 1
        return s, []

    def deadline(self, state) -> int:
        return state["until"]

    def close(self, s):
        a, b = s["sides"]
        gaps = [v for side in (a, b) for v in (side["mean"], (side["m2"] / (side["pkts"] - 1)) ** 0.5 if side["pkts"] > 1 else 0.0)]
        return [(s["first"], s["stime"], s["ltime"], a["bytes"], b["bytes"], a["pkts"], b["pkts"], a["ttl"], b["ttl"], a["win"], b["win"], a["seq"], b["seq"], s["state"],
                 s["http"], s["login"], s["ftp"], *gaps, s["reply"] or 0.0, s["ackdat"] or 0.0)]


def stream_flow_records(packets: DataFrame, idle_seconds: float = 60.0, lateness: str = "1 minute") -> DataFrame:
    """Full records of closed flows but for the connection counts, which are over all flows of a capture
    (operators.packets.connection_counts on the written records)."""
    p = key_packets(packets)
    tcp = F.col("proto") == "tcp"
    p = p.select(*FLOW_KEY, F.round(F.col("ts") * 1e6).cast("long").alias("micros"), "seq_no", "ts", "from_lo", "length", "ttl", "window", "tcp_seq", "flags",
                 F.when(tcp, tcp_state("flags")).alias("state"), has_http_method("payload").alias("http"),
                 F.coalesce(is_ftp_login("payload"), F.lit(False)).alias("login"), has_ftp("payload").alias("ftp"))
    closed = fold_in_order(p, FlowFold(int(round(idle_seconds * 1_000_000))), FLOW_KEY, "micros", [c for c in p.columns if c not in [*FLOW_KEY, "micros"]], FlowFold.OUTPUTS, lateness)
    flows = rates(_oriented(closed)).withColumn("service", service_of("dsport", "proto")).withColumn("tcprtt", F.col("ackdat"))
    return same_endpoint(flows).drop("lo_ip", "lo_port", "hi_ip", "hi_port", "first_lo")
