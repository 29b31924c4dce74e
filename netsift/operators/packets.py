"""Packets to bidirectional flows, and the features computed per flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift import schema as S
from netsift.functions.cleaning import to_number
from netsift.functions.scaling import carry_forward, null_safe_join
from netsift.session import materialize

FLOW_KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port", "proto"]
ORDER = ["ts", "seq_no"]


def service_of(port, proto) -> Column:
    """Service name of a destination port."""
    port, proto = (F.col(c) if isinstance(c, str) else c for c in (port, proto))
    names = F.create_map(*[F.lit(v) for kv in S.PORT_SERVICES.items() for v in kv])
    return F.coalesce(
        F.element_at(names, port.cast("int")),
        F.when((proto == "udp") & (port == 67), F.lit("dhcp")),
        F.lit("other"),
    )


def tcp_state(flags) -> Column:
    """State by flag precedence RST, FIN, SYN or ACK; `& 0x12` already covers both single flags."""
    flags = F.col(flags) if isinstance(flags, str) else flags
    hit = lambda mask: flags.bitwiseAND(F.lit(mask)) != 0
    return F.when(hit(0x04), "RST").when(hit(0x01), "FIN").when(hit(0x12), "ACC").otherwise("INT")


def has_http_method(payload) -> Column:
    payload = F.col(payload) if isinstance(payload, str) else payload
    test = F.lit(False)
    for m in S.HTTP_METHODS:
        test = test | payload.startswith(m)
    return F.coalesce(test, F.lit(False))


def is_ftp_login(payload) -> Column:
    head = F.upper(F.col(payload) if isinstance(payload, str) else payload)
    test = F.lit(False)
    for v in S.FTP_LOGIN_VERBS:
        test = test | head.startswith(v)
    return F.coalesce(test, F.lit(False))


def has_ftp(payload) -> Column:
    return F.coalesce(F.upper(F.col(payload) if isinstance(payload, str) else payload).contains("FTP"), F.lit(False))


def bound_capture(packets: DataFrame, seconds: float | None = None, max_packets: int | None = None) -> DataFrame:
    """First `seconds` of traffic and/or the first `max_packets` packets by arrival."""
    out = packets
    if seconds is not None:
        start = packets.agg(F.min("ts")).first()[0]
        out = out.where(F.col("ts") < F.lit(float(start) + float(seconds))) if start is not None else out
    if max_packets is not None:
        out = out.orderBy(*ORDER).limit(max_packets)
    return out


def key_packets(packets: DataFrame) -> DataFrame:
    """Unordered endpoint key; `from_lo` tells which endpoint sent the packet. TCP and UDP only."""
    from_lo = (F.col("srcip") < F.col("dstip")) | ((F.col("srcip") == F.col("dstip")) & (F.col("sport") <= F.col("dsport")))
    p = packets.where(F.col("proto").isin("tcp", "udp")).withColumn("from_lo", from_lo)
    pick = lambda a, b: F.when(F.col("from_lo"), F.col(a)).otherwise(F.col(b))
    return (
        p.withColumn("lo_ip", pick("srcip", "dstip")).withColumn("lo_port", pick("sport", "dsport"))
        .withColumn("hi_ip", pick("dstip", "srcip")).withColumn("hi_port", pick("dsport", "sport"))
    )


def direct_packets(packets: DataFrame) -> DataFrame:
    """Adds the flow key and `fwd`: true for packets sent by whoever sent the flow's first packet."""
    keyed = key_packets(packets)
    first = keyed.groupBy(*FLOW_KEY).agg(F.min_by("from_lo", F.struct(*ORDER)).alias("first_lo"))
    return null_safe_join(keyed, first, FLOW_KEY).withColumn("fwd", F.col("from_lo") == F.col("first_lo")).drop("from_lo")


def _oriented(df: DataFrame) -> DataFrame:
    lo = F.col("first_lo")
    pick = lambda a, b: F.when(lo, F.col(a)).otherwise(F.col(b))
    return (
        df.withColumn("srcip", pick("lo_ip", "hi_ip")).withColumn("sport", pick("lo_port", "hi_port"))
        .withColumn("dstip", pick("hi_ip", "lo_ip")).withColumn("dsport", pick("hi_port", "lo_port"))
    )


def counters(directed: DataFrame) -> DataFrame:
    """One row per flow: directional counters, first / last values, state and payload facts.

    Everything is a mergeable aggregate, so a hot flow is reduced on the map side.
    """
    order = F.struct(*ORDER)
    fwd, tcp = F.col("fwd"), F.col("proto") == "tcp"
    payload = F.col("payload")

    def last(col, cond):
        return F.coalesce(F.max_by(F.when(cond, F.col(col)), F.when(cond, order)), F.lit(0)).cast("long")

    def first_nonzero(col, cond):
        ok = cond & (F.col(col) != 0)
        return F.coalesce(F.min_by(F.when(ok, F.col(col)), F.when(ok, order)), F.lit(0)).cast("long")

    return directed.groupBy(*FLOW_KEY, "first_lo").agg(
        F.min_by("ts", order).alias("stime"),
        F.max_by("ts", order).alias("ltime"),
        F.coalesce(F.sum(F.when(fwd, F.col("length"))), F.lit(0)).alias("sbytes"),
        F.coalesce(F.sum(F.when(~fwd, F.col("length"))), F.lit(0)).alias("dbytes"),
        F.count_if(fwd).alias("spkts"),
        F.count_if(~fwd).alias("dpkts"),
        last("ttl", fwd).alias("sttl"),
        last("ttl", ~fwd).alias("dttl"),
        last("window", fwd & tcp).alias("swin"),
        last("window", ~fwd & tcp).alias("dwin"),
        first_nonzero("tcp_seq", fwd & tcp).alias("stcpb"),
        first_nonzero("tcp_seq", ~fwd & tcp).alias("dtcpb"),
        F.coalesce(F.max_by(F.when(tcp, tcp_state("flags")), F.when(tcp, order)), F.lit("INT")).alias("state"),
        F.max(has_http_method(payload).cast("int")).cast("long").alias("ct_flw_http_mthd"),
        F.max(is_ftp_login(payload).cast("int")).cast("long").alias("is_ftp_login"),
        F.count_if(has_ftp(payload)).alias("ct_ftp_cmd"),
    )


def _with_segment(df: DataFrame, segment_seconds: float) -> DataFrame:
    return df.withColumn("seg", F.floor(F.col("ts") / F.lit(float(segment_seconds))))


def inter_arrival(directed: DataFrame, segment_seconds: float = 60.0) -> DataFrame:
    """Mean and population deviation of packet gaps per flow and direction (0 below two packets).

    The mean of sorted gaps telescopes to (last - first) / (n - 1). For the deviation, squared gaps are
    summed inside time segments and across segment borders, so no task holds a whole flow.
    """
    seg = _with_segment(directed.select(*FLOW_KEY, "fwd", "ts"), segment_seconds)
    inside = Window.partitionBy(*FLOW_KEY, "fwd", "seg").orderBy("ts")
    gap = F.col("ts") - F.lag("ts").over(inside)
    parts = seg.withColumn("gap", gap).groupBy(*FLOW_KEY, "fwd", "seg").agg(
        F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.sum(F.col("gap") * F.col("gap")).alias("sq"))
    border = Window.partitionBy(*FLOW_KEY, "fwd").orderBy("seg")
    jump = F.col("lo") - F.lag("hi").over(border)
    per = parts.withColumn("jump", jump).groupBy(*FLOW_KEY, "fwd").agg(
        F.sum("n").alias("n"), (F.max("hi") - F.min("lo")).alias("span"),
        (F.sum(F.coalesce("sq", F.lit(0.0))) + F.sum(F.coalesce(F.col("jump") * F.col("jump"), F.lit(0.0)))).alias("sq"))
    gaps = F.col("n") - 1
    mean = F.when(F.col("n") > 1, F.col("span") / gaps).otherwise(0.0)
    var = F.when(F.col("n") > 1, F.greatest(F.col("sq") / gaps - mean * mean, F.lit(0.0))).otherwise(0.0)
    stats = per.select(*FLOW_KEY, "fwd", mean.alias("mean"), F.sqrt(var).alias("dev"))

    def side(value, cond):
        return F.coalesce(F.max(F.when(cond, F.col(value))), F.lit(0.0))

    return stats.groupBy(*FLOW_KEY).agg(
        side("mean", F.col("fwd")).alias("sintpkt"), side("dev", F.col("fwd")).alias("sjit"),
        side("mean", ~F.col("fwd")).alias("dintpkt"), side("dev", ~F.col("fwd")).alias("djit"))


def handshake(directed: DataFrame, segment_seconds: float = 60.0) -> DataFrame:
    """synack, ackdat and tcprtt per flow.

    The time of the latest forward pure SYN, and then the latest reply delay, are carried along the
    flow; ackdat is the first positive acknowledgement delay after a positive reply delay.
    """
    flag = lambda mask: F.col("flags").bitwiseAND(F.lit(mask)) != 0
    tcp = _with_segment(
        directed.where(F.col("proto") == "tcp").select(*FLOW_KEY, "fwd", "flags", *ORDER), segment_seconds)
    syn = F.when(F.col("fwd") & flag(0x02) & ~flag(0x10), F.col("ts"))
    with_syn = carry_forward(tcp, FLOW_KEY, "seg", ORDER, syn, "syn_ts")
    seen = F.when(F.col("syn_ts") != 0, F.col("syn_ts"))
    reply = F.when(~F.col("fwd") & flag(0x12) & seen.isNotNull(), F.greatest(F.col("ts") - seen, F.lit(0.0)))
    with_reply = carry_forward(with_syn, FLOW_KEY, "seg", ORDER, reply, "reply")
    wait = F.greatest(F.col("ts") - F.coalesce(seen, F.col("ts")), F.lit(0.0))
    ack = F.when(F.col("fwd") & flag(0x10) & (F.col("reply") > 0) & (wait > 0), wait)
    order = F.struct(*ORDER)
    per = with_reply.withColumn("ack", ack).groupBy(*FLOW_KEY).agg(
        F.coalesce(F.max_by("reply", F.when(F.col("reply").isNotNull(), order)), F.lit(0.0)).alias("synack"),
        F.coalesce(F.min_by("ack", F.when(F.col("ack").isNotNull(), order)), F.lit(0.0)).alias("ackdat"))
    return per.withColumn("tcprtt", F.col("ackdat"))


def rates(flows: DataFrame) -> DataFrame:
    """Duration floored at a microsecond, loads and mean packet sizes."""
    dur = F.greatest(F.col("ltime") - F.col("stime"), F.lit(1e-6))
    size = lambda b, n: F.coalesce(F.try_divide(F.col(b).cast("double"), F.col(n)), F.lit(0.0))
    return (
        flows.withColumn("dur", dur)
        .withColumn("sload", F.col("sbytes") / F.col("dur")).withColumn("dload", F.col("dbytes") / F.col("dur"))
        .withColumn("smeansz", size("sbytes", "spkts")).withColumn("dmeansz", size("dbytes", "dpkts"))
    )


# Connection-count feature and the columns it counts over.
CONNECTION_COUNTS = {
    "ct_state_ttl": ["state", "sttl"],
    "ct_srv_src": ["srcip", "service"],
    "ct_srv_dst": ["dstip", "service"],
    "ct_dst_ltm": ["dstip"],
    "ct_src__ltm": ["srcip"],
    "ct_src_dport_ltm": ["srcip", "dsport"],
    "ct_dst_sport_ltm": ["dstip", "sport"],
    "ct_dst_src_ltm": ["srcip", "dstip"],
}


HOT_ROWS = 100_000  # rows of a key's value up to which one task may hold them


def connection_counts(flows: DataFrame, features: dict[str, list[str]] | None = None) -> DataFrame:
    """Number of flows sharing each key, for eight keys.

    Counts whose keys begin with the same column are taken side by side, after one shuffle by that column. The flows of
    its hot values are left out of that shuffle and joined with their counts, so that no task gets a hot address whole.
    """
    features = features or CONNECTION_COUNTS
    counted = flows = materialize(flows.drop(*features), "flows")
    families: dict[str, dict[str, list[str]]] = {}
    for name, keys in features.items():
        families.setdefault(keys[0], {})[name] = keys
    rows = flows.count()
    for first, family in families.items():
        hot = materialize(flows.groupBy(first).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS), "hot-keys")
        held = hot.agg(F.sum("_n")).first()[0] or 0
        parts = []
        if held < rows or not rows:
            few = null_safe_join(counted, hot, [first], "left_anti") if held else counted
            for name, keys in sorted(family.items(), key=lambda f: len(f[1])):
                few = few.withColumn(name, F.count("*").over(Window.partitionBy(*keys)))
            parts.append(few)
        if held:
            much, base = (null_safe_join(t, hot, [first], "left_semi") if held < rows else t for t in (counted, flows))
            for name, keys in family.items():
                much = null_safe_join(much, materialize(base.groupBy(*keys).agg(F.count("*").alias(name)), "hot-counts"), keys)
            parts.append(much)
        counted = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return counted.select(*flows.columns, *features)


def same_endpoint(flows: DataFrame) -> DataFrame:
    same = (F.col("srcip") == F.col("dstip")) | (F.col("sport") == F.col("dsport"))
    return flows.withColumn("is_sm_ips_ports", F.coalesce(same, F.lit(False)).cast("int").cast("long"))


def align(flows: DataFrame) -> DataFrame:
    """All canonical columns in order; missing ones are 0, unparsable numbers are 0, text stays text."""
    out = []
    for field in S.FLOW_SCHEMA:
        if field.name not in flows.columns:
            out.append(F.lit("0" if field.name in S.TEXT_COLUMNS else 0).cast(field.dataType).alias(field.name))
        elif field.name in S.TEXT_COLUMNS:
            out.append(F.col(field.name).cast("string").alias(field.name))
        else:
            out.append(to_number(field.name, 0).cast(field.dataType).alias(field.name))
    return flows.select(*out)


def assemble(packets: DataFrame, segment_seconds: float = 60.0) -> DataFrame:
    """Packets to complete flow records in canonical form."""
    directed = direct_packets(packets)
    flows = null_safe_join(counters(directed), inter_arrival(directed, segment_seconds), FLOW_KEY)
    flows = null_safe_join(flows, handshake(directed, segment_seconds), FLOW_KEY, "left").fillna(0.0, ["synack", "ackdat", "tcprtt"])
    flows = rates(_oriented(flows)).withColumn("service", service_of("dsport", "proto"))
    return align(same_endpoint(connection_counts(flows)))


def domain_features(flows: DataFrame) -> DataFrame:
    """duration, packet_rate and byte_ratio, each only when its source columns exist."""
    cols = set(flows.columns)
    out = flows
    if {"stime", "ltime"} <= cols:
        span = to_number(to_number("ltime") - to_number("stime"))
        out = out.withColumn("duration", F.nullif(F.greatest(span, F.when(span.isNotNull(), F.lit(0.0))), F.lit(0.0)))
        if "dpkts" in cols:
            out = out.withColumn("packet_rate", F.try_divide(to_number("dpkts"), F.col("duration")))
    if {"sbytes", "dbytes"} <= cols:
        out = out.withColumn("byte_ratio", F.try_divide(to_number("sbytes"), F.nullif(to_number("dbytes"), F.lit(0.0))))
    return out
