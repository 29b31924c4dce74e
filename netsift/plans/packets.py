"""C: packets to flows, and domain features, over the whole event and flow tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.functions.cleaning import to_number
from netsift.operators import packets as P
from netsift.plans import views as V
from netsift.plans.registry import query

DAY = 86_400.0  # the given packets are sparse: about 330 a day

KEYED_SQL = V.PACKETS_SQL + """, keyed AS (
  SELECT *, CASE WHEN from_lo THEN srcip ELSE dstip END AS lo_ip, CASE WHEN from_lo THEN sport ELSE dsport END AS lo_port,
         CASE WHEN from_lo THEN dstip ELSE srcip END AS hi_ip, CASE WHEN from_lo THEN dsport ELSE sport END AS hi_port
  FROM (SELECT *, srcip < dstip OR (srcip = dstip AND sport <= dsport) AS from_lo FROM packets WHERE proto IN ('tcp','udp'))),
directed AS (
  SELECT * EXCLUDE (srcip, sport, dstip, dsport), from_lo = first_lo AS fwd,
    CASE WHEN first_lo THEN lo_ip ELSE hi_ip END AS srcip, CASE WHEN first_lo THEN lo_port ELSE hi_port END AS sport,
    CASE WHEN first_lo THEN hi_ip ELSE lo_ip END AS dstip, CASE WHEN first_lo THEN hi_port ELSE lo_port END AS dsport
  FROM (SELECT *, first_value(from_lo) OVER (PARTITION BY lo_ip, lo_port, hi_ip, hi_port, proto ORDER BY ts, seq_no) AS first_lo FROM keyed)),
counters AS (
  SELECT srcip, sport, dstip, dsport, proto, min(ts) AS stime, max(ts) AS ltime,
    coalesce(sum(length) FILTER (fwd), 0) AS sbytes, coalesce(sum(length) FILTER (NOT fwd), 0) AS dbytes,
    count(*) FILTER (fwd) AS spkts, count(*) FILTER (NOT fwd) AS dpkts,
    coalesce(arg_max(ttl, seq_no) FILTER (fwd), 0) AS sttl, coalesce(arg_max(ttl, seq_no) FILTER (NOT fwd), 0) AS dttl,
    coalesce(arg_max("window", seq_no) FILTER (fwd AND proto = 'tcp'), 0) AS swin, coalesce(arg_max("window", seq_no) FILTER (NOT fwd AND proto = 'tcp'), 0) AS dwin,
    coalesce(arg_min(tcp_seq, seq_no) FILTER (fwd AND proto = 'tcp' AND tcp_seq <> 0), 0) AS stcpb,
    coalesce(arg_min(tcp_seq, seq_no) FILTER (NOT fwd AND proto = 'tcp' AND tcp_seq <> 0), 0) AS dtcpb,
    coalesce(arg_max(CASE WHEN flags & 4 <> 0 THEN 'RST' WHEN flags & 1 <> 0 THEN 'FIN' WHEN flags & 18 <> 0 THEN 'ACC' ELSE 'INT' END, seq_no) FILTER (proto = 'tcp'), 'INT') AS state,
    CAST(bool_or(payload LIKE 'GET %') AS BIGINT) AS ct_flw_http_mthd,
    CAST(bool_or(upper(payload) LIKE 'USER%' OR upper(payload) LIKE 'PASS%') AS BIGINT) AS is_ftp_login,
    count(*) FILTER (contains(upper(payload), 'FTP')) AS ct_ftp_cmd
  FROM directed GROUP BY srcip, sport, dstip, dsport, proto),
gaps AS (
  SELECT srcip, sport, dstip, dsport, proto,
    coalesce(avg(gap) FILTER (fwd), 0) AS sintpkt, coalesce(stddev_pop(gap) FILTER (fwd), 0) AS sjit,
    coalesce(avg(gap) FILTER (NOT fwd), 0) AS dintpkt, coalesce(stddev_pop(gap) FILTER (NOT fwd), 0) AS djit
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY srcip, sport, dstip, dsport, proto, fwd ORDER BY ts) AS gap FROM directed)
  GROUP BY srcip, sport, dstip, dsport, proto),
h1 AS (SELECT *, last_value(CASE WHEN fwd AND flags & 2 <> 0 AND flags & 16 = 0 THEN ts END IGNORE NULLS)
         OVER (PARTITION BY srcip, sport, dstip, dsport, proto ORDER BY ts, seq_no ROWS UNBOUNDED PRECEDING) AS syn FROM directed WHERE proto = 'tcp'),
h2 AS (SELECT *, last_value(CASE WHEN NOT fwd AND flags & 18 <> 0 THEN greatest(ts - syn, 0) END IGNORE NULLS)
         OVER (PARTITION BY srcip, sport, dstip, dsport, proto ORDER BY ts, seq_no ROWS UNBOUNDED PRECEDING) AS reply FROM h1),
shake AS (SELECT srcip, sport, dstip, dsport, proto, coalesce(arg_max(reply, seq_no), 0) AS synack,
    coalesce(arg_min(ts - syn, seq_no) FILTER (fwd AND flags & 16 <> 0 AND reply > 0 AND ts > syn), 0) AS ackdat
  FROM h2 GROUP BY srcip, sport, dstip, dsport, proto)"""

_ID = "srcip, sport, dstip, dsport, proto"
_PORT_CASE = """CASE dsport WHEN 20 THEN 'ftp-data' WHEN 21 THEN 'ftp' WHEN 22 THEN 'ssh' WHEN 23 THEN 'telnet' WHEN 25 THEN 'smtp' WHEN 53 THEN 'dns'
  WHEN 80 THEN 'http' WHEN 110 THEN 'pop3' WHEN 123 THEN 'ntp' WHEN 143 THEN 'imap' WHEN 443 THEN 'https' WHEN 445 THEN 'smb' WHEN 465 THEN 'smtp'
  WHEN 587 THEN 'smtp' WHEN 993 THEN 'imap' WHEN 995 THEN 'pop3' WHEN 3306 THEN 'mysql' WHEN 3389 THEN 'rdp' WHEN 8080 THEN 'http'
  ELSE CASE WHEN dsport = 67 AND proto = 'udp' THEN 'dhcp' ELSE 'other' END END"""


def oriented_counters(spark, sf_dir):
    return P._oriented(P.counters(P.direct_packets(V.packets(spark, sf_dir))))


@query("c1_flow_assembly", f"WITH {KEYED_SQL} SELECT {_ID}, count(*) AS packets, count(*) FILTER (fwd) AS forward FROM directed GROUP BY {_ID}")
def c1(spark, sf_dir):
    d = P._oriented(P.direct_packets(V.packets(spark, sf_dir)))
    return d.groupBy("srcip", "sport", "dstip", "dsport", "proto").agg(F.count("*").alias("packets"), F.count_if("fwd").alias("forward"))


@query("c2_capture_bound", f"""WITH {V.PACKETS_SQL} SELECT proto, count(*) AS n, sum(length) AS bytes, max(seq_no) AS last_seq FROM (
  SELECT * FROM packets WHERE ts < (SELECT min(ts) FROM packets) + 864000 ORDER BY ts, seq_no LIMIT 2500) GROUP BY proto""")
def c2(spark, sf_dir):
    p = P.bound_capture(V.packets(spark, sf_dir), 864_000, 2_500)
    return p.groupBy("proto").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.max("seq_no").alias("last_seq"))


@query("c3_directional_counters", f"WITH {KEYED_SQL} SELECT {_ID}, round(stime, 3) AS stime, round(ltime, 3) AS ltime, sbytes, dbytes, spkts, dpkts FROM counters")
def c3(spark, sf_dir):
    return oriented_counters(spark, sf_dir).select("srcip", "sport", "dstip", "dsport", "proto", F.round("stime", 3).alias("stime"),
                                                   F.round("ltime", 3).alias("ltime"), "sbytes", "dbytes", "spkts", "dpkts")


@query("c4_first_last_values", f"WITH {KEYED_SQL} SELECT {_ID}, sttl, dttl, swin, dwin, stcpb, dtcpb FROM counters")
def c4(spark, sf_dir):
    return oriented_counters(spark, sf_dir).select("srcip", "sport", "dstip", "dsport", "proto", "sttl", "dttl", "swin", "dwin", "stcpb", "dtcpb")


@query("c5_tcp_state", f"WITH {KEYED_SQL} SELECT {_ID}, state FROM counters")
def c5(spark, sf_dir):
    return oriented_counters(spark, sf_dir).select("srcip", "sport", "dstip", "dsport", "proto", "state")


@query("c6_handshake_timing", f"WITH {KEYED_SQL} SELECT {_ID}, round(synack, 3) AS synack, round(ackdat, 3) AS ackdat, round(ackdat, 3) AS tcprtt FROM shake")
def c6(spark, sf_dir):
    d = P.direct_packets(V.packets(spark, sf_dir))
    h = P.handshake(d, DAY).join(d.select(*P.FLOW_KEY, "first_lo").distinct(), P.FLOW_KEY)
    return P._oriented(h).select("srcip", "sport", "dstip", "dsport", "proto", *[F.round(c, 3).alias(c) for c in ("synack", "ackdat", "tcprtt")])


@query("c7_payload_predicates", f"WITH {KEYED_SQL} SELECT {_ID}, ct_flw_http_mthd, is_ftp_login, ct_ftp_cmd FROM counters")
def c7(spark, sf_dir):
    return oriented_counters(spark, sf_dir).select("srcip", "sport", "dstip", "dsport", "proto", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd")


@query("c8_inter_arrival", f"WITH {KEYED_SQL} SELECT {_ID}, round(sintpkt, 2) AS sintpkt, round(sjit, 2) AS sjit, round(dintpkt, 2) AS dintpkt, round(djit, 2) AS djit FROM gaps")
def c8(spark, sf_dir):
    d = P.direct_packets(V.packets(spark, sf_dir))
    g = P.inter_arrival(d, DAY).join(d.select(*P.FLOW_KEY, "first_lo").distinct(), P.FLOW_KEY)
    return P._oriented(g).select("srcip", "sport", "dstip", "dsport", "proto", *[F.round(c, 2).alias(c) for c in ("sintpkt", "sjit", "dintpkt", "djit")])


@query("c9_port_service", f"WITH {V.FLOWS_SQL} SELECT service, proto, count(*) AS n FROM (SELECT {_PORT_CASE} AS service, proto FROM flows) GROUP BY 1, 2")
def c9(spark, sf_dir):
    return V.flows(spark, sf_dir).groupBy(P.service_of("dsport", "proto").alias("service"), "proto").agg(F.count("*").alias("n"))


@query("c10_rates", f"""WITH {V.FLOWS_SQL} SELECT flow_id, round(dur2, 6) AS dur, round(sbytes / dur2, 2) AS sload, round(dbytes / dur2, 2) AS dload,
  round(CASE WHEN spkts = 0 THEN 0 ELSE sbytes / spkts END, 4) AS smeansz, round(CASE WHEN dpkts = 0 THEN 0 ELSE dbytes / dpkts END, 4) AS dmeansz
  FROM (SELECT *, greatest(ltime - stime, 1e-6) AS dur2 FROM flows)""")
def c10(spark, sf_dir):
    f = P.rates(V.flows(spark, sf_dir))
    return f.select("flow_id", F.round("dur", 6).alias("dur"), F.round("sload", 2).alias("sload"), F.round("dload", 2).alias("dload"),
                    F.round("smeansz", 4).alias("smeansz"), F.round("dmeansz", 4).alias("dmeansz"))


@query("c11_connection_counts", f"WITH {V.FLOWS_SQL} SELECT flow_id, " + ", ".join(
    f"count(*) OVER (PARTITION BY {', '.join(k)}) AS {n}" for n, k in P.CONNECTION_COUNTS.items()) + " FROM flows")
def c11(spark, sf_dir):
    digest = F.unhex("flow_id").alias("flow_id")  # half as long as its text
    f = V.flows(spark, sf_dir).select(digest, "state", "sttl", "srcip", "dstip", "service", "sport", "dsport")
    return P.connection_counts(f).select(F.lower(F.hex("flow_id")).alias("flow_id"), *P.CONNECTION_COUNTS)


@query("c12_same_endpoint", f"WITH {V.FLOWS_SQL} SELECT is_sm_ips_ports, count(*) AS n FROM (SELECT CAST(srcip = dstip OR sport % 100 = dsport % 100 AS BIGINT) AS is_sm_ips_ports FROM flows) GROUP BY 1")
def c12(spark, sf_dir):
    f = V.flows(spark, sf_dir).withColumn("sport", F.col("sport") % 100).withColumn("dsport", F.col("dsport") % 100)
    return P.same_endpoint(f).groupBy("is_sm_ips_ports").agg(F.count("*").alias("n"))


@query("c13_schema_alignment", f"""WITH {V.FLOWS_SQL} SELECT srcip, CAST(sum(CASE WHEN sttl = 0 THEN 0 ELSE sbytes END) AS BIGINT) AS sbytes, CAST(0 AS BIGINT) AS sloss,
  0.0 AS djit, count(*) AS n FROM flows GROUP BY srcip""")
def c13(spark, sf_dir):
    f = V.flows(spark, sf_dir)
    f = f.withColumn("sbytes", F.when(F.col("sttl") == 0, "bad").otherwise(F.col("sbytes").cast("string")))
    return P.align(f).groupBy("srcip").agg(F.sum("sbytes").alias("sbytes"), F.sum("sloss").alias("sloss"), F.sum("djit").alias("djit"), F.count("*").alias("n"))


@query("c14_domain_features", f"""WITH {V.FLOWS_SQL} SELECT flow_id, nullif(greatest(ltime - stime, 0), 0) AS duration,
  round(dpkts / nullif(greatest(ltime - stime, 0), 0), 6) AS packet_rate, round(sbytes / nullif(dbytes, 0), 6) AS byte_ratio FROM flows""")
def c14(spark, sf_dir):
    f = P.domain_features(V.flows(spark, sf_dir))
    return f.select("flow_id", "duration", F.round("packet_rate", 6).alias("packet_rate"), F.round("byte_ratio", 6).alias("byte_ratio"))


_COUNT_SQL = ", ".join(f"count(*) OVER (PARTITION BY {', '.join(k)}) AS {n}" for n, k in P.CONNECTION_COUNTS.items())


@query("c15_complete_flow_records", f"""WITH {KEYED_SQL} SELECT {_ID}, service, state, sbytes, dbytes, spkts, dpkts, sttl, dttl, round(dur, 3) AS dur, round(synack, 3) AS synack,
  round(sjit, 2) AS sjit, {', '.join(P.CONNECTION_COUNTS)} FROM (
  SELECT *, {_COUNT_SQL} FROM (SELECT *, {_PORT_CASE} AS service, greatest(ltime - stime, 1e-6) AS dur, coalesce(synack0, 0) AS synack FROM counters
  JOIN gaps USING ({_ID}) LEFT JOIN (SELECT {_ID}, synack AS synack0 FROM shake) USING ({_ID})))""")
def c15(spark, sf_dir):
    f = P.assemble(V.packets(spark, sf_dir), DAY)
    return f.select("srcip", "sport", "dstip", "dsport", "proto", "service", "state", "sbytes", "dbytes", "spkts", "dpkts", "sttl", "dttl",
                    F.round("dur", 3).alias("dur"), F.round("synack", 3).alias("synack"), F.round("sjit", 2).alias("sjit"), *P.CONNECTION_COUNTS)
