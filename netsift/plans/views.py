"""Flow, packet, request and log views over the given tables, with the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.operators.alerts import since
from netsift.functions.cleaning import epoch_micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_PORTS = [80, 443, 53, 22, 21, 25, 8080, 9999]
_SERVICES = ["http", "https", "dns", "ssh", "ftp", "smtp", "http", "-"]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled flow per line item; `flow_id` is unique."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    kind = (F.col("l_partkey") % 8).cast("int")
    ship = F.unix_date(F.col("l_shipdate").cast("date")).cast("long") * 86400
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    qty = F.col("l_quantity").cast("long")
    gap = (qty % 7) * 0.5
    prio = F.substring("o_orderpriority", 1, 1)
    flag = F.col("l_returnflag")
    win = F.when(F.col("l_linestatus") == "O", 255).otherwise(0).cast("long")
    return j.select(
        F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents, ship)).alias("flow_id"),
        F.concat(F.lit("c"), "o_custkey").alias("srcip"),
        (F.lit(1024) + (F.col("l_partkey") * 31) % 5000).cast("long").alias("sport"),
        F.concat(F.lit("s"), "l_suppkey").alias("dstip"),
        F.get(F.array(*[F.lit(p) for p in _PORTS]), kind).cast("long").alias("dsport"),
        F.when(kind == 2, "udp").otherwise("tcp").alias("proto"),
        F.when(flag == "A", "FIN").when(flag == "N", "INT").otherwise("CON").alias("state"),
        gap.cast("double").alias("dur"),
        cents.alias("sbytes"),
        F.when(F.col("l_linenumber") == 1, 0).otherwise(F.round(F.col("o_totalprice") * 100).cast("long")).cast("long").alias("dbytes"),
        F.round(F.col("l_tax") * 100).cast("long").alias("sttl"),
        F.lit(64).cast("long").alias("dttl"),
        F.get(F.array(*[F.lit(s) for s in _SERVICES]), kind).alias("service"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sload"),
        F.col("o_totalprice").alias("dload"),
        qty.alias("spkts"),
        (qty % 10).alias("dpkts"),
        win.alias("swin"),
        win.alias("dwin"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("smeansz"),
        F.col("l_discount").alias("tcprtt"),
        ship.cast("double").alias("stime"),
        (ship + gap).cast("double").alias("ltime"),
        (F.col("l_suppkey") % 7).cast("long").alias("ct_state_ttl"),
        F.col("l_linenumber").cast("long").alias("ct_srv_src"),
        (F.col("o_custkey") % 11).cast("long").alias("ct_dst_ltm"),
        F.when(prio == "1", "DoS").when(prio == "2", " Exploits ").when(prio == "3", "Backdoors")
        .when(prio == "5", "Fuzzers").when(F.col("l_linestatus") == "O", F.lit(None).cast("string")).otherwise("-").alias("attack_cat"),
        F.when(prio == "4", 0).otherwise(1).alias("label"),
    )


FLOWS_SQL = """flows AS (
  SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
             CAST(round(l_extendedprice*100) AS BIGINT), CAST(epoch(l_shipdate) AS BIGINT))) AS flow_id,
    'c' || o_custkey AS srcip, CAST(1024 + (l_partkey*31) % 5000 AS BIGINT) AS sport, 's' || l_suppkey AS dstip,
    CAST([80,443,53,22,21,25,8080,9999][(l_partkey % 8) + 1] AS BIGINT) AS dsport,
    CASE WHEN l_partkey % 8 = 2 THEN 'udp' ELSE 'tcp' END AS proto,
    CASE l_returnflag WHEN 'A' THEN 'FIN' WHEN 'N' THEN 'INT' ELSE 'CON' END AS state,
    CAST((CAST(l_quantity AS BIGINT) % 7) * 0.5 AS DOUBLE) AS dur,
    CAST(round(l_extendedprice*100) AS BIGINT) AS sbytes,
    CASE WHEN l_linenumber = 1 THEN 0 ELSE CAST(round(o_totalprice*100) AS BIGINT) END AS dbytes,
    CAST(round(l_tax*100) AS BIGINT) AS sttl, CAST(64 AS BIGINT) AS dttl,
    ['http','https','dns','ssh','ftp','smtp','http','-'][(l_partkey % 8) + 1] AS service,
    l_extendedprice * (1 - l_discount) AS sload, o_totalprice AS dload,
    CAST(l_quantity AS BIGINT) AS spkts, CAST(l_quantity AS BIGINT) % 10 AS dpkts,
    CAST(CASE WHEN l_linestatus = 'O' THEN 255 ELSE 0 END AS BIGINT) AS swin,
    CAST(CASE WHEN l_linestatus = 'O' THEN 255 ELSE 0 END AS BIGINT) AS dwin,
    l_extendedprice / l_quantity AS smeansz, l_discount AS tcprtt,
    CAST(epoch(l_shipdate) AS DOUBLE) AS stime,
    CAST(epoch(l_shipdate) AS DOUBLE) + CAST((CAST(l_quantity AS BIGINT) % 7) * 0.5 AS DOUBLE) AS ltime,
    CAST(l_suppkey % 7 AS BIGINT) AS ct_state_ttl, CAST(l_linenumber AS BIGINT) AS ct_srv_src,
    CAST(o_custkey % 11 AS BIGINT) AS ct_dst_ltm,
    CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'DoS' WHEN '2' THEN ' Exploits ' WHEN '3' THEN 'Backdoors'
      WHEN '5' THEN 'Fuzzers' ELSE CASE WHEN l_linestatus = 'O' THEN NULL ELSE '-' END END AS attack_cat,
    CASE WHEN substr(o_orderpriority,1,1) = '4' THEN 0 ELSE 1 END AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

FLOW_TYPES = {
    "flow_id": "string", "srcip": "string", "sport": "bigint", "dstip": "string", "dsport": "bigint",
    "proto": "string", "state": "string", "dur": "double", "sbytes": "bigint", "dbytes": "bigint",
    "sttl": "bigint", "dttl": "bigint", "service": "string", "sload": "double", "dload": "double",
    "spkts": "bigint", "dpkts": "bigint", "swin": "bigint", "dwin": "bigint", "smeansz": "double",
    "tcprtt": "double", "stime": "double", "ltime": "double", "ct_state_ttl": "bigint",
    "ct_srv_src": "bigint", "ct_dst_ltm": "bigint", "attack_cat": "string", "label": "int",
}

NUMERIC = ["sport", "dsport", "dur", "sbytes", "dbytes", "sttl", "dttl", "sload", "dload", "spkts", "dpkts",
           "swin", "dwin", "smeansz", "stime", "ltime", "tcprtt", "ct_state_ttl", "ct_srv_src", "ct_dst_ltm"]


def gappy_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with missing values: dpkts NULL where 0, tcprtt NULL for FIN, service NULL for '-'."""
    f = flows(spark, sf_dir)
    return (
        f.withColumn("dpkts", F.when(F.col("dpkts") != 0, F.col("dpkts")))
        .withColumn("tcprtt", F.when(F.col("state") != "FIN", F.col("tcprtt")))
        .withColumn("service", F.when(F.col("service") != "-", F.col("service")))
    )


GAPPY_SQL = FLOWS_SQL + """, gappy AS (
  SELECT * REPLACE (nullif(dpkts, 0) AS dpkts, CASE WHEN state <> 'FIN' THEN tcprtt END AS tcprtt,
                    nullif(service, '-') AS service) FROM flows)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet per event."""
    e = table(spark, sf_dir, "events")
    kind = (F.col("user_id") % 8).cast("int")
    client, cport = F.concat(F.lit("h"), F.col("user_id") % 20), F.lit(1000) + F.col("user_id")
    server = F.concat(F.lit("s"), F.col("user_id") % 5)
    sport = F.get(F.array(*[F.lit(p) for p in _PORTS]), kind).cast("long")
    back = F.col("event_id") % 3 == 1
    et = F.col("event_type")
    return e.select(
        (epoch_micros("ts") / 1e6).alias("ts"),
        F.col("event_id").alias("seq_no"),
        F.when(back, server).otherwise(client).alias("srcip"),
        F.when(back, sport).otherwise(cport).cast("long").alias("sport"),
        F.when(back, client).otherwise(server).alias("dstip"),
        F.when(back, cport).otherwise(sport).cast("long").alias("dsport"),
        F.when(kind == 2, "udp").otherwise("tcp").alias("proto"),
        (F.lit(40) + F.floor(F.round(F.col("value") * 100) / 10)).cast("long").alias("length"),
        (F.lit(64) - F.col("event_id") % 3).cast("long").alias("ttl"),
        F.when(et == "signup", 2).when(et == "error", 18).when(et == "click", 16)
        .when(et == "purchase", 17).otherwise(24).cast("long").alias("flags"),
        (F.lit(1000) + F.col("event_id") % 500).cast("long").alias("window"),
        ((F.col("event_id") % 11) * 100).cast("long").alias("tcp_seq"),
        F.when(et == "click", "GET /").when(et == "signup", "USER x").when(et == "view", "xx ftp yy").otherwise("").alias("payload"),
    )


PACKETS_SQL = """packets AS (
  SELECT epoch_us(ts) / 1e6 AS ts, event_id AS seq_no,
    CASE WHEN event_id % 3 = 1 THEN 's' || (user_id % 5) ELSE 'h' || (user_id % 20) END AS srcip,
    CAST(CASE WHEN event_id % 3 = 1 THEN [80,443,53,22,21,25,8080,9999][(user_id % 8) + 1] ELSE 1000 + user_id END AS BIGINT) AS sport,
    CASE WHEN event_id % 3 = 1 THEN 'h' || (user_id % 20) ELSE 's' || (user_id % 5) END AS dstip,
    CAST(CASE WHEN event_id % 3 = 1 THEN 1000 + user_id ELSE [80,443,53,22,21,25,8080,9999][(user_id % 8) + 1] END AS BIGINT) AS dsport,
    CASE WHEN user_id % 8 = 2 THEN 'udp' ELSE 'tcp' END AS proto,
    CAST(40 + floor(round(value*100)/10) AS BIGINT) AS length, 64 - event_id % 3 AS ttl,
    CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 18 WHEN 'click' THEN 16 WHEN 'purchase' THEN 17 ELSE 24 END AS flags,
    1000 + event_id % 500 AS "window", (event_id % 11) * 100 AS tcp_seq,
    CASE event_type WHEN 'click' THEN 'GET /' WHEN 'signup' THEN 'USER x' WHEN 'view' THEN 'xx ftp yy' ELSE '' END AS payload
  FROM events)"""


def requests(spark: SparkSession, sf_dir: str, since_us: int | None = None) -> DataFrame:
    """One request per event; `ts_us` is the event time in microseconds. With `since_us`, only later ones are read."""
    e = table(spark, sf_dir, "events")
    if since_us is not None:
        e = since(e, "ts", since_us)
    return e.select(
        F.col("event_id").alias("request_id"),
        epoch_micros("ts").alias("ts_us"),
        F.col("user_id").cast("string").alias("client_id"),
        F.concat(F.lit("svc"), F.col("user_id") % 3).alias("service"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("latency_ms"),
    )


REQUESTS_SQL = """requests AS (
  SELECT event_id AS request_id, epoch_us(ts) AS ts_us, CAST(user_id AS VARCHAR) AS client_id, 'svc' || (user_id % 3) AS service,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS latency_ms FROM events)"""

# Watch list for the page hosts of the given tables: parent domains plus one exact host.
WATCH = [("m.ththth.example.net", "dos"), ("example.com", "exploits"), ("example.net", "recon"), ("example.org", "generic")]


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lookup per page: host name of the url, at the time of the event with the page's number."""
    p, e = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    return p.join(e, p["page_id"] == e["event_id"]).select(
        "page_id",
        epoch_micros("ts").alias("ts_us"),
        F.concat(F.lit("host"), F.col("user_id") % 4).alias("host_id"),
        F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("qname"),
        F.concat(F.lit("10.0.0."), F.col("page_id") % 50).alias("remote_ip"),
    )


DNS_SQL = """dns AS (
  SELECT page_id, epoch_us(ts) AS ts_us, 'host' || (user_id % 4) AS host_id,
         regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS qname, '10.0.0.' || (page_id % 50) AS remote_ip
  FROM pages JOIN events ON page_id = event_id)"""


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario switches: every purchase event starts one; every fifth switches back to normal."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    keys = ["normal", "exploits", "dos", "recon", "generic"]
    return e.select(
        epoch_micros("ts").alias("ts_us"), F.col("event_id").alias("trigger_id"),
        F.get(F.array(*[F.lit(k) for k in keys]), (F.col("event_id") % 5).cast("int")).alias("scenario_key"),
    )


TRIGGERS_SQL = """triggers AS (
  SELECT epoch_us(ts) AS ts_us, event_id AS trigger_id, ['normal','exploits','dos','recon','generic'][(event_id % 5) + 1] AS scenario_key
  FROM events WHERE event_type = 'purchase')"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and predicted class per line item, with two scores and a split name."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    y = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        y.alias("y"),
        F.when(F.col("l_linenumber") % 4 == 0, (y + 1) % 5).otherwise(y).alias("yhat"),
        F.when(F.col("l_linenumber") % 3 == 0, (y + 2) % 5).otherwise(y).alias("yhat2"),
        *[((F.col("l_discount") * (i + 1) + F.col("l_tax") * (5 - i)) + F.when(y == i, 0.1).otherwise(0.0)).alias(f"s{i}") for i in range(5)],
        F.when(F.col("l_linestatus") == "O", "train").otherwise("test").alias("split"),
    )


PREDS_SQL = """preds AS (
  SELECT y, CASE WHEN ln % 4 = 0 THEN (y+1) % 5 ELSE y END AS yhat, CASE WHEN ln % 3 = 0 THEN (y+2) % 5 ELSE y END AS yhat2,
    (d*1 + t*5) + CASE WHEN y=0 THEN 0.1 ELSE 0.0 END AS s0, (d*2 + t*4) + CASE WHEN y=1 THEN 0.1 ELSE 0.0 END AS s1,
    (d*3 + t*3) + CASE WHEN y=2 THEN 0.1 ELSE 0.0 END AS s2, (d*4 + t*2) + CASE WHEN y=3 THEN 0.1 ELSE 0.0 END AS s3,
    (d*5 + t*1) + CASE WHEN y=4 THEN 0.1 ELSE 0.0 END AS s4, split
  FROM (SELECT CAST(substr(o_orderpriority,1,1) AS INTEGER) - 1 AS y, l_linenumber AS ln, l_discount AS d, l_tax AS t,
          CASE WHEN l_linestatus = 'O' THEN 'train' ELSE 'test' END AS split
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""

CLASS_NAMES = ["DoS", "Exploits", "Backdoor", "Normal", "Fuzzers"]

_SPLIT_SECONDS = 896_659_200  # 1998-06-01


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).where(F.col("stime") < _SPLIT_SECONDS)


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later flows with shifted bytes and a service the baseline never saw."""
    return (
        flows(spark, sf_dir).where(F.col("stime") >= _SPLIT_SECONDS)
        .withColumn("sbytes", (F.col("sbytes") * 1.5).cast("double"))
        .withColumn("service", F.when(F.col("service") == "http", "quic").otherwise(F.col("service")))
    )


SIDES_SQL = FLOWS_SQL + """, baseline AS (SELECT * REPLACE (CAST(sbytes AS DOUBLE) AS sbytes) FROM flows WHERE stime < 896659200),
live AS (SELECT * REPLACE (sbytes * 1.5 AS sbytes, CASE WHEN service = 'http' THEN 'quic' ELSE service END AS service)
  FROM flows WHERE stime >= 896659200)"""
