"""B: projection, cleaning, validation and scalar rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.functions import cleaning as C
from netsift.plans import views as V
from netsift.plans.registry import query

_CLEAN_CAT_SQL = """CASE WHEN c IN ('-', 'normal') THEN 'Normal' WHEN c IN ('Backdoors', 'backdoor', 'backdoors') THEN 'Backdoor'
  WHEN c IN ('exploits','reconnaissance','fuzzers','shellcode','worms','analysis','generic') THEN upper(c[1]) || c[2:] WHEN c = 'dos' THEN 'DoS' ELSE c END"""

CATS_SQL = V.FLOWS_SQL + f""", cats AS (
  SELECT * EXCLUDE (c), {_CLEAN_CAT_SQL} AS cat FROM (SELECT *, trim(coalesce(attack_cat, 'Normal')) AS c FROM flows))"""


def clean_flows(spark, sf_dir):
    f = V.flows(spark, sf_dir)
    return f.withColumn("cat", C.clean_category("attack_cat"))


# Text columns built from the flows so that some values do not parse.
def messy(spark, sf_dir):
    f = V.flows(spark, sf_dir)
    return f.select(
        "flow_id", "state", "label",
        F.when(F.col("sttl") == 0, "n/a").when(F.col("sttl") == 1, "NaN").when(F.col("sttl") == 2, "Infinity")
        .otherwise(F.col("sbytes").cast("string")).alias("raw_bytes"),
        F.when(F.col("spkts") == 1, "-").otherwise(F.col("spkts").cast("string")).alias("raw_pkts"),
        F.concat(F.lit("  "), F.upper("service"), F.lit(" ")).alias("raw_service"),
        F.when(F.col("service") != "-", F.concat(F.lit(" "), F.upper("service"))).alias("opt_service"),
    )


MESSY_SQL = V.FLOWS_SQL + """, messy AS (
  SELECT flow_id, state, label,
    CASE sttl WHEN 0 THEN 'n/a' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' ELSE CAST(sbytes AS VARCHAR) END AS raw_bytes,
    CASE WHEN spkts = 1 THEN '-' ELSE CAST(spkts AS VARCHAR) END AS raw_pkts,
    '  ' || upper(service) || ' ' AS raw_service,
    CASE WHEN service <> '-' THEN ' ' || upper(service) END AS opt_service FROM flows)"""

_FINITE = "CASE WHEN isfinite(try_cast({0} AS DOUBLE)) THEN try_cast({0} AS DOUBLE) END"


@query("b1_numeric_coercion", f"WITH {MESSY_SQL} SELECT flow_id, " + _FINITE.format("raw_bytes") + " AS bytes, coalesce("
       + _FINITE.format("raw_bytes") + ", 0) AS bytes_filled, " + _FINITE.format("raw_pkts") + " AS pkts FROM messy")
def b1(spark, sf_dir):
    return messy(spark, sf_dir).select(
        "flow_id", C.to_number("raw_bytes").alias("bytes"), C.to_number("raw_bytes", 0).alias("bytes_filled"),
        C.to_number("raw_pkts").alias("pkts"))


@query("b2_ratio_gated_coercion", f"""WITH {MESSY_SQL}, r AS (
  SELECT avg(CASE WHEN try_cast(raw_bytes AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END) rb, avg(CASE WHEN try_cast(raw_pkts AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END) rp,
         avg(CASE WHEN try_cast(raw_service AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END) rs FROM messy)
SELECT column_name, CAST(ratio >= 0.85 AS INTEGER) AS is_numeric, round(ratio, 6) AS ratio FROM (
  SELECT 'raw_bytes' column_name, rb ratio FROM r UNION ALL SELECT 'raw_pkts', rp FROM r UNION ALL SELECT 'raw_service', rs FROM r)""")
def b2(spark, sf_dir):
    m = messy(spark, sf_dir).select("raw_bytes", "raw_pkts", "raw_service")
    ratios = m.agg(*[F.avg(F.col(c).try_cast("double").isNotNull().cast("int")).alias(c) for c in m.columns])
    long = ratios.unpivot([], m.columns, "column_name", "ratio")
    return long.select("column_name", (F.col("ratio") >= 0.85).cast("int").alias("is_numeric"), F.round("ratio", 6).alias("ratio"))


@query("b2_coerced_table", f"""WITH {MESSY_SQL} SELECT raw_service, count(*) AS n,
  count(try_cast(raw_pkts AS DOUBLE)) AS parsed, sum(try_cast(raw_pkts AS DOUBLE)) AS pkts FROM messy GROUP BY raw_service""")
def b2_table(spark, sf_dir):
    t = C.coerce_mostly_numeric(messy(spark, sf_dir).select("raw_pkts", "raw_service"))
    return t.groupBy("raw_service").agg(F.count("*").alias("n"), F.count("raw_pkts").alias("parsed"), F.sum("raw_pkts").alias("pkts"))


@query("b3_text_normalisation", f"WITH {MESSY_SQL} SELECT lower(trim(raw_service)) AS a, lower(trim(coalesce(opt_service,''))) AS b, count(*) AS n FROM messy GROUP BY 1, 2")
def b3(spark, sf_dir):
    return messy(spark, sf_dir).groupBy(C.norm_text("raw_service").alias("a"), C.norm_text("opt_service").alias("b")).agg(F.count("*").alias("n"))


@query("b4_category_cleaning", f"WITH {CATS_SQL} SELECT attack_cat, cat, count(*) AS n FROM cats GROUP BY 1, 2")
def b4(spark, sf_dir):
    return clean_flows(spark, sf_dir).groupBy("attack_cat", "cat").agg(F.count("*").alias("n"))


MERGED_SQL = CATS_SQL + """, merged AS (SELECT * EXCLUDE (cat, k), CASE WHEN k < (SELECT count(*) * 0.2005 FROM flows) AND cat NOT IN ('Normal','Generic') THEN 'Generic' ELSE cat END AS cat
  FROM (SELECT *, count(*) OVER (PARTITION BY cat) AS k FROM cats))"""


def merged_flows(spark, sf_dir):
    """Cleaned flows with classes below 20.05 % of the table merged."""
    f = clean_flows(spark, sf_dir)
    total = V.table(spark, sf_dir, "lineitem").count()
    return C.merge_rare(f, "cat", total * 0.2005)


@query("b5_rare_class_merge", f"WITH {MERGED_SQL} SELECT cat, count(*) AS n, CAST(sum(sbytes) AS BIGINT) AS bytes FROM merged GROUP BY cat")
def b5(spark, sf_dir):
    return merged_flows(spark, sf_dir).groupBy("cat").agg(F.count("*").alias("n"), F.sum("sbytes").alias("bytes"))


@query("b6_target_derivation", f"WITH {CATS_SQL} SELECT target, proto, count(*) AS n FROM (SELECT CASE WHEN label = 0 THEN 'Normal' ELSE cat END AS target, proto FROM cats) GROUP BY 1, 2")
def b6(spark, sf_dir):
    f = clean_flows(spark, sf_dir).withColumn("target", C.derive_target("cat", "label")).drop("label", "attack_cat", "cat", "srcip", "dstip")
    return f.groupBy("target", "proto").agg(F.count("*").alias("n"))


@query("b7_sizing_category", f"""WITH {V.FLOWS_SQL} SELECT cat, count(*) AS n FROM (
  SELECT CASE WHEN c IN ('-','normal') THEN 'unknown' ELSE c END AS cat FROM (SELECT lower(trim(coalesce(attack_cat,'Unknown'))) AS c FROM flows)) GROUP BY cat""")
def b7(spark, sf_dir):
    return V.flows(spark, sf_dir).groupBy(C.sizing_category("attack_cat").alias("cat")).agg(F.count("*").alias("n"))


@query("b8_attack_normal_filter", f"""WITH {V.FLOWS_SQL} SELECT 'attack' AS side, count(*) AS n, CAST(sum(sbytes) AS BIGINT) AS bytes FROM flows WHERE label = 1
  UNION ALL SELECT 'normal', count(*), CAST(sum(sbytes) AS BIGINT) FROM flows WHERE label = 0""")
def b8(spark, sf_dir):
    f = V.flows(spark, sf_dir)

    def side(name, rows):
        return rows.agg(F.count("*").alias("n"), F.sum("sbytes").alias("bytes")).select(F.lit(name).alias("side"), "n", "bytes")

    return side("attack", f.where(C.is_attack())).unionByName(side("normal", f.where(C.is_normal())))


# Scoring records with planted faults.
def faulty(spark, sf_dir):
    f = V.flows(spark, sf_dir)
    return f.select(
        "flow_id", F.when(F.col("spkts") == 3, F.lit(None)).otherwise(F.col("proto")).alias("proto"),
        F.when(F.col("service") == "-", "  ").otherwise(F.col("service")).alias("service"), "state", "sport", "dsport",
        F.when(F.col("dpkts") == 4, F.lit(float("nan"))).otherwise(F.col("dur")).alias("dur"),
        F.when(F.col("sttl") == 5, -F.col("sbytes")).otherwise(F.col("sbytes")).alias("sbytes"),
        "dbytes", "sttl", (-F.col("stime")).alias("stime"))


FAULTY_SQL = V.FLOWS_SQL + """, faulty AS (SELECT flow_id, spkts = 3 AS f1, service = '-' AS f2, dpkts = 4 AS f3, sttl = 5 AS f4 FROM flows)"""


@query("b9_flow_validation", f"""WITH {FAULTY_SQL} SELECT
  CASE WHEN f1 THEN 'proto' WHEN f2 THEN 'service' WHEN f3 THEN 'dur' WHEN f4 THEN 'sbytes' END AS failed_field,
  CASE WHEN f1 THEN 'missing' WHEN f2 THEN 'empty' WHEN f3 THEN 'not finite' WHEN f4 THEN 'negative' END AS failure, count(*) AS n FROM faulty GROUP BY 1, 2""")
def b9(spark, sf_dir):
    return C.validate(faulty(spark, sf_dir)).groupBy("failed_field", "failure").agg(F.count("*").alias("n"))


@query("b9_violation_table", f"""WITH {FAULTY_SQL} SELECT field, problem, count(*) AS n FROM (
  SELECT 'proto' AS field, 'missing' AS problem FROM faulty WHERE f1 UNION ALL SELECT 'service', 'empty' FROM faulty WHERE f2
  UNION ALL SELECT 'dur', 'not finite' FROM faulty WHERE f3 UNION ALL SELECT 'sbytes', 'negative' FROM faulty WHERE f4) GROUP BY 1, 2""")
def b9_table(spark, sf_dir):
    v = C.validate(faulty(spark, sf_dir)).select(F.explode("violations").alias("v"))
    return v.groupBy(F.col("v.field").alias("field"), F.col("v.problem").alias("problem")).agg(F.count("*").alias("n"))


@query("b10_canonical_projection", f"WITH {V.FLOWS_SQL} SELECT " + ", ".join(
    ["srcip", "sport", "dstip", "dsport", "proto", "state", "dur", "sbytes", "dbytes", "sttl", "dttl", "service", "spkts"]) + " FROM flows")
def b10(spark, sf_dir):
    f = V.flows(spark, sf_dir).drop("sload", "dload", "dpkts", "swin", "dwin", "smeansz", "tcprtt", "stime", "ltime",
                                    "ct_state_ttl", "ct_srv_src", "ct_dst_ltm")
    return C.canonical_columns(C.drop_labels(f))


@query("b11_fill_zero", f"WITH {V.GAPPY_SQL} SELECT coalesce(service, '0') AS service, CAST(sum(coalesce(dpkts,0)) AS BIGINT) AS dpkts, round(sum(coalesce(tcprtt,0)), 4) AS tcprtt, count(tcprtt) AS rtts FROM (SELECT service, dpkts, coalesce(tcprtt, 0) AS tcprtt FROM gappy) GROUP BY 1")
def b11(spark, sf_dir):
    f = C.fill_zero(V.gappy_flows(spark, sf_dir).select("service", "dpkts", "tcprtt"))
    return f.groupBy("service").agg(F.sum("dpkts").alias("dpkts"), F.round(F.sum("tcprtt"), 4).alias("tcprtt"), F.count("tcprtt").alias("rtts"))


@query("b12_class_decode", f"""WITH {V.PREDS_SQL} SELECT name, count(*) AS n FROM (
  SELECT CASE WHEN yhat < 4 THEN ['DoS','Exploits','Backdoor','Normal'][yhat + 1] ELSE CAST(yhat AS VARCHAR) END AS name FROM preds) GROUP BY name""")
def b12(spark, sf_dir):
    p = V.predictions(spark, sf_dir)
    return p.groupBy(C.decode_class("yhat", V.CLASS_NAMES[:4]).alias("name")).agg(F.count("*").alias("n"))


@query("b13_quality_tag", f"""WITH {V.FLOWS_SQL} SELECT tag, count(*) AS n FROM (
  SELECT CASE WHEN f1 >= 0.85 THEN 'GOOD' WHEN f1 >= 0.7 THEN 'OK' WHEN f1 >= 0.5 THEN 'WEAK' ELSE 'POOR' END AS tag FROM (SELECT spkts / 50.0 AS f1 FROM flows)) GROUP BY tag""")
def b13(spark, sf_dir):
    return V.flows(spark, sf_dir).groupBy(C.quality_tag(F.col("spkts") / 50.0).alias("tag")).agg(F.count("*").alias("n"))


@query("b14_slow_requests", f"WITH {V.REQUESTS_SQL} SELECT request_id, client_id, latency_ms FROM requests WHERE latency_ms > 150")
def b14(spark, sf_dir):
    return C.slow_requests(V.requests(spark, sf_dir), 150.0).select("request_id", "client_id", "latency_ms")
