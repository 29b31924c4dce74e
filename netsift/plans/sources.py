"""A: sources and sinks, each writing data derived from the given tables and reading it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.functions.cleaning import normalise_names
from netsift.operators import drift as I
from netsift.operators import sampling as E
from netsift.plans import views as V
from netsift.plans.drift import FEATURES, NUM_SQL, _num
from netsift.plans.monitoring import _r
from netsift.plans.prepare import prepared, training_flows
from netsift.plans.registry import query
from netsift.plans.sampling import SPLIT_SQL, SUBSET_SQL, targets
from netsift.session import scratch_path
from netsift.sources import flows as A
from netsift.sources import history, records, reports

_PART_COLS = ["srcip", "sport", "proto", "service", "dur", "sbytes", "attack_cat", "label"]


def _catalog(spark, path: str):
    """A feature catalog for the part files, derived from the columns of the flow view."""
    rows = [(i + 1, f" {c} ", "x") for i, c in enumerate(_PART_COLS)]
    spark.createDataFrame(rows, "`No.` int, `Name` string, `Type` string").coalesce(1).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return A.catalog_schema(A.read_catalog(spark, path))


def _parts(spark, sf_dir, n: int = 4) -> list[str]:
    """The flows as header-less CSV parts; one line per 97 bytes-per-flow class carries surplus fields."""
    f = V.flows(spark, sf_dir).select(*_PART_COLS)
    bad = f.where(F.col("sbytes") % 97 == 0).select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _PART_COLS], F.lit("surplus"), F.lit("x")).alias("value"))
    paths = []
    for i in range(n):
        p = scratch_path(spark, f"part{i}")
        f.where(F.col("sport") % n == i).write.csv(p)
        if i == 0:
            bad.write.mode("append").text(p)
        paths.append(p)
    return paths


@query("a1_flow_csv_scan", f"WITH {V.FLOWS_SQL} SELECT service, count(*) AS n, CAST(sum(sbytes) AS DOUBLE) AS sbytes, round(sum(dur), 4) AS dur, CAST(sum(label) AS BIGINT) AS attacks, count(attack_cat) AS cats FROM flows GROUP BY service")
def a1(spark, sf_dir):
    schema = _catalog(spark, scratch_path(spark, "catalog"))
    df = A.read_flow_csv(spark, [*_parts(spark, sf_dir), "/nonexistent/part.csv"], schema)
    return df.groupBy("service").agg(F.count("*").alias("n"), F.sum("sbytes").alias("sbytes"), F.round(F.sum("dur"), 4).alias("dur"),
                                     F.sum("label").alias("attacks"), F.count("attack_cat").alias("cats"))


@query("a2_catalog_typed_scan", f"WITH {V.FLOWS_SQL} SELECT max(typeof(CAST(sport AS DOUBLE))) = 'DOUBLE' AS numeric_port, max(typeof(proto)) = 'VARCHAR' AS text_proto, count(*) AS n FROM flows")
def a2(spark, sf_dir):
    schema = _catalog(spark, scratch_path(spark, "catalog"))
    df = A.read_flow_csv(spark, _parts(spark, sf_dir, 1), schema)
    t = dict(df.dtypes)
    return df.agg(F.lit(t["sport"] == "double").alias("numeric_port"), F.lit(t["proto"] == "string").alias("text_proto"), F.count("*").alias("n"))


@query("a3_name_normalisation", f"WITH {V.FLOWS_SQL} SELECT service, CAST(sum(ct_srv_src) AS BIGINT) AS ct_src__ltm, CAST(sum(sbytes) AS BIGINT) AS s_bytes FROM flows GROUP BY service")
def a3(spark, sf_dir):
    f = V.flows(spark, sf_dir).select(F.col("service").alias(" Service "), F.col("ct_srv_src").alias("ct_src_ ltm"), F.col("sbytes").alias("S Bytes"))
    return normalise_names(f).groupBy("service").agg(F.sum("ct_src__ltm").alias("ct_src__ltm"), F.sum("s_bytes").alias("s_bytes"))


@query("a4_fallback_union", f"""WITH {V.FLOWS_SQL}, u AS (SELECT proto, service, CASE WHEN spkts = 7 THEN 0 ELSE label END AS label FROM flows WHERE sport % 2 = 0 UNION ALL SELECT proto, NULL, label FROM flows WHERE sport % 2 = 1)
SELECT proto, service, label, count(*) AS n FROM u GROUP BY ALL""")
def a4(spark, sf_dir):
    f = V.flows(spark, sf_dir)
    one, two = scratch_path(spark, "wide"), scratch_path(spark, "narrow")
    f.where("sport % 2 = 0").select("proto", "service", F.when(F.col("spkts") == 7, "bad").otherwise(F.col("label").cast("string")).alias("Label")).write.option("header", True).csv(one)
    f.where("sport % 2 = 1").select("proto", F.col("label").alias(" label")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(two)
    read = lambda p: A.read_flow_csv(spark, [p])
    return A.combine_labelled(spark, [read(one), read(two)]).groupBy("proto", "service", "label").agg(F.count("*").alias("n"))


@query("a5_train_test_load", f"WITH {V.FLOWS_SQL} SELECT 'train' AS tab, count(*) AS n FROM flows WHERE stime < 896659200 UNION ALL SELECT 'test', count(*) FROM flows")
def a5(spark, sf_dir):
    train = scratch_path(spark, "train")
    V.baseline(spark, sf_dir).select(*_PART_COLS).write.option("header", True).csv(train)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in _PART_COLS])
    a, b = A.read_train_test(spark, train, "/nonexistent/test.csv", _parts(spark, sf_dir), schema)
    count = lambda name, d: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n")
    return count("train", a).unionByName(count("test", b))


@query("a6_stored_subset", f"WITH {SUBSET_SQL} SELECT label, count(*) AS n, CAST(sum(sbytes) AS BIGINT) AS bytes FROM subset GROUP BY label")
def a6(spark, sf_dir):
    path = scratch_path(spark, "subset")
    f = V.flows(spark, sf_dir).select("flow_id", "label", "attack_cat", "sbytes")
    A.stored_table(spark, path, lambda: E.attack_normal_subset(f, ["flow_id"], 0.2, 500))
    again = A.stored_table(spark, path, lambda: f.limit(0))  # reused, not rebuilt
    return again.groupBy("label").agg(F.count("*").alias("n"), F.sum("sbytes").alias("bytes"))


@query("a7_split_tables", f"WITH {SPLIT_SQL} SELECT cat, count(*) AS n, CAST(sum(sbytes) AS BIGINT) AS bytes FROM splits WHERE split = 'test' GROUP BY cat")
def a7(spark, sf_dir):
    path = scratch_path(spark, "splits")
    A.write_splits(E.stratified_split(targets(spark, sf_dir), "cat", ["flow_id"]), path)
    return A.read_split(spark, path, "test").groupBy("cat").agg(F.count("*").alias("n"), F.sum("sbytes").alias("bytes"))


@query("a8_drift_report_csv", f"WITH {NUM_SQL} SELECT feature, round(score, 6) AS drift_score, round(psi, 6) AS psi, CASE WHEN score >= 0.2 THEN 'drift' ELSE 'stable' END AS status FROM numr")
def a8(spark, sf_dir):
    path = scratch_path(spark, "report")
    r = I.with_severity(I.with_risk(I.numeric_results(*_num(spark, sf_dir), FEATURES)), I.thresholds(F.array().cast("array<double>")))
    reports.write_ranked_csv(r.withColumn("status", F.when(F.col("severity") == "stable", "stable").otherwise("drift")), path)
    return _r(reports.read_csv(spark, path).select("feature", "drift_score", "psi", "status"))


@query("a9_drift_history", """WITH d AS (SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS timestamp, round(sum(value), 2) / count(*) / 100 AS s FROM events GROUP BY 1)
SELECT timestamp, round(s, 6) AS overall_score FROM d ORDER BY timestamp DESC LIMIT 20""")
def a9(spark, sf_dir):
    path = scratch_path(spark, "history")
    e = V.table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("timestamp")).agg((F.round(F.sum("value"), 2) / F.count("*") / 100).alias("overall_score"))
    history.append(e, path)
    e.select(F.concat(F.lit('{"timestamp": "9'), "timestamp", F.lit('", "overall_sc')).alias("value")).write.mode("append").text(path)  # malformed lines
    return _r(history.load(spark, path, 20).select("timestamp", "overall_score"))


@query("a11_stored_preparation")
def a11(spark, sf_dir):
    from netsift.prepare import FlowPreparationModel

    model, out = prepared(spark, sf_dir)
    path = scratch_path(spark, "preparation")
    model.save(spark, path)
    again = FlowPreparationModel.load(spark, path).transform(training_flows(spark, sf_dir))
    return _r(again.groupBy("target").agg(*[F.sum(f"`{c}`").alias(c) for c in model.featureNames()]), 3)




@query("a12_json_records", f"""WITH {V.FLOWS_SQL} SELECT proto, service, count(*) AS n, CAST(sum(sbytes) AS DOUBLE) AS sbytes, sum(CASE WHEN spkts > 10 THEN dwin ELSE 8192.0 END) AS dwin, count(*) * 64.0 AS dttl, 0.0 AS ct_ftp_cmd
FROM (SELECT CASE WHEN spkts > 10 THEN proto ELSE 'tcp' END AS proto, CASE WHEN dpkts > 3 THEN service ELSE 'http' END AS service, sbytes, dwin, spkts FROM flows) GROUP BY 1, 2""")
def a12(spark, sf_dir):
    f = V.flows(spark, sf_dir)
    lines = f.select(F.to_json(F.struct(
        F.when(F.col("spkts") > 10, F.col("proto")).alias("proto"), F.when(F.col("dpkts") > 3, F.col("service")).alias("service"), "sbytes",
        F.when(F.col("spkts") > 10, F.col("dwin")).alias("dwin"), F.lit("x").alias("extra"))).alias("value"))
    return records.parse_records(lines).groupBy("proto", "service").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("sbytes", "dwin", "dttl", "ct_ftp_cmd")])
