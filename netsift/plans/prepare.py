"""F: feature preparation fitted on the earlier flows and applied to the whole flow table."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.operators import profile as D
from netsift.plans import views as V
from netsift.plans.cleaning import CATS_SQL, clean_flows
from netsift.plans.profile import _MI_COLS, _union, information, mi_sql
from netsift.plans.registry import query
from netsift.prepare import (
    CategoricalEncoder, DropColumns, FeatureSelector, FlowPreparation, NumericScaler, PreparationConfig, TargetEncoder, ValueImputer, compare_strategies,
)
from netsift.prepare.encoding import label_codes
from netsift.prepare.flow import run_default
from netsift.session import materialize

_G = V.GAPPY_SQL
_COLS = [c for c in V.FLOW_TYPES if c not in ("flow_id", "label", "attack_cat")]


def _r(df, digits=6):
    return df.select(*[F.round(f"`{c}`", digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def gappy(spark, sf_dir):
    return V.gappy_flows(spark, sf_dir).drop("flow_id", "label", "attack_cat")


@query("f1_missing_constant_drop", f"WITH {_G} SELECT c AS column_name FROM (" + _union(
    "SELECT '{c}' AS c, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS m, count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INTEGER) AS k FROM gappy", _COLS)
       + ") WHERE NOT (m > 0.2 OR k <= 1 OR c IN ('srcip','dstip','sload'))")
def f1(spark, sf_dir):
    x = gappy(spark, sf_dir)
    kept = DropColumns(0.20, ["sload"]).fit(x).transform(x).columns
    return spark.createDataFrame([(c,) for c in kept], "column_name string")


@query("f2_imputation", f"""WITH {_G}, m AS (SELECT quantile_cont(dpkts, 0.5) AS dp, quantile_cont(tcprtt, 0.5) AS rtt, (SELECT service FROM gappy WHERE service IS NOT NULL GROUP BY service ORDER BY count(*) DESC, service LIMIT 1) AS sv FROM gappy)
SELECT coalesce(service, sv) AS service, count(*) AS n, round(sum(coalesce(dpkts, dp)), 4) AS dpkts, round(sum(coalesce(tcprtt, rtt)), 4) AS tcprtt FROM gappy, m GROUP BY 1""")
def f2(spark, sf_dir):
    x = gappy(spark, sf_dir).select("service", "dpkts", "tcprtt")
    out = ValueImputer().fit(x).transform(x)
    return out.groupBy("service").agg(F.count("*").alias("n"), F.round(F.sum("dpkts").cast("double"), 4).alias("dpkts"), F.round(F.sum("tcprtt"), 4).alias("tcprtt"))


_SEL = ["sbytes", "sload", "dbytes", "dload", "stime", "ltime", "swin", "dwin", "spkts", "sttl"]


@query("f3_correlated_removal", f"""WITH {V.FLOWS_SQL}, v AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS c, round(var_samp({c}), 4) AS v FROM flows" for c in _SEL) + "), p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS r, '{b}' AS c, abs(corr({a}, {b})) AS k FROM flows" for i, a in enumerate(_SEL) for b in _SEL[i + 1:])
    + ") SELECT DISTINCT CASE WHEN p.c = 'ltime' THEN p.r WHEN p.r = 'ltime' THEN p.c WHEN vc.v > vr.v THEN p.r ELSE p.c END AS column_name FROM p JOIN v vc ON vc.c = p.c JOIN v vr ON vr.c = p.r WHERE k > 0.7")
def f3(spark, sf_dir):
    x = materialize(V.flows(spark, sf_dir).select(*_SEL), "selection-flows")
    gone = FeatureSelector(None, 0.7, protected=["ltime"]).fit(x).fitted["correlated"]
    return spark.createDataFrame([(c,) for c in gone], "column_name string")


@query("f4_low_information_removal", f"WITH {_G}, {mi_sql('gappy', _MI_COLS, 'label')} SELECT feature FROM mi WHERE mi < 0.0005 AND feature <> 'sbytes'")
def f4(spark, sf_dir):
    return D.low_information(information(spark, sf_dir), 0.0005, ["sbytes"]).select("feature")


@query("f5_percentile_caps", f"""WITH {V.FLOWS_SQL}, b AS (SELECT quantile_cont(sbytes, 0.01) AS s0, quantile_cont(sbytes, 0.99) AS s1, quantile_cont(dload, 0.01) AS d0, quantile_cont(dload, 0.99) AS d1 FROM flows)
SELECT flow_id, round(least(greatest(sbytes, s0), s1), 4) AS sbytes, round(least(greatest(dload, d0), d1), 4) AS dload FROM flows, b""")
def f5(spark, sf_dir):
    x = V.flows(spark, sf_dir).select("flow_id", "sbytes", "dload")
    return _r(FeatureSelector(None, 1.0, passthrough=["flow_id"]).fit(x).transform(x), 4)


@query("f6_information_report", f"WITH {_G}, {mi_sql('gappy', _MI_COLS, 'label')} SELECT CAST(row_number() OVER (ORDER BY mi DESC, feature) AS INTEGER) AS rank, feature, round(mi, 6) AS mi_score, mi < 0.0005 AS will_remove FROM mi")
def f6(spark, sf_dir):
    mi = information(spark, sf_dir)
    return _r(D.information_report(mi, 0.0005))


@query("f7_target_encoding", f"""WITH {V.FLOWS_SQL}, tr AS (SELECT * FROM flows WHERE stime < 896659200), g AS (SELECT avg(spkts) AS m FROM tr),
e AS (SELECT srcip, CASE WHEN count(*) >= 3 THEN count(*) / (count(*) + 5.0) * avg(spkts) + (1 - count(*) / (count(*) + 5.0)) * (SELECT m FROM g) ELSE (SELECT m FROM g) END AS v FROM tr GROUP BY srcip)
SELECT flow_id, round(coalesce(v, (SELECT m FROM g)), 6) AS srcip FROM flows LEFT JOIN e USING (srcip)""")
def f7(spark, sf_dir):
    model = TargetEncoder("srcip", "spkts", smoothing=5.0, min_samples=3).fit(V.baseline(spark, sf_dir).select("srcip", "spkts"))
    return _r(model.transform(V.flows(spark, sf_dir).select("flow_id", "srcip")))


@query("f8_label_encoding", f"""WITH {V.FLOWS_SQL}, c AS (SELECT service, row_number() OVER (ORDER BY service) - 1 AS code FROM (SELECT DISTINCT service FROM flows WHERE stime < 896659200)),
l AS (SELECT CASE WHEN stime >= 896659200 AND service = 'http' THEN 'quic' ELSE service END AS service FROM flows)
SELECT coalesce(code, 0) AS service, count(*) AS n FROM l LEFT JOIN c USING (service) GROUP BY 1""")
def f8(spark, sf_dir):
    model = CategoricalEncoder("label", ["service"]).fit(V.baseline(spark, sf_dir).select("service"))
    seen = V.baseline(spark, sf_dir).select("service").unionByName(V.live(spark, sf_dir).select("service"))
    return model.transform(seen).groupBy("service").agg(F.count("*").alias("n"))


@query("f8_label_codes_of_sources", f"WITH {V.FLOWS_SQL} SELECT srcip AS category, row_number() OVER (ORDER BY srcip) - 1 AS value FROM (SELECT DISTINCT srcip FROM flows)")
def f8_codes(spark, sf_dir):
    return label_codes(V.flows(spark, sf_dir), "srcip")


@query("f9_one_hot_encoding", f"""WITH {V.FLOWS_SQL} SELECT flow_id, """ + ", ".join(
    f"CASE WHEN state = '{s}' THEN 1.0 ELSE 0.0 END AS \"state_{s}\"" for s in ("FIN", "INT")) + ", " + ", ".join(
    f"CASE WHEN service = '{s}' THEN 1.0 ELSE 0.0 END AS \"service_{s}\"" for s in ("dns", "ftp", "http", "https", "smtp", "ssh")) + " FROM flows")
def f9(spark, sf_dir):
    x = V.flows(spark, sf_dir).select("flow_id", "state", "service")
    return CategoricalEncoder("onehot", ["state", "service"]).fit(x).transform(x)


def config(**kw):
    return PreparationConfig(target="target", passthrough=["flow_id"], drop=[], mi_threshold=0.0, **kw)


def training_flows(spark, sf_dir):
    """Gappy flows with the class code of the cleaned category as target."""
    codes = F.create_map(*[x for i, c in enumerate(sorted(["DoS", "Exploits", "Backdoor", "Normal", "Fuzzers"])) for x in (F.lit(c), F.lit(i))])
    return clean_flows(spark, sf_dir).withColumn("target", F.element_at(codes, F.col("cat"))).drop("cat", "attack_cat", "label")


@query("f10_hybrid_encoding", f"""WITH {CATS_SQL}, t AS (SELECT *, list_position(['Backdoor','DoS','Exploits','Fuzzers','Normal'], cat) - 1 AS y FROM cats), g AS (SELECT avg(y) AS m FROM t),
ed AS (SELECT dstip, count(*) / (count(*) + 1.0) * avg(y) + (1 - count(*) / (count(*) + 1.0)) * (SELECT m FROM g) AS v FROM t GROUP BY dstip),
ep AS (SELECT proto, count(*) / (count(*) + 1.0) * avg(y) + (1 - count(*) / (count(*) + 1.0)) * (SELECT m FROM g) AS v FROM t GROUP BY proto)
SELECT flow_id, round(ed.v, 6) AS dstip, round(ep.v, 6) AS proto, CASE WHEN state = 'FIN' THEN 1.0 ELSE 0.0 END AS "state_FIN", CASE WHEN state = 'INT' THEN 1.0 ELSE 0.0 END AS "state_INT"
FROM t JOIN ed USING (dstip) JOIN ep USING (proto)""")
def f10(spark, sf_dir):
    x = training_flows(spark, sf_dir).select("flow_id", "dstip", "proto", "state", "target")
    model = CategoricalEncoder("hybrid", ["dstip", "proto", "state"], "target", ["proto"], threshold=9, passthrough=["flow_id"]).fit(x)
    return _r(model.transform(x).drop("target"))


@query("f11_encoding_report", f"WITH {V.FLOWS_SQL} SELECT 'dstip' AS column_name, 'target' AS encoding_type, CAST(count(DISTINCT dstip) AS INTEGER) AS num_categories FROM flows UNION ALL SELECT 'state', 'onehot', CAST(count(DISTINCT state) - 1 AS INTEGER) FROM flows")
def f11(spark, sf_dir):
    x = training_flows(spark, sf_dir).select("dstip", "state", "target")
    return CategoricalEncoder("hybrid", ["dstip", "state"], "target", threshold=9).fit(x).report(spark)


_SC = ["sbytes", "dload", "dttl", "spkts"]


def _scale_sql(center: str, scale: str) -> str:
    stats = ", ".join(f"{center.format(c=c)} AS c_{c}, {scale.format(c=c)} AS s_{c}" for c in _SC)
    cols = ", ".join(f"round((CAST({c} AS DOUBLE) - c_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}" for c in _SC)
    return f"WITH {V.FLOWS_SQL}, p AS (SELECT {stats} FROM flows WHERE stime < 896659200) SELECT flow_id, {cols} FROM flows, p"


def _scaled(spark, sf_dir, strategy):
    model = NumericScaler(strategy, _SC).fit(V.baseline(spark, sf_dir).select(*_SC))
    return model, model.transform(V.flows(spark, sf_dir).select("flow_id", *_SC))


@query("f12_standard_scaling", _scale_sql("avg({c})", "stddev_pop({c})"))
def f12(spark, sf_dir):
    return _r(_scaled(spark, sf_dir, "standard")[1])


@query("f13_min_max_scaling", _scale_sql("min({c})", "CAST(max({c}) - min({c}) AS DOUBLE)"))
def f13(spark, sf_dir):
    return _r(_scaled(spark, sf_dir, "minmax")[1])


@query("f14_robust_scaling", _scale_sql("quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def f14(spark, sf_dir):
    return _r(_scaled(spark, sf_dir, "robust")[1])


@query("f15_power_scaling")
def f15(spark, sf_dir):
    model = NumericScaler("power", ["sbytes", "spkts"]).fit(V.baseline(spark, sf_dir).select("sbytes", "spkts"))
    return _r(model.transform(V.flows(spark, sf_dir).select("flow_id", "sbytes", "spkts")))


@query("f16_quantile_scaling")
def f16(spark, sf_dir):
    model = NumericScaler("quantile", ["sbytes", "spkts"]).fit(V.baseline(spark, sf_dir).select("sbytes", "spkts"))
    return _r(model.transform(V.flows(spark, sf_dir).select("flow_id", "sbytes", "spkts")))


@query("f17_wide_range_scaling", f"""WITH {V.FLOWS_SQL}, p AS (SELECT avg(sbytes) AS m, stddev_pop(sbytes) AS s FROM flows) SELECT flow_id, round((sbytes - m) / s, 6) AS sbytes, spkts, dload FROM flows, p""")
def f17(spark, sf_dir):
    x = V.flows(spark, sf_dir).select("flow_id", "sbytes", "spkts", "dload")
    wide = [r["column_name"] for r in D.wide_range_columns(x, 1_000.0).collect()]
    return _r(NumericScaler("standard", wide, ["dload"]).fit(x).transform(x))


@query("f18_partial_columns", _scale_sql("quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))").replace("SELECT flow_id, ", "SELECT * EXCLUDE (dload, dttl) FROM (SELECT flow_id, ") + ")")
def f18(spark, sf_dir):
    model = NumericScaler("robust", _SC).fit(V.baseline(spark, sf_dir).select(*_SC))
    return _r(model.transform(V.flows(spark, sf_dir).select("flow_id", "sbytes", "spkts")))


@query("f19_inverse_transform", f"WITH {V.FLOWS_SQL} SELECT flow_id, " + ", ".join(f"round(CAST({c} AS DOUBLE), 3) AS {c}" for c in _SC) + " FROM flows")
def f19(spark, sf_dir):
    model, scaled = _scaled(spark, sf_dir, "robust")
    return _r(model.inverse_transform(scaled), 3)


@query("f20_scaling_report", f"WITH {V.FLOWS_SQL} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'minmax' AS strategy, CAST(min({c}) AS DOUBLE) AS data_min, CAST(max({c}) AS DOUBLE) AS data_max, CASE WHEN max({c}) = min({c}) THEN 1 ELSE CAST(max({c}) - min({c}) AS DOUBLE) END AS scale FROM flows WHERE stime < 896659200" for c in _SC) + ")")
def f20(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")[0].report(spark).select("column_name", "strategy", "data_min", "data_max", "scale")


def _shape(name, expr):
    n, g1, g2 = "count(*)", "(avg(pow(v - m, 3)) / pow(stddev_pop(v), 3))", "(avg(pow(v - m, 4)) / pow(var_pop(v), 2) - 3)"
    return f"""SELECT '{name}' AS strategy, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max, round(quantile_cont(v, 0.5), 4) AS median,
  round({g1} * sqrt({n} * ({n} - 1)) / ({n} - 2), 4) AS skewness, round(({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * {g2} + 6), 4) AS kurtosis
  FROM (SELECT v, avg(v) OVER () AS m FROM (SELECT {expr} AS v FROM flows, p))"""


def strategy_flows(spark, sf_dir):
    """The one column, written once: fits, medians and shapes of the strategies read it many times."""
    return materialize(V.flows(spark, sf_dir).select("sttl"), "strategy-flows")


@query("f21_strategy_comparison", f"WITH {V.FLOWS_SQL}, p AS (SELECT avg(sttl) AS a, stddev_pop(sttl) AS s, min(sttl) AS lo, max(sttl) AS hi, quantile_cont(sttl, 0.5) AS md, quantile_cont(sttl, 0.75) - quantile_cont(sttl, 0.25) AS iqr FROM flows) "
       + " UNION ALL ".join([_shape("Original", "CAST(sttl AS DOUBLE)"), _shape("StandardScaler", "(sttl - a) / s"), _shape("MinMaxScaler", "(sttl - lo) / (hi - lo)"), _shape("RobustScaler", "(sttl - md) / iqr")]))
def f21(spark, sf_dir):
    # the power row has no closed SQL form; tests check it
    return compare_strategies(strategy_flows(spark, sf_dir), "sttl").where("strategy <> 'PowerTransformer'")


@query("f21_all_strategies")
def f21_all(spark, sf_dir):
    return compare_strategies(strategy_flows(spark, sf_dir), "sttl")


def prepared(spark, sf_dir, **kw):
    t = training_flows(spark, sf_dir)
    model = FlowPreparation(config(**kw)).fit(t.where(F.col("stime") < 896_659_200))
    return model, model.transform(t)


@query("f22_composed_preparation")
def f22(spark, sf_dir):
    return _r(prepared(spark, sf_dir)[1])


@query("f23_end_to_end_run")
def f23(spark, sf_dir):
    t = training_flows(spark, sf_dir)
    early = F.col("stime") < 896_659_200
    out = run_default(t.where(early), t.where(~early), config(imbalance="undersample"))[3]
    return out["shapes"].select("stage", F.lit("rows").alias("item"), "rows").unionByName(
        out["classes"].select("stage", F.col("class").alias("item"), F.col("n").alias("rows")))


@query("f24_preparation_report")
def f24(spark, sf_dir):
    return prepared(spark, sf_dir)[0].report(spark)


@query("f25_output_features")
def f25(spark, sf_dir):
    names = prepared(spark, sf_dir)[0].featureNames()
    return spark.createDataFrame(list(enumerate(names)), "position int, feature string")
