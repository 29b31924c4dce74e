"""I: drift between the earlier and the later part of the flow table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netsift.operators import drift as I
from netsift.plans import views as V
from netsift.plans.registry import query

FEATURES = V.NUMERIC
CATS = ["proto", "state", "service"]

_STEPS = {k: "[" + ", ".join(repr(i / k) for i in range(k + 1)) + "]" for k in range(3, 16)}


def _long_sql(features) -> str:
    return ", long AS (" + " UNION ALL ".join(
        f"SELECT {i} AS side, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {s}" for c in features for i, s in enumerate(("baseline", "live"))) + ")"


_NUM_BODY = """,
vc AS (SELECT feature, x, count(*) FILTER (side = 0) AS nb, count(*) FILTER (side = 1) AS nl FROM long GROUP BY ALL),
ks AS (SELECT feature, max(abs(cb / tb - cl / tl)) AS ks, any_value(tb) AS tb, any_value(tl) AS tl FROM (SELECT feature, sum(nb) OVER w AS cb, sum(nl) OVER w AS cl,
   sum(nb) OVER (PARTITION BY feature) AS tb, sum(nl) OVER (PARTITION BY feature) AS tl FROM vc WINDOW w AS (PARTITION BY feature ORDER BY x)) GROUP BY feature),
kp AS (SELECT *, CASE WHEN ks <= 0 THEN 1 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * ks * ks * tb * tl / (tb + tl)))), 0), 1) END AS pvalue FROM ks),
st AS (SELECT feature, count(*) AS n, count(DISTINCT x) AS u, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, """ + ", ".join(
    f"list_sort(list_distinct(quantile_cont(x, {_STEPS[k]}))) AS q{k}" for k in range(3, 16)) + """,
   avg(x) FILTER (side = 0) AS mb, avg(x) FILTER (side = 1) AS ml, stddev_pop(x) FILTER (side = 0) AS sb FROM long GROUP BY feature),
bn AS (SELECT *, CASE WHEN iqr > 0 THEN CAST(ceil((hi - lo) / (2.0 * iqr * pow(n, -1.0/3.0))) AS BIGINT) ELSE 1 END AS bins FROM st),
ed AS (SELECT feature, lo, hi, mb, ml, sb, CASE WHEN u <= 2 THEN [lo - 0.5, hi + 0.5]
   WHEN bins BETWEEN 2 AND 15 THEN list_transform(range(bins + 1), lambda i: CASE WHEN i = bins THEN hi ELSE lo + i * ((hi - lo) / bins) END)
   WHEN bins < 2 THEN CASE least(u, 15) """ + " ".join(f"WHEN {k} THEN q{k}" for k in range(3, 15)) + """ ELSE q15 END ELSE q15 END AS e FROM bn),
hb AS (SELECT feature, least(len(list_filter(e, lambda v: v <= x)) - 1, len(e) - 2) AS bin, sum(nb) AS nb, sum(nl) AS nl FROM vc JOIN ed USING (feature) GROUP BY ALL),
gr AS (SELECT feature, unnest(range(len(e) - 1)) AS bin, unnest(e[:len(e) - 1]) AS left_edge FROM ed),
ds AS (SELECT feature, bin, left_edge, coalesce(nb, 0) / sum(coalesce(nb, 0)) OVER (PARTITION BY feature) AS p, coalesce(nl, 0) / sum(coalesce(nl, 0)) OVER (PARTITION BY feature) AS q FROM gr LEFT JOIN hb USING (feature, bin)),
dv AS (SELECT feature, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END) AS js,
   sum((q - p) * ln((q + 1e-6) / (p + 1e-6))) AS psi FROM ds GROUP BY feature),
num AS (SELECT feature, ks, pvalue, js, psi, mb, ml, CASE WHEN sb <= 1e-9 THEN 0 ELSE least(abs(ml - mb) / (sb + 1e-9), 3.0) / 3.0 END AS shift
   FROM kp JOIN dv USING (feature) JOIN ed USING (feature)),
numr AS (SELECT *, least(greatest(0.35 * ks + 0.25 * least(abs(psi) / 0.25, 1) + 0.25 * js + 0.15 * shift, 0), 1) AS score FROM num)"""
NUM_SQL = V.SIDES_SQL + _long_sql(FEATURES) + _NUM_BODY

CAT_SQL = V.SIDES_SQL + ", clong AS (" + " UNION ALL ".join(
    f"SELECT {i} AS side, '{c}' AS feature, lower(trim({c})) AS category FROM {s}" for c in CATS for i, s in enumerate(("baseline", "live"))) + """),
cc AS (SELECT feature, category, count(*) FILTER (side = 0) AS nb, count(*) FILTER (side = 1) AS nl FROM clong GROUP BY ALL),
un AS (SELECT feature, sum(CASE WHEN nb = 0 THEN nl ELSE 0 END) / sum(nl) AS unseen_rate FROM cc GROUP BY feature),
fo AS (SELECT feature, CASE WHEN nb = 0 THEN '__unseen__' ELSE category END AS category, sum(nb) AS nb, sum(nl) AS nl FROM cc GROUP BY ALL),
sh AS (SELECT *, nb / sum(nb) OVER (PARTITION BY feature) AS p, nl / sum(nl) OVER (PARTITION BY feature) AS q, sum(nb) OVER (PARTITION BY feature) AS tb, sum(nl) OVER (PARTITION BY feature) AS tl FROM fo),
ch AS (SELECT feature, sum(pow(nb - (nb + nl) * tb / (tb + tl), 2) / ((nb + nl) * tb / (tb + tl)) + pow(nl - (nb + nl) * tl / (tb + tl), 2) / ((nb + nl) * tl / (tb + tl))) AS chi2, count(*) - 1 AS dof,
   sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END) AS js FROM sh GROUP BY feature)"""

# The tail of the chi-square distribution by Simpson integration over u = sqrt(t), independent of the closed form.
_CUT = """, pv AS (SELECT feature, chi2, dof, js, CASE WHEN dof < 1 OR chi2 <= 0 THEN 1 ELSE least(1, list_sum(list_transform(range(0, 2001), lambda k:
  (CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * 2 * pow(sqrt(chi2) + k * 0.007, dof - 1) * exp(-pow(sqrt(chi2) + k * 0.007, 2) / 2) / (pow(2, dof / 2.0) * gamma(dof / 2.0)))) * 0.007 / 3) END AS p FROM ch),
catr AS (SELECT pv.feature, least(greatest(0.45 * js + 0.35 * (1 - p) + 0.2 * unseen_rate, 0), 1) AS score, js, CASE WHEN dof < 1 THEN 0 ELSE chi2 END AS chi2, p, unseen_rate,
  u.baseline_unique, u.live_unique FROM pv JOIN un USING (feature) JOIN (SELECT feature, count(*) FILTER (nb > 0) AS baseline_unique, count(*) FILTER (nl > 0) AS live_unique FROM cc GROUP BY feature) u USING (feature))"""
_ALL = [c for c in V.NUMERIC]
_CAT_BODY = CAT_SQL[len(V.SIDES_SQL):] + _CUT
_RESULT_SQL = V.SIDES_SQL + _long_sql(_ALL) + _NUM_BODY + _CAT_BODY + """, res AS (
  SELECT feature, 'numeric' AS feature_type, score AS drift_score, ks AS ks_stat, pvalue AS ks_pvalue, js AS js_divergence, 0.0 AS chi2_stat, 1.0 AS chi2_pvalue, psi, 0.0 AS unseen_rate,
    mb AS baseline_mean, ml AS live_mean, baseline_unique, live_unique FROM numr JOIN (SELECT feature, count(*) FILTER (nb > 0) AS baseline_unique, count(*) FILTER (nl > 0) AS live_unique FROM vc GROUP BY feature) USING (feature)
  UNION ALL SELECT unnest(['srcip', 'dstip']), 'numeric', 0, 0, 1, 0, 0, 1, 0, 0, NULL, NULL, 0, 0
  UNION ALL SELECT feature, 'categorical', score, 0, 1, js, chi2, p, 0, unseen_rate, NULL, NULL, baseline_unique, live_unique FROM catr)"""
_RES_COLS = "feature, feature_type, round(drift_score, 6) AS drift_score, round(ks_stat, 6) AS ks_stat, round(ks_pvalue, 6) AS ks_pvalue, round(js_divergence, 6) AS js_divergence, round(chi2_stat, 4) AS chi2_stat, round(chi2_pvalue, 6) AS chi2_pvalue, round(psi, 6) AS psi, round(unseen_rate, 6) AS unseen_rate, round(baseline_mean, 2) AS baseline_mean, round(live_mean, 2) AS live_mean, baseline_unique, live_unique"


def _res(df):
    digits = {"chi2_stat": 4, "baseline_mean": 2, "live_mean": 2}
    return df.drop("note").select(*[F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.drop("note").dtypes])


def _num(spark, sf_dir):
    return V.baseline(spark, sf_dir).select(*FEATURES), V.live(spark, sf_dir).select(*FEATURES)


def _values(spark, sf_dir):
    return I.value_table(*_num(spark, sf_dir), FEATURES)


def _r(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _cat_counts(spark, sf_dir):
    b, l = (I.prepare(f(spark, sf_dir).select(*CATS)) for f in (V.baseline, V.live))
    return I.category_counts(b, l, CATS)


@query("i1_frame_preparation", f"WITH {V.FLOWS_SQL} SELECT proto, service, state, count(*) AS n, CAST(sum(sbytes) AS DOUBLE) AS sbytes, count(CASE WHEN spkts <> 1 THEN 1 END) AS packets FROM (SELECT lower(proto) AS proto, service, lower(state) AS state, sbytes, spkts FROM flows) GROUP BY 1, 2, 3")
def i1(spark, sf_dir):
    f = V.flows(spark, sf_dir).select(
        F.upper("proto").alias(" Proto "), F.concat(F.lit(" "), "service").alias("SERVICE"), "state", F.col("sbytes").cast("string").alias("sbytes"),
        F.when(F.col("spkts") == 1, "?").otherwise(F.col("spkts").cast("string")).alias("spkts"), F.lit(1).alias("target"))
    return I.prepare(f).groupBy("proto", "service", "state").agg(F.count("*").alias("n"), F.sum("sbytes").alias("sbytes"), F.count("spkts").alias("packets"))


@query("i2_ks_statistic", f"WITH {NUM_SQL} SELECT feature, round(ks, 6) AS ks_stat FROM ks")
def i2(spark, sf_dir):
    return _r(I.ks_statistics(_values(spark, sf_dir)).drop("ks_pvalue"))


@query("i3_ks_pvalue", f"WITH {NUM_SQL} SELECT feature, round(pvalue, 6) AS ks_pvalue FROM kp")
def i3(spark, sf_dir):
    return _r(I.ks_statistics(_values(spark, sf_dir)).drop("ks_stat"))


@query("i4_adaptive_bin_edges", f"WITH {NUM_SQL} SELECT feature, CAST(unnest(range(len(e))) AS BIGINT) AS edge_no, round(unnest(e), 3) AS edge FROM ed")
def i4(spark, sf_dir):
    edges = I.bin_edges(_values(spark, sf_dir))
    rows = [(c, i, float(x)) for c, e in edges.items() for i, x in enumerate(e)]
    return _r(spark.createDataFrame(rows, "feature string, edge_no long, edge double"), 3)


def _dist(spark, sf_dir):
    v = _values(spark, sf_dir)
    return I.histogram_distributions(v, I.bin_edges(v))


@query("i5_histogram_distribution", f"WITH {NUM_SQL} SELECT feature, bin, round(p, 6) AS p, round(q, 6) AS q FROM ds")
def i5(spark, sf_dir):
    return _r(_dist(spark, sf_dir).select("feature", "bin", "p", "q"))


@query("i6_js_divergence", f"WITH {NUM_SQL} SELECT feature, round(js, 6) AS js_divergence FROM dv")
def i6(spark, sf_dir):
    return _r(I.divergences(_dist(spark, sf_dir)).drop("psi"))


@query("i7_stability_index", f"WITH {NUM_SQL} SELECT feature, round(psi, 6) AS psi FROM dv")
def i7(spark, sf_dir):
    return _r(I.divergences(_dist(spark, sf_dir)).drop("js_divergence"))


_DEC = "[" + ", ".join(repr(i / 10) for i in range(11)) + "]"


@query("i8_psi_baseline_deciles", f"""WITH {NUM_SQL}, de AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, {_DEC}) FILTER (side = 0))) AS e, count(DISTINCT x) FILTER (side = 0) AS ub, count(DISTINCT x) FILTER (side = 1) AS ul FROM long GROUP BY feature),
dn AS (SELECT feature, greatest(len(list_filter(e, lambda v: v < x)) - 1, 0) AS bin, sum(nb) AS nb, sum(nl) AS nl FROM vc JOIN de USING (feature) WHERE len(e) >= 2 AND x >= e[1] AND x <= e[-1] GROUP BY ALL),
dg AS (SELECT feature, unnest(range(len(e) - 1)) AS bin FROM de WHERE len(e) >= 2),
dp AS (SELECT feature, coalesce(nb, 0) / sum(coalesce(nb, 0)) OVER w AS p, coalesce(coalesce(nl, 0) / nullif(sum(coalesce(nl, 0)) OVER w, 0), 0) AS q FROM dg LEFT JOIN dn USING (feature, bin) WINDOW w AS (PARTITION BY feature))
SELECT feature, round(CASE WHEN ub <= 1 THEN CASE WHEN ul <= 1 THEN 0 ELSE 1 END ELSE psi END, 6) AS psi FROM de LEFT JOIN (SELECT feature, sum((q - p) * ln((q + 1e-6) / (p + 1e-6))) AS psi FROM dp GROUP BY feature) USING (feature)""")
def i8(spark, sf_dir):
    return _r(I.psi_deciles(*_num(spark, sf_dir), FEATURES))


@query("i9_psi_categories", f"""WITH {CAT_SQL}, s9 AS (SELECT feature, nb / sum(nb) OVER (PARTITION BY feature) AS p, nl / sum(nl) OVER (PARTITION BY feature) AS q FROM cc)
SELECT feature, round(sum((q - p) * ln((q + 1e-6) / (p + 1e-6))), 6) AS psi FROM s9 GROUP BY feature""")
def i9(spark, sf_dir):
    return _r(I.psi_categories(_cat_counts(spark, sf_dir)))


@query("i10_unseen_rate", f"WITH {CAT_SQL} SELECT feature, round(unseen_rate, 6) AS unseen_rate, baseline_unique, live_unique FROM un JOIN (SELECT feature, count(*) FILTER (nb > 0) AS baseline_unique, count(*) FILTER (nl > 0) AS live_unique FROM cc GROUP BY feature) USING (feature)")
def i10(spark, sf_dir):
    return _r(I.unseen_rates(_cat_counts(spark, sf_dir)))


@query("i11_aligned_shares", f"WITH {CAT_SQL} SELECT feature, category, round(p, 6) AS p, round(q, 6) AS q FROM sh")
def i11(spark, sf_dir):
    return _r(I.aligned_shares(_cat_counts(spark, sf_dir)))


@query("i12_chi_square", f"WITH {CAT_SQL} SELECT feature, round(CASE WHEN dof >= 1 THEN chi2 ELSE 0 END, 4) AS chi2_stat, dof FROM ch")
def i12(spark, sf_dir):
    return _r(I.chi_square(I.fold_unseen(_cat_counts(spark, sf_dir))), 4)


@query("i13_mean_shift", f"WITH {NUM_SQL} SELECT feature, round(mb, 3) AS baseline_mean, round(ml, 3) AS live_mean, round(shift, 6) AS mean_shift FROM num")
def i13(spark, sf_dir):
    m = I.mean_shifts(_values(spark, sf_dir))
    return m.select("feature", F.round("baseline_mean", 3).alias("baseline_mean"), F.round("live_mean", 3).alias("live_mean"), F.round("mean_shift", 6).alias("mean_shift"))


@query("i14_numeric_score", f"WITH {NUM_SQL} SELECT feature, round(score, 6) AS drift_score, u.baseline_unique, u.live_unique FROM numr JOIN (SELECT feature, count(*) FILTER (nb > 0) AS baseline_unique, count(*) FILTER (nl > 0) AS live_unique FROM vc GROUP BY feature) u USING (feature)")
def i14(spark, sf_dir):
    return _r(I.numeric_results(*_num(spark, sf_dir), FEATURES).select("feature", "drift_score", "baseline_unique", "live_unique"))


@query("i15_categorical_score", f"WITH {CAT_SQL}{_CUT} SELECT feature, round(score, 6) AS drift_score, round(js, 6) AS js_divergence, round(chi2, 4) AS chi2_stat, round(p, 6) AS chi2_pvalue, round(unseen_rate, 6) AS unseen_rate, baseline_unique, live_unique FROM catr")
def i15(spark, sf_dir):
    b, l = (I.prepare(f(spark, sf_dir).select(*CATS)) for f in (V.baseline, V.live))
    return _res(I.categorical_results(b, l, CATS)).select("feature", "drift_score", "js_divergence", "chi2_stat", "chi2_pvalue", "unseen_rate", "baseline_unique", "live_unique")


@query("i16_all_feature_comparison", f"WITH {_RESULT_SQL} SELECT {_RES_COLS} FROM res")
def i16(spark, sf_dir):
    drop = ["flow_id", "attack_cat", "label"]
    return _res(I.compare_features(V.baseline(spark, sf_dir).drop(*drop), V.live(spark, sf_dir).drop(*drop)))


@query("i17_all_numeric_comparison", f"WITH {NUM_SQL} SELECT feature, round(score, 6) AS drift_score, round(ks, 6) AS ks_stat, round(js, 6) AS js_divergence FROM numr")
def i17(spark, sf_dir):
    return _r(I.compare_numeric(*_num(spark, sf_dir)).select("feature", "drift_score", "ks_stat", "js_divergence"))


def importances(spark, sf_dir):
    """Stand-in model importances counted from the flows: one-hot service columns, derived and plain features."""
    f = V.flows(spark, sf_dir)
    onehot = f.groupBy(F.concat(F.lit("service_"), "service").alias("feature")).agg(F.count("*").cast("double").alias("importance"))
    plain = f.agg(*[F.sum(e).cast("double").alias(c) for c, e in {
        "duration": F.col("spkts"), "packet_rate": F.col("dpkts"), "byte_ratio": F.col("sttl"), "sbytes": F.col("spkts") * 2,
        "state__x": F.col("ct_srv_src"), "proto_enc": F.col("ct_state_ttl"), "mystery": F.col("spkts")}.items()])
    return onehot.unionByName(plain.unpivot([], plain.columns, "feature", "importance"))


IMP_SQL = """imp AS (SELECT 'service' AS feature, CAST(count(*) AS DOUBLE) AS s FROM flows
  UNION ALL SELECT unnest(['stime','ltime']), sum(spkts) / 2 FROM flows UNION ALL SELECT unnest(['dpkts','stime','ltime']), sum(dpkts) / 3 FROM flows
  UNION ALL SELECT unnest(['sbytes','dbytes']), sum(sttl) / 2 FROM flows UNION ALL SELECT 'sbytes', sum(spkts * 2) FROM flows
  UNION ALL SELECT 'state', sum(ct_srv_src) FROM flows UNION ALL SELECT 'proto', sum(ct_state_ttl) FROM flows),
imps AS (SELECT feature, sum(s) / (SELECT sum(s) FROM imp) AS importance FROM imp GROUP BY feature)"""
_PRESENT = ["proto", "state", "service", "sbytes", "dbytes", "dpkts", "stime", "ltime", "sttl"]


@query("i18_importance_collapse", f"WITH {V.FLOWS_SQL}, {IMP_SQL} SELECT p.feature, round(coalesce(importance, 0), 6) AS importance FROM (SELECT unnest({_PRESENT}) AS feature) p LEFT JOIN imps USING (feature)")
def i18(spark, sf_dir):
    return _r(I.collapse_importances(importances(spark, sf_dir), _PRESENT, ["service"]))


_RISK_SQL = f"""WITH {NUM_SQL}, {IMP_SQL}, rk AS (SELECT feature, score, coalesce(importance, 0) AS importance, least(greatest(score * (0.5 + 0.5 * least(greatest(coalesce(importance, 0), 0), 1)), 0), 1) AS risk FROM numr LEFT JOIN imps USING (feature)),
sv AS (SELECT *, CASE WHEN score >= 0.6 THEN 'severe' WHEN score >= 0.4 THEN 'moderate' WHEN score >= 0.2 THEN 'low' ELSE 'stable' END AS severity FROM rk)"""


def risked(spark, sf_dir):
    r = I.numeric_results(*_num(spark, sf_dir), FEATURES)
    return I.with_risk(r, I.collapse_importances(importances(spark, sf_dir), FEATURES, ["service"]))


def rated(spark, sf_dir):
    return I.with_severity(risked(spark, sf_dir), I.thresholds(F.array().cast("array<double>")))


@query("i19_risk_score", f"{_RISK_SQL} SELECT feature, round(risk, 6) AS risk_score FROM rk")
def i19(spark, sf_dir):
    return _r(risked(spark, sf_dir).select("feature", "risk_score"))


# Batches of a monitored series: one per user and day, scored from the events.
def batches(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("day", F.unix_date(F.col("ts").cast("date")))
    m = (F.col("user_id") % 5).alias("monitor")
    b = e.groupBy(m, "day").agg(
        F.count("*").alias("feature_count"), F.count_if(F.col("value") > 40).alias("drift_count"), F.count_if(F.col("value") > 120).alias("severe_count"),
        (F.round(F.sum(F.when(F.col("event_type") == "error", F.least(F.col("value"), F.lit(60.0))).otherwise(0.0)), 2) / F.count("*") / 12).alias("overall_score"))
    frac = lambda c: F.col(c) / F.col("feature_count")
    w = Window.partitionBy("monitor").orderBy("day").rowsBetween(-20, -1)
    return b.withColumn("drift_fraction", frac("drift_count")).withColumn("severe_fraction", frac("severe_count")).withColumn("history", F.collect_list("overall_score").over(w))


BATCH_SQL = """b0 AS (SELECT user_id % 5 AS monitor, CAST(epoch(CAST(ts AS DATE)) / 86400 AS INTEGER) AS day, count(*) AS feature_count, count(*) FILTER (value > 40) AS drift_count, count(*) FILTER (value > 120) AS severe_count,
  round(sum(CASE WHEN event_type = 'error' THEN least(value, 60) ELSE 0 END), 2) / count(*) / 12 AS overall_score FROM events GROUP BY ALL),
b1 AS (SELECT *, drift_count / feature_count AS drift_fraction, severe_count / feature_count AS severe_fraction, coalesce(list(overall_score) OVER (PARTITION BY monitor ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), []) AS h FROM b0),
b2 AS (SELECT *, list_sort(h) AS sh, len(h) AS hn FROM b1),
b3 AS (SELECT *, """ + ", ".join(
    f"sh[CAST(floor((hn-1)*{p}) AS BIGINT)+1] + (sh[CAST(ceil((hn-1)*{p}) AS BIGINT)+1] - sh[CAST(floor((hn-1)*{p}) AS BIGINT)+1]) * ((hn-1)*{p} - floor((hn-1)*{p})) AS hq{i}" for i, p in enumerate((0.60, 0.85, 0.95))) + """ FROM b2),
b4 AS (SELECT *, greatest(0.2, coalesce(0.85*0.2 + 0.15*hq0, 0.2)) AS low FROM b3), b5 AS (SELECT *, greatest(low + 0.05, coalesce(0.85*0.4 + 0.15*hq1, 0.4)) AS moderate FROM b4),
b6 AS (SELECT *, greatest(moderate + 0.05, coalesce(0.85*0.6 + 0.15*hq2, 0.6)) AS severe FROM b5),
b7 AS (SELECT *, CASE WHEN hn = 0 THEN 0 ELSE overall_score - h[-1] END AS delta, list_concat(h[greatest(hn-3, 1):hn], [overall_score]) AS rec FROM b6),
b8 AS (SELECT *, CASE WHEN hn = 0 THEN 0 ELSE list_sum(list_transform(rec, lambda y, i: (i - 1 - (len(rec)-1)/2.0) * y)) / (len(rec) * (len(rec)*len(rec) - 1) / 12.0) END AS slope FROM b7),
b9 AS (SELECT *, CASE WHEN hn = 0 THEN 'new' WHEN delta >= 0.18 AND overall_score >= 0.35 THEN 'sudden' WHEN slope >= 0.04 AND overall_score >= 0.25 THEN 'gradual' ELSE 'stable' END AS trend,
  CASE WHEN overall_score >= severe THEN 'severe' WHEN overall_score >= moderate THEN 'moderate' WHEN overall_score >= low THEN 'low' ELSE 'stable' END AS plain FROM b8),
b10 AS (SELECT *, CASE WHEN severe_fraction >= 0.1 THEN 'severe' WHEN drift_fraction >= 0.3 AND plain IN ('stable','low') THEN 'moderate' ELSE plain END AS overall_severity FROM b9)"""


def judged(spark, sf_dir):
    return I.judge(batches(spark, sf_dir))


@query("i20_blended_thresholds", f"WITH {BATCH_SQL} SELECT monitor, day, round(low, 6) AS low, round(moderate, 6) AS moderate, round(severe, 6) AS severe FROM b10")
def i20(spark, sf_dir):
    return _r(judged(spark, sf_dir).select("monitor", "day", "thresholds.low", "thresholds.moderate", "thresholds.severe"))


@query("i21_severity", f"{_RISK_SQL} SELECT feature, severity, severity = 'severe' AS alert, CASE severity WHEN 'severe' THEN 3 WHEN 'moderate' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS severity_rank FROM sv")
def i21(spark, sf_dir):
    return rated(spark, sf_dir).select("feature", "severity", "alert", "severity_rank")


@query("i22_overall_score", f"{_RISK_SQL} SELECT count(*) AS feature_count, count(*) FILTER (severity <> 'stable') AS drift_count, count(*) FILTER (severity = 'severe') AS severe_count, round(count(*) FILTER (severity <> 'stable') / count(*), 6) AS drift_fraction, round(count(*) FILTER (severity = 'severe') / count(*), 6) AS severe_fraction, round(sum(risk * greatest(importance, 0.05)) / sum(greatest(importance, 0.05)), 6) AS overall_score FROM sv")
def i22(spark, sf_dir):
    return _r(I.overall(rated(spark, sf_dir)))


@query("i23_overall_severity", f"WITH {BATCH_SQL} SELECT monitor, day, overall_severity FROM b10")
def i23(spark, sf_dir):
    return judged(spark, sf_dir).select("monitor", "day", "overall_severity")


@query("i24_trend", f"WITH {BATCH_SQL} SELECT monitor, day, trend, round(delta, 6) AS delta, round(slope, 6) AS slope FROM b10")
def i24(spark, sf_dir):
    return _r(judged(spark, sf_dir).select("monitor", "day", F.col("trend.label").alias("trend"), "trend.delta", "trend.slope"))


@query("i25_alerts", f"""WITH {BATCH_SQL}, b11 AS (SELECT *, list_filter([CASE WHEN severe_fraction >= 0.1 THEN CAST(CAST(round_even(severe_fraction * 100, 0) AS INTEGER) AS VARCHAR) || '% of features are severe' END,
  CASE WHEN drift_fraction >= 0.3 THEN CAST(CAST(round_even(drift_fraction * 100, 0) AS INTEGER) AS VARCHAR) || '% of features drifted' END,
  CASE WHEN overall_severity = 'severe' THEN 'overall drift severity is severe' END, CASE WHEN trend = 'sudden' THEN 'sudden upward drift detected' END], lambda r: r IS NOT NULL) AS rs FROM b10)
SELECT monitor, day, len(rs) > 0 AS alert, CASE WHEN severe_fraction >= 0.2 OR overall_severity = 'severe' THEN 'critical' WHEN len(rs) > 0 THEN 'warning' ELSE 'info' END AS alert_level,
  CASE WHEN len(rs) > 0 THEN array_to_string(rs, '; ') ELSE 'no alert conditions met' END AS alert_reason FROM b11""")
def i25(spark, sf_dir):
    return judged(spark, sf_dir).select("monitor", "day", "alert", "alert_level", "alert_reason")


@query("i26_top_features", f"{_RISK_SQL} SELECT feature, round(risk, 6) AS risk_score FROM sv ORDER BY risk DESC, feature LIMIT 5")
def i26(spark, sf_dir):
    return _r(I.top_features(rated(spark, sf_dir), 5).select("feature", "risk_score"))


@query("i27_assessment_document")
def i27(spark, sf_dir):
    base, live = V.baseline(spark, sf_dir), V.live(spark, sf_dir)
    drop = ["flow_id", "attack_cat", "label"]
    return I.assess(I.compare_features(base.drop(*drop), live.drop(*drop)), batch_size=live.count(), timestamp="2024-01-31T00:00:00+00:00")


@query("i29_drift_report", f"""WITH {_RESULT_SQL} SELECT {_RES_COLS}, 1.0 AS importance, round(drift_score, 6) AS risk_score, CASE WHEN drift_score >= 0.6 THEN 'severe' WHEN drift_score >= 0.4 THEN 'moderate' WHEN drift_score >= 0.2 THEN 'low' ELSE 'stable' END AS severity,
  drift_score >= 0.6 AS alert, CASE WHEN drift_score >= 0.6 THEN 3 WHEN drift_score >= 0.4 THEN 2 WHEN drift_score >= 0.2 THEN 1 ELSE 0 END AS severity_rank, CASE WHEN drift_score >= 0.2 THEN 'drift' ELSE 'stable' END AS status FROM res""")
def i29(spark, sf_dir):
    drop = ["flow_id", "attack_cat", "label"]
    return _res(I.report(V.baseline(spark, sf_dir).drop(*drop), V.live(spark, sf_dir).drop(*drop)))


@query("i30_risk_ranking", f"{_RISK_SQL} SELECT feature, severity, round(risk, 6) AS risk_score, row_number() OVER (ORDER BY risk DESC, feature) AS position FROM sv ORDER BY risk DESC LIMIT 12")
def i30(spark, sf_dir):
    top = I.top_features(rated(spark, sf_dir), 12)
    return _r(top.select("feature", "severity", "risk_score", F.row_number().over(Window.orderBy(F.desc("risk_score"), "feature")).alias("position")))


@query("i30_history_trend", "WITH b AS (SELECT user_id % 5 AS monitor, CAST(ts AS DATE) AS d, round(sum(CASE WHEN event_type = 'error' THEN least(value, 60) ELSE 0 END), 2) / count(*) / 12 AS s FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY monitor ORDER BY d DESC) AS back FROM b) SELECT monitor, 21 - back AS position, round(s, 6) AS overall_score FROM r WHERE back <= 20")
def i30_trend(spark, sf_dir):
    w = Window.partitionBy("monitor").orderBy(F.desc("day"))
    r = batches(spark, sf_dir).withColumn("back", F.row_number().over(w)).where("back <= 20")
    return _r(r.select("monitor", (F.lit(21) - F.col("back")).cast("long").alias("position"), "overall_score"))
