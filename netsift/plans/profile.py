"""D: profiling of the whole flow table."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.operators import profile as D
from netsift.plans import views as V
from netsift.plans.registry import query
from netsift.session import materialize

_COLS = [c for c in V.FLOW_TYPES if c != "flow_id"]
_G = V.GAPPY_SQL
_N = V.NUMERIC
_TYPE = {c: t for c, t in V.FLOW_TYPES.items()}


def gappy(spark, sf_dir):
    return V.gappy_flows(spark, sf_dir).drop("flow_id")


def _union(template: str, cols) -> str:
    return " UNION ALL ".join(template.format(c=c, t=_TYPE[c], k="categorical" if _TYPE[c] == "string" else "numeric") for c in cols)


@query("d1_table_summary", f"WITH {_G} " + _union(
    "SELECT '{c}' AS column_name, '{t}' AS data_type, '{k}' AS kind, count(*) AS row_count, count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct FROM gappy", _COLS))
def d1(spark, sf_dir):
    return D.table_summary(gappy(spark, sf_dir)).withColumn("null_pct", F.round("null_pct", 6))


_MISS = "SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS missing_ratio FROM gappy"


@query("d2_missing_over_threshold", f"WITH {_G} SELECT column_name, round(missing_ratio, 6) AS missing_ratio FROM ({_union(_MISS, _COLS)}) WHERE missing_ratio > 0.2")
def d2(spark, sf_dir):
    return D.missing_over(gappy(spark, sf_dir)).withColumn("missing_ratio", F.round("missing_ratio", 6))


@query("d3_constant_columns", f"WITH {_G} SELECT column_name FROM (" + _union(
    "SELECT '{c}' AS column_name, count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INTEGER) AS k FROM gappy", _COLS) + ") WHERE k <= 1")
def d3(spark, sf_dir):
    return D.constant_columns(gappy(spark, sf_dir))


@query("d4_binary_columns", f"WITH {_G} SELECT column_name FROM (" + _union("SELECT '{c}' AS column_name, count(DISTINCT {c}) AS k FROM gappy", _COLS) + ") WHERE k <= 2")
def d4(spark, sf_dir):
    return D.binary_columns(gappy(spark, sf_dir))


_CATS = ["srcip", "dstip", "proto", "state", "service", "attack_cat"]


@query("d5_cardinality_split", f"WITH {_G} SELECT *, CASE WHEN distinct_values > 100 THEN 'target' ELSE 'onehot' END AS encoding FROM (" + _union(
    "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM gappy", _CATS) + ")")
def d5(spark, sf_dir):
    return D.encoding_split(gappy(spark, sf_dir), _CATS)


@query("d6_wide_range_columns", f"WITH {_G} SELECT column_name, round(value_range, 4) AS value_range FROM (" + _union(
    "SELECT '{c}' AS column_name, CAST(max({c}) - min({c}) AS DOUBLE) AS value_range FROM gappy", [c for c in _N if c != "stime"]) + ") WHERE value_range > 1000")
def d6(spark, sf_dir):
    return D.wide_range_columns(gappy(spark, sf_dir).drop("label"), 1000.0, ["stime"]).withColumn("value_range", F.round("value_range", 4))


def _pairs(cols) -> str:
    return ", ".join(f"corr({a}, {b}) AS \"{a}|{b}\"" for i, a in enumerate(cols) for b in cols[i + 1:])


def _corr_sql(cols) -> str:
    sel = " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, \"{a}|{b}\" AS c FROM pc" for i, a in enumerate(cols) for b in cols[i + 1:])
    return f"WITH {_G}, pc AS (SELECT {_pairs(cols)} FROM gappy), pl AS ({sel})"


@query("d7_high_correlation_pairs", f"{_corr_sql(_N)} SELECT feature_1, feature_2, round(abs(c), 5) AS correlation FROM pl WHERE isfinite(c) AND abs(c) > 0.5")
def d7(spark, sf_dir):
    return D.high_correlations(V.gappy_flows(spark, sf_dir), _N, 0.5).withColumn("correlation", F.round("correlation", 5))


@query("d8_correlated_columns", f"{_corr_sql(_N)} SELECT DISTINCT column_name FROM (SELECT feature_1 AS column_name FROM pl WHERE isfinite(c) AND abs(c) > 0.5 UNION ALL SELECT feature_2 FROM pl WHERE isfinite(c) AND abs(c) > 0.5)")
def d8(spark, sf_dir):
    return D.correlated_columns(D.high_correlations(V.gappy_flows(spark, sf_dir), _N, 0.5))


_MI_COLS = V.NUMERIC


def mi_sql(source: str, cols, label: str, bins: int = 16) -> str:
    """Binned mutual information as SQL; `source` is a CTE name."""
    probs = ", ".join(str(i / bins) for i in range(1, bins))
    edges = ", ".join(f"list_distinct(quantile_cont({c}, [{probs}])) AS e_{c}, quantile_cont({c}, 0.5) AS m_{c}" for c in cols)
    per = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {label} AS y, len(list_filter(e_{c}, lambda e: e <= coalesce(CAST({c} AS DOUBLE), m_{c}))) AS b FROM {source}, mi_edges" for c in cols)
    return f"""mi_edges AS (SELECT {edges} FROM {source}), mi_long AS ({per}), mi_cell AS (SELECT feature, b, y, count(*) AS n FROM mi_long GROUP BY ALL),
mi_p AS (SELECT *, n / sum(n) OVER (PARTITION BY feature) AS p, sum(n) OVER (PARTITION BY feature, b) / sum(n) OVER (PARTITION BY feature) AS pb,
  sum(n) OVER (PARTITION BY feature, y) / sum(n) OVER (PARTITION BY feature) AS pc FROM mi_cell),
mi AS (SELECT feature, greatest(sum(p * ln(p / (pb * pc))), 0) AS mi FROM mi_p GROUP BY feature)"""


def information(spark, sf_dir):
    """Scores of the gappy flows; the joined view is written once because several scans read it."""
    x = materialize(V.gappy_flows(spark, sf_dir).select("label", *_MI_COLS), "information")
    return D.mutual_information(x, _MI_COLS, "label")


@query("d9_mutual_information", f"WITH {_G}, {mi_sql('gappy', _MI_COLS, 'label')} SELECT feature, round(mi, 6) AS mi, CAST(mi < 0.0005 AS INTEGER) AS low FROM mi")
def d9(spark, sf_dir):
    mi = information(spark, sf_dir)
    return mi.select("feature", F.round("mi", 6).alias("mi"), (F.col("mi") < 0.0005).cast("int").alias("low"))


def _neighbours_sql(k: int = 3) -> str:
    """The nearest-neighbour estimate over whole rows, on hundredths, so that all distances are exact."""
    psi = lambda n: (f"CASE WHEN {n} < 16 THEN -0.5772156649015329 + coalesce(list_sum(list_transform(range(1, {n}), lambda i: 1.0::DOUBLE / i)), 0) "  # noqa: E731
                     f"ELSE ln({n}) - 0.5 / {n} - 1 / (12.0 * {n} ** 2) + 1 / (120.0 * {n} ** 4) - 1 / (252.0 * {n} ** 6) + 1 / (240.0 * {n} ** 8) END")
    away = ", ".join(f"coalesce(v - lag(v, {i}) OVER c, 'inf'::DOUBLE), coalesce(lead(v, {i}) OVER c - v, 'inf'::DOUBLE)" for i in range(1, k + 1))
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, label AS y, coalesce(CAST(floor(100 * CAST({c} AS DOUBLE) + 0.5) AS DOUBLE), (SELECT median(CAST(floor(100 * CAST({c} AS DOUBLE) + 0.5) AS DOUBLE)) FROM gappy)) AS v FROM gappy" for c in _MI_COLS)
    return f"""long AS ({long}), sized AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS ny FROM long),
near AS (SELECT feature, v, ny, least({k}, ny - 1) AS k, list_sort([{away}]) AS d FROM sized WHERE ny > 1 WINDOW c AS (PARTITION BY feature, y ORDER BY v)),
radius AS (SELECT feature, v, ny, k, greatest(d[k] - 0.25, 0) AS r FROM near),
counted AS (SELECT feature, ny, k, count(*) OVER (PARTITION BY feature) AS n, count(*) OVER (PARTITION BY feature ORDER BY v RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS m FROM radius)
SELECT feature, round(greatest({psi('max(n)')} + avg({psi('k')}) - avg({psi('ny')}) - avg({psi('m')}), 0), 6) AS mi FROM counted GROUP BY feature"""


@query("d9_neighbour_information", f"WITH {_G}, {_neighbours_sql()}")
def d9_neighbours(spark, sf_dir):
    hundredths = [F.floor(100 * F.col(c).cast("double") + 0.5).cast("double").alias(c) for c in _MI_COLS]
    x = materialize(V.gappy_flows(spark, sf_dir).select("label", *hundredths), "information")
    return D.mutual_information(x, _MI_COLS, "label", neighbours=3).select("feature", F.round("mi", 6).alias("mi"))


@query("d10_seeded_sample", f"WITH {V.FLOWS_SQL} SELECT flow_id, sbytes FROM flows ORDER BY md5(flow_id || '|42') LIMIT 2000")
def d10(spark, sf_dir):
    return D.seeded_sample(V.flows(spark, sf_dir).select("flow_id", "sbytes"), ["flow_id"], 2000)


@query("d11_class_distribution", f"WITH {V.FLOWS_SQL} SELECT attack_cat, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM flows GROUP BY attack_cat")
def d11(spark, sf_dir):
    return D.class_distribution(V.flows(spark, sf_dir), "attack_cat").withColumn("pct", F.round("pct", 6))


@query("d12_profile_report")
def d12(spark, sf_dir):
    from netsift.plans.cleaning import clean_flows

    f = clean_flows(spark, sf_dir).drop("cat").withColumn("spkts", F.col("spkts").cast("string"))
    return D.profile_report(materialize(f, "profile-flows"), key=["flow_id"], mi_threshold=0.0005)


@query("d13_top_missing", f"WITH {_G} SELECT column_name, round(missing_ratio, 6) AS missing_ratio FROM ({_union(_MISS, _COLS)}) ORDER BY missing_ratio DESC, column_name LIMIT 30")
def d13(spark, sf_dir):
    return D.top_missing(gappy(spark, sf_dir)).withColumn("missing_ratio", F.round("missing_ratio", 6))


_TOPVAR = _N


@query("d14_correlation_matrix", f"WITH {_G}, pc AS (SELECT " + ", ".join(f'corr({a}, {b}) AS "{a}|{b}"' for a in _TOPVAR for b in _TOPVAR)
       + " FROM gappy) SELECT feature_1, feature_2, CASE WHEN isfinite(c) THEN round(c, 5) END AS correlation FROM ("
       + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, \"{a}|{b}\" AS c FROM pc" for a in _TOPVAR for b in _TOPVAR) + ")")
def d14(spark, sf_dir):
    return D.correlation_matrix(materialize(V.gappy_flows(spark, sf_dir).select(*_N), "correlation-flows"), _N).withColumn("correlation", F.round("correlation", 5))


@query("d15_top_information", f"WITH {_G}, {mi_sql('gappy', _MI_COLS, 'label')} SELECT feature, round(mi, 6) AS mi FROM mi ORDER BY mi DESC, feature LIMIT 30")
def d15(spark, sf_dir):
    return D.top_information(information(spark, sf_dir)).withColumn("mi", F.round("mi", 6))


@query("d15_class_counts", f"WITH {V.FLOWS_SQL} SELECT label, count(*) AS n FROM flows GROUP BY label ORDER BY label")
def d15_counts(spark, sf_dir):
    return D.class_counts(V.flows(spark, sf_dir), "label")


_HIST = ["sbytes", "dbytes", "dload", "sload", "sttl", "spkts", "dpkts", "smeansz"]


@query("d16_histograms", f"WITH {_G}, b AS (SELECT " + ", ".join(f"CAST(min({c}) AS DOUBLE) AS {c}_lo, CAST(max({c}) AS DOUBLE) AS {c}_hi" for c in _HIST) + " FROM gappy), h AS ("
       + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(least(floor((CAST({c} AS DOUBLE) - {c}_lo) * 50.0 / ({c}_hi - {c}_lo)), 49) AS INTEGER) AS bin FROM gappy, b" for c in _HIST)
       + "), g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(i AS INTEGER) AS bin, round({c}_lo + i * (({c}_hi - {c}_lo) / 50), 3) AS left_edge FROM b, range(50) t(i)" for c in _HIST)
       + ") SELECT g.feature, g.bin, left_edge, coalesce(n, 0) AS n FROM g LEFT JOIN (SELECT feature, bin, count(*) AS n FROM h GROUP BY ALL) k ON g.feature = k.feature AND g.bin = k.bin")
def d16(spark, sf_dir):
    h = D.histograms(V.gappy_flows(spark, sf_dir), _HIST)
    return h.select("feature", "bin", F.round("left_edge", 3).alias("left_edge"), "n")
