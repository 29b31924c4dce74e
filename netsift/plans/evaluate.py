"""H: evaluation of predictions for the whole line-item table."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.functions.cleaning import quality_tag
from netsift.operators import evaluate as H
from netsift.plans import views as V
from netsift.plans.registry import query

_P = V.PREDS_SQL


def _cls(yhat: str = "yhat", by: str = "", source: str = "preds") -> str:
    b = f"{by}, " if by else ""
    using = f"USING ({by}, class)" if by else "USING (class)"
    return f"""cls AS (SELECT {b}class, CASE WHEN pred = 0 THEN 0 ELSE hit / pred END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall, support, hit FROM (
  SELECT {b}class, coalesce(support, 0) AS support, coalesce(pred, 0) AS pred, coalesce(hit, 0) AS hit FROM
    (SELECT {b}y AS class, count(*) AS support, count(*) FILTER (y = {yhat}) AS hit FROM {source} GROUP BY ALL) FULL JOIN (SELECT {b}{yhat} AS class, count(*) AS pred FROM {source} GROUP BY ALL) {using})),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM cls)"""


def _avg(by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""SELECT {b}round(sum(hit) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
  round(sum(precision * support) / sum(support), 6) AS precision_weighted, round(sum(recall * support) / sum(support), 6) AS recall_weighted, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM f"""


def _r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("h1_confusion_matrix", f"""WITH {_P} SELECT a.y, b.yhat, count(p.y) AS n FROM range(5) a(y) CROSS JOIN range(5) b(yhat) LEFT JOIN preds p ON p.y = a.y AND p.yhat = b.yhat GROUP BY 1, 2""")
def h1(spark, sf_dir):
    return H.confusion_matrix(V.predictions(spark, sf_dir), list(range(5)))


@query("h1_confusion_wide", f"""WITH {_P} SELECT y, """ + ", ".join(f'count(*) FILTER (yhat = {i}) AS "{i}"' for i in range(5)) + " FROM preds GROUP BY y")
def h1_wide(spark, sf_dir):
    return H.wide_confusion(V.predictions(spark, sf_dir), list(range(5)))


@query("h2_accuracy", f"WITH {_P} SELECT round(avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds")
def h2(spark, sf_dir):
    return _r6(H.accuracy(V.predictions(spark, sf_dir)))


@query("h3_per_class", f"WITH {_P}, {_cls()} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def h3(spark, sf_dir):
    return _r6(H.per_class(V.predictions(spark, sf_dir)).drop("hit"))


@query("h4_averages", f"WITH {_P}, {_cls()} {_avg()}")
def h4(spark, sf_dir):
    return _r6(H.averages(V.predictions(spark, sf_dir)))


_AUC = f"""WITH {_P}, sc AS (""" + " UNION ALL ".join(f"SELECT {i} AS class, s{i} AS score, y = {i} AS pos FROM preds" for i in range(5)) + """),
rk AS (SELECT class, pos, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS r FROM sc),
auc AS (SELECT class, (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (CAST(count(*) FILTER (pos) AS DOUBLE) * count(*) FILTER (NOT pos)) AS auc FROM rk GROUP BY class)"""
_SCORES = {i: f"s{i}" for i in range(5)}


@query("h5_roc_auc", f"{_AUC} SELECT round(avg(auc), 6) AS roc_auc FROM auc")
def h5(spark, sf_dir):
    return _r6(H.roc_auc(V.predictions(spark, sf_dir), _SCORES))


@query("h5_roc_auc_per_class", f"{_AUC} SELECT class, round(auc, 6) AS auc FROM auc")
def h5_classes(spark, sf_dir):
    return _r6(H.roc_auc_per_class(V.predictions(spark, sf_dir), _SCORES))


@query("h6_normalised_confusion", f"""WITH {_P}, g AS (SELECT a.y, b.yhat, count(p.y) AS n FROM range(5) a(y) CROSS JOIN range(5) b(yhat) LEFT JOIN preds p ON p.y = a.y AND p.yhat = b.yhat GROUP BY 1, 2)
SELECT y, yhat, n, round(n / sum(n) OVER (PARTITION BY y), 6) AS share FROM g""")
def h6(spark, sf_dir):
    return _r6(H.confusion_matrix(V.predictions(spark, sf_dir), list(range(5)), normalise=True))


@query("h7_tagged_f1", f"WITH {_P}, {_cls('yhat2')} SELECT class, round(f1, 6) AS f1, support, CASE WHEN f1 >= 0.85 THEN 'GOOD' WHEN f1 >= 0.7 THEN 'OK' WHEN f1 >= 0.5 THEN 'WEAK' ELSE 'POOR' END AS quality FROM f")
def h7(spark, sf_dir):
    return _r6(H.tagged_f1(V.predictions(spark, sf_dir), yhat="yhat2"))


@query("h8_top_errors", f"WITH {_P} SELECT y, yhat, count(*) AS n FROM preds WHERE y <> yhat GROUP BY 1, 2 ORDER BY n DESC, y, yhat LIMIT 5")
def h8(spark, sf_dir):
    return H.top_errors(V.predictions(spark, sf_dir))


_MODELS = f"WITH {_P}, mp AS (SELECT 'forest' AS model, y, yhat FROM preds UNION ALL SELECT 'boosted', y, yhat2 FROM preds), {_cls('yhat', 'model', 'mp')}, a AS ({_avg('model')} GROUP BY model)"


@query("h9_model_comparison", f"{_MODELS} SELECT model, accuracy, f1_macro, f1_weighted, precision_macro, recall_macro FROM a")
def h9(spark, sf_dir):
    return _r6(H.compare_models(V.predictions(spark, sf_dir), "y", {"forest": "yhat", "boosted": "yhat2"}))


@query("h9_comparison_long", f"{_MODELS} " + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS value FROM a" for m in ("accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro")))
def h9_long(spark, sf_dir):
    return _r6(H.comparison_long(H.compare_models(V.predictions(spark, sf_dir), "y", {"forest": "yhat", "boosted": "yhat2"})))


@query("h10_split_evaluation", f"WITH {_P}, {_cls('yhat', 'split')}, a AS ({_avg('split')} GROUP BY split) SELECT f.split, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, accuracy FROM f JOIN a ON f.split = a.split")
def h10(spark, sf_dir):
    p = V.predictions(spark, sf_dir)
    return _r6(H.per_class(p, by=["split"]).drop("hit").join(H.averages(p, by=["split"]).select("split", "accuracy"), "split"))


@query("h10_split_confusion", f"WITH {_P} SELECT split, y, yhat, count(*) AS n FROM preds GROUP BY ALL")
def h10_cells(spark, sf_dir):
    return H.cell_counts(V.predictions(spark, sf_dir), by=["split"])


@query("a10_metrics_document", f"WITH {_P}, {_cls()} SELECT ['DoS','Exploits','Backdoor','Normal','Fuzzers'][class + 1] AS class, round(f1, 6) AS f1, support, CASE WHEN f1 >= 0.85 THEN 'GOOD' WHEN f1 >= 0.7 THEN 'OK' WHEN f1 >= 0.5 THEN 'WEAK' ELSE 'POOR' END AS quality, (SELECT round(avg(f1), 6) FROM f) AS f1_macro FROM f")
def a10(spark, sf_dir):
    from netsift.session import scratch_path
    from netsift.sources import reports

    path = scratch_path(spark, "metrics")
    doc = H.metrics_document(V.predictions(spark, sf_dir), "forest", V.CLASS_NAMES)
    reports.write_document(doc, path)
    back = reports.read_document(spark, path, doc.schema)
    rows = back.select(F.explode("per_class_metrics").alias("e"), F.col("overall_metrics.f1_macro").alias("f1_macro"))
    return _r6(rows.select("e.class", F.col("e.f1_score").alias("f1"), "e.support", quality_tag("e.f1_score").alias("quality"), "f1_macro"))
