"""Invariants of preparation, over-sampling, classifiers and sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsift.operators import models as G
from netsift.operators import neighbours as N
from netsift.operators import sampling as E
from netsift.plans import views as V
from netsift.plans.prepare import config, training_flows
from netsift.prepare import FlowPreparation, FlowPreparationModel, NumericScalerModel
from netsift.session import scratch_path
from netsift.sources import flows as A


@pytest.fixture(scope="module")
def train(spark, sf):
    from netsift.session import materialize

    return materialize(training_flows(spark, sf), "test-train")


@pytest.fixture(scope="module")
def prepared(train):
    model = FlowPreparation(config()).fit(train)
    return model, model.transform(train)


def test_preparation_invariants(spark, train, prepared):
    model, out = prepared
    feats = model.featureNames()
    assert out.columns == [*[c for c in out.columns if c in ("flow_id", "target")], *feats] or set(out.columns) == {"flow_id", "target", *feats}
    assert "target" not in feats and "srcip" not in feats
    nulls = out.select(*[F.count_if(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`"))).alias(c) for c in feats]).first()
    assert sum(nulls) == 0 and all(t == "double" for c, t in out.dtypes if c in feats)
    again = FlowPreparation(config()).fit(train)
    assert again.featureNames() == feats
    total = lambda d: d.agg(*[F.round(F.sum(f"`{c}`"), 6) for c in feats]).first()
    assert total(again.transform(train)) == pytest.approx(total(out))


def test_preparation_round_trip(spark, train, prepared):
    model, out = prepared
    path = scratch_path(spark, "prep-test")
    model.save(spark, path)
    loaded = FlowPreparationModel.load(spark, path)
    feats = model.featureNames()
    total = lambda d: d.agg(*[F.round(F.sum(f"`{c}`"), 6) for c in feats]).first()
    assert total(loaded.transform(train)) == pytest.approx(total(out))


def test_use_before_fit():
    with pytest.raises(RuntimeError):
        NumericScalerModel().fitted
    with pytest.raises(RuntimeError):
        G.FlowClassifier().predict(None)


def test_classifiers(spark, train, prepared):
    model, out = prepared
    for clf in (G.train_forest(out, model.featureNames(), classes=["a", "b", "c", "d", "e"], trees=3, depth=3),
                G.train_boosted(out, model.featureNames(), classes=["a", "b", "c", "d", "e"], rounds=1, depth=2)):
        p = clf.predict(out)
        row = p.agg(F.min("prediction_code"), F.max("prediction_code"), F.min(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b)),
                    F.max(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b))).first()
        assert 0 <= row[0] and row[1] < 5 and row[2] == pytest.approx(1) and row[3] == pytest.approx(1)
        assert len(clf.importances()) == len(model.featureNames())
        scored = G.score_flows(train.drop("target"), model, clf)
        assert scored.count() == train.count() and {r["prediction"] for r in G.score_counts(scored).collect()} <= set("abcde")


def points(spark, n=240, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(f"{i:05d}", "abc"[0 if i < 150 else 1 if i < 210 else 2], [float(v) for v in rng.normal(size=4) + (0 if i < 150 else 0.7)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, cls string, vec array<double>")


@pytest.mark.parametrize("block", [7, 1000])
def test_nearest_is_exact(spark, block):
    rows, df = points(spark)
    p = df.select("id", F.lit("all").alias("scope"), "cls", "vec", F.lit(True).alias("q"), F.lit(True).alias("s"))
    got = {}
    for r in N.nearest(p, 4, pivots=6, block_rows=block).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    x = np.array([r[2] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i, r in enumerate(rows):
        want = [rows[j][0] for j in np.lexsort((np.arange(len(rows)), d[i]))[:4]]
        assert [got[r[0]][k] for k in (1, 2, 3, 4)] == want


def test_smote_rows_lie_on_segments(spark):
    rows, df = points(spark)
    by = {r[0]: r for r in rows}
    out = N.smote(df, 5, pivots=4).collect()
    assert sum(r["cls"] == "b" for r in out) == 90 and sum(r["cls"] == "c" for r in out) == 120
    for r in out:
        a, b = by[r["seed_id"]], by[r["neighbour"]]
        assert a[1] == b[1] == r["cls"] and 0 <= r["gap"] < 1
        assert np.allclose(np.array(a[2]) + r["gap"] * (np.array(b[2]) - np.array(a[2])), r["vec"])


def test_split_is_a_partition(spark, sf):
    t = V.flows(spark, sf).select("flow_id", "state")
    s = E.stratified_split(t, "state", ["flow_id"])
    n = t.count()
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts["test"] == -(-n * 2 // 10) and counts["train"] + counts["test"] == n


def test_undersample_and_oversample_sizes(spark, prepared):
    model, out = prepared
    small = out.where("target in (0, 1)").select("flow_id", "target", *[f"`{c}`" for c in model.featureNames()[:4]])
    sizes = lambda d: {r["target"]: r["count"] for r in d.groupBy("target").count().collect()}
    before = sizes(small)
    assert set(sizes(E.undersample(small, "target", ["flow_id"])).values()) == {min(before.values())}
    assert set(sizes(N.oversample_table(small, model.featureNames()[:4], "target", ["flow_id"], pivots=4)).values()) == {max(before.values())}


def test_catalog_and_missing_files(spark, tmp_path):
    (tmp_path / "cat.csv").write_bytes("No.,Name,Type,Description\n1, proto ,x,caf\xe9\n2,ct src,x,y\n3,Label,x,z\n".encode("latin-1"))
    schema = A.catalog_schema(A.read_catalog(spark, str(tmp_path / "cat.csv")))
    assert [(f.name, f.dataType.simpleString()) for f in schema] == [("proto", "string"), ("ct_src", "double"), ("Label", "int")]
    (tmp_path / "p1.csv").write_text("tcp,1.5,1\nudp,x,0\ntcp,2,1,9,9\nudp,3\n")
    with pytest.warns(UserWarning):
        df = A.read_flow_csv(spark, [str(tmp_path / "p1.csv"), str(tmp_path / "none.csv")], schema)
    assert [tuple(r) for r in df.orderBy("proto", "ct_src").collect()] == [("tcp", 1.5, 1), ("udp", None, 0), ("udp", 3.0, None)]
    assert A.read_flow_csv(spark, [str(tmp_path / "p1.csv")], schema, max_rows=1).count() == 1
    bad = A.rejected_lines(spark, [str(tmp_path / "p1.csv"), str(tmp_path / "none.csv")], schema).collect()
    assert [(r["line"], r["fields"]) for r in bad] == [("tcp,2,1,9,9", 5)]
    with pytest.warns(UserWarning, match="1 lines have more than 3 fields"):
        A.read_flow_csv(spark, [str(tmp_path / "p1.csv")], schema, report=True)
    with pytest.raises(FileNotFoundError):
        A.read_flow_csv(spark, [str(tmp_path / "none.csv")], schema)


def test_packets_with_null_keys_and_sampling_cuts(spark):
    from netsift.functions.scaling import hash_first
    from netsift.operators.packets import connection_counts

    flows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, None), (4, "b", "x")], "n int, src string, dst string")
    got = connection_counts(flows, {"c_src": ["src"], "c_both": ["src", "dst"]}).orderBy("n").collect()
    assert [(r["c_src"], r["c_both"]) for r in got] == [(2, 2), (2, 2), (1, 1), (1, 1)]
    rows = spark.range(5000).selectExpr("id", "md5(string(id)) as h", "if(id % 10 = 0, 'rare', 'much') as c")
    want = F.when(F.col("c") == "much", 700)
    kept = hash_first(rows, "h", want, ["c"]).toPandas()
    whole = rows.toPandas()
    expect = set(whole[whole["c"] == "rare"]["id"]) | set(whole[whole["c"] == "much"].sort_values("h").head(700)["id"])
    assert set(kept["id"]) == expect and len(kept) == len(expect)
    assert hash_first(rows, "h", F.lit(0), ["c"]).count() == 0
