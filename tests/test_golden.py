"""Hand-checked values and small brute-force comparisons."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netsift import schema as S
from netsift.functions import scaling as X
from netsift.functions.stats import chi2_tail
from netsift.operators import alerts as A
from netsift.operators import drift as I
from netsift.operators import evaluate as H
from netsift.operators import folds as J
from netsift.operators import requests as R
from netsift.prepare import CategoricalEncoder, NumericScaler, PreparationConfig, TargetEncoder, compare_strategies


def drift_frame(n, service, sbytes, ttl):
    i = np.arange(n)
    cols = {c: np.zeros(n) for c in S.FLOW_COLUMNS}
    cols.update({c: np.ones(n) for c in S.FLOW_COLUMNS if c.startswith("ct_") and c not in ("ct_flw_http_mthd", "ct_ftp_cmd")})
    cols.update(srcip=["10.0.0.1"] * n, dstip=["10.0.0.2"] * n, sport=40000 + i, dsport=[80] * n, proto=["tcp"] * n, state=["EST"] * n, dur=1 + 0.1 * (i % 5),
                sbytes=sbytes + i, dbytes=200 + i, sttl=[ttl] * n, dttl=[64] * n, service=[service] * n, sload=10.0 + i, dload=20.0 + i, spkts=5 + i % 3,
                dpkts=5 + i % 2, stcpb=1000 + i, dtcpb=2000 + i, smeansz=50 + 0.1 * i, dmeansz=60 + 0.1 * i, sjit=0.1 + 0.01 * i, djit=0.2 + 0.01 * i,
                stime=1000.0 + i, ltime=1001.0 + i, sintpkt=0.05 + 0.001 * i, dintpkt=0.06 + 0.001 * i)
    return pd.DataFrame(cols)[S.FLOW_COLUMNS]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(drift_frame(50, "http", 100, 64)), spark.createDataFrame(drift_frame(50, "ssh", 500, 32))


def test_numeric_drift(spark, frames):
    v = I.value_table(*frames, ["sbytes", "sttl"])
    assert np.allclose(I.bin_edges(v)["sbytes"], [100, 249.6666667, 399.3333333, 549])
    r = {x["feature"]: x for x in I.numeric_results(*frames, ["sbytes", "sttl"]).collect()}
    assert r["sbytes"]["ks_stat"] == 1 and r["sbytes"]["js_divergence"] == pytest.approx(1) and r["sbytes"]["psi"] == pytest.approx(27.6310231)
    assert r["sbytes"]["drift_score"] == pytest.approx(1) and r["sttl"]["drift_score"] == pytest.approx(0.35)


def test_categorical_drift(frames):
    r = I.categorical_results(*frames, ["service"]).first()
    assert r["unseen_rate"] == 1 and r["chi2_stat"] == pytest.approx(100) and r["js_divergence"] == pytest.approx(1) and r["drift_score"] == pytest.approx(1)


def test_assessment(frames):
    doc = I.assess(I.compare_features(*frames), batch_size=50).first()
    assert (doc["feature_count"], doc["drift_count"], doc["severe_count"]) == (47, 3, 2)
    assert doc["overall_score"] == pytest.approx(2.35 / 47) and doc["overall_severity"] == "stable" and not doc["alert"] and doc["trend"] == "new"
    assert doc["top_features"][0]["feature"] in {"sbytes", "service"}
    assert doc["dashboard"]["counts"]["drifted"] == 3


def test_identical_sides_do_not_drift(frames):
    assert all(r["drift_score"] == pytest.approx(0, abs=1e-9) for r in I.compare_features(frames[0], frames[0]).collect())


def test_thresholds_and_trend(spark):
    past = [0.3542570539777337, 0.1880531774206009, 0.23919480123659254]
    row = spark.range(1).select(I.thresholds(F.array(*[F.lit(p) for p in past])).alias("t"),
                                I.trend(F.array(*[F.lit(p) for p in past]), F.lit(0.22682871038892774)).alias("d")).first()
    assert list(row["t"]) == pytest.approx([0.20933108776772313, 0.3879607567233087, 0.561412624305543])
    assert row["d"]["label"] == "stable" and row["d"]["delta"] == pytest.approx(-0.012366090847664796) and row["d"]["slope"] == pytest.approx(-0.03311434069504266)


def test_chi_square_tail():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert chi2_tail(14.067140449340169, 7) == pytest.approx(0.05)
    assert chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)


def test_target_encoding(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("a", 1), ("c", 0), ("b", 0), ("a", 1)], "c string, y int")
    m = TargetEncoder("c", "y").fit(df)
    got = {r[0]: r[1] for r in spark.createDataFrame([(x, x) for x in "abcz"], "k string, c string").transform(m.transform).collect()}
    assert got == pytest.approx({"a": 0.875, "b": 0.1666667, "c": 0.25, "z": 0.5})


def test_label_codes_and_onehot_bound(spark):
    from netsift.prepare import encoding

    df = spark.range(60).select(F.concat(F.lit("k"), F.col("id") % 20).alias("c"), (F.col("id") % 3).alias("y"))
    codes = encoding.label_codes(df, "c").orderBy("category").collect()
    assert [r["value"] for r in codes] == list(range(20))
    assert len(CategoricalEncoder("onehot", ["c"]).fit(df).transform(df).columns) == 20
    with pytest.raises(ValueError):
        CategoricalEncoder("onehot", ["c"], max_onehot=19).fit(df)


def test_null_is_a_category_of_the_categorical_encoder(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), (None, 4.0), (None, 4.0)], "c string, y double")
    got = {r["y"]: r["c"] for r in CategoricalEncoder("target", ["c"], "y").fit(df).transform(df).collect()}
    assert got == pytest.approx({0.0: (2 * 0 + 2) / 3, 4.0: (2 * 4 + 2) / 3})


def test_encoder_rules(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 0.0)], "c string, n double")
    with pytest.raises(ValueError):
        CategoricalEncoder("target", ["c"]).fit(df)
    assert CategoricalEncoder("onehot", ["c"]).fit(df).transform(df).columns == ["n", "c_y"]


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 6.0), (3.0, 7.0)], "a double, b double")
    m = NumericScaler("standard", skip=["b"]).fit(df)
    assert [tuple(r) for r in m.transform(df).collect()] == [pytest.approx((-1.2247449, 5)), pytest.approx((0, 6)), pytest.approx((1.2247449, 7))]
    assert [r["a"] for r in m.inverse_transform(m.transform(df)).collect()] == pytest.approx([1, 2, 3])
    for strategy in ("minmax", "robust", "power", "quantile"):
        s = NumericScaler(strategy, ["a"]).fit(df)
        assert [r["a"] for r in s.inverse_transform(s.transform(df)).collect()] == pytest.approx([1, 2, 3], abs=1e-6)
    assert X.quantiles(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "v double"), ["v"], [0.01, 0.25, 0.5, 0.75, 0.99])["v"] == pytest.approx([1.04, 2, 3, 4, 9.76])


def test_power_scaling_finds_the_likeliest_exponent(spark):
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(size=400))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = NumericScaler("power", ["x"]).fit(df).fitted["params"]["x"]["lambda"]

    def loglik(q):
        y = np.log1p(x) if abs(q) < 1e-12 else ((x + 1) ** q - 1) / q
        return -len(x) / 2 * np.log(y.var()) + (q - 1) * np.log1p(x).sum()

    assert all(loglik(lam) >= loglik(lam + d) - 1e-6 for d in (-0.05, -0.01, 0.01, 0.05))
    table = {r["strategy"]: r for r in compare_strategies(df, "x").collect()}
    assert abs(table["PowerTransformer"]["skewness"]) < abs(table["Original"]["skewness"]) and table["PowerTransformer"]["std"] == pytest.approx(1, abs=1e-3)


def test_quantiles_by_counting_agree(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"a": np.round(rng.gamma(2.0, 50.0, 3000), 2), "b": rng.integers(0, 4, 3000).astype(float), "c": 7.0, "d": np.exp(rng.normal(size=3000) * 8)})
    p.loc[::9, "a"] = np.nan
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None), "a double, b double, c double, d double").withColumn("e", F.lit(None).cast("double"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.51, 0.99, 1.0]
    got = X.quantiles(df, ["a", "b", "c", "d", "e"], probs)
    for c in "abcd":
        assert got[c] == pytest.approx(list(np.quantile(p[c].dropna(), probs)))
    assert got["e"] == [None] * len(probs)


def test_quantiles_with_infinities_and_nan(spark):
    inf = float("inf")
    values = [float(i) for i in range(3000)] + [inf] * 1000 + [-inf] * 400 + [float("nan")] * 77 + [1.7e308, -1.7e308]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "a double")
    clean = sorted(v for v in values if v == v)
    got = X.quantiles(df, ["a"], [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])["a"]
    for p, g in zip([0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0], got):
        at = p * (len(clean) - 1)
        lo, hi = clean[math.floor(at)], clean[math.ceil(at)]
        assert g == (lo if lo == hi else pytest.approx(lo + (at - math.floor(at)) * (hi - lo)))
    assert X.quantiles(df.limit(0), ["a"], [0.5])["a"] == [None]
    one = X.quantiles(spark.createDataFrame([(-0.0,)], "a double"), ["a"], [0.0, 1.0])["a"]
    assert one == [0.0, 0.0]


def test_trailing_count_of_one_client_and_null_keys(spark):
    df = spark.range(40_000).selectExpr("if(id % 2 = 0, 'hot', null) as k", "id * 10 as t", "id % 3 = 0 as ok")
    got = X.trailing_count(df, ["k"], "t", 1000, F.col("ok")).toPandas()
    assert len(got) == 40_000
    for _, r in got.iloc[::997].iterrows():
        i = r["t"] // 10
        assert r["trailing"] == sum(1 for j in range(max(0, i - 99), i + 1) if (j - i) % 2 == 0 and j % 3 == 0)


def test_rate_limit_and_health_keep_null_keys(spark):
    from netsift.operators.folds import rate_limit, service_health

    rows = [(i, k, i * 1_000_000) for i in range(6) for k in ("a", None)]
    df = spark.createDataFrame(rows, "n long, client string, ts long")
    got = rate_limit(df, "client", "ts", ["n"], limit=2, window_us=60_000_000).where("allowed").groupBy("client").count().collect()
    assert {r["client"]: r["count"] for r in got} == {"a": 2, None: 2}
    calls = spark.createDataFrame([(i, k, i * 1000, i % 2 == 0) for i in range(6) for k in (1, None)], "n long, service int, ts long, ok boolean")
    health = service_health(calls, "service", "ts", ["n"], "ok", threshold=3).orderBy("n").collect()
    assert len(health) == 12
    assert [r["state_after"] for r in health if r["service"] is None] == [r["state_after"] for r in health if r["service"] == 1]


def test_scratch_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from netsift.session import scratch_root

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        scratch_root(session)


def test_correlation_with_gaps(spark):
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"a": rng.normal(size=300)})
    p["b"] = p["a"] * 2 + rng.normal(size=300) + 1e6
    p["c"] = 7.0
    p.loc[::7, "b"] = np.nan
    got = {(r["feature_1"], r["feature_2"]): r["correlation"] for r in X.correlations(spark.createDataFrame(p.replace({np.nan: None})), ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(p["a"].corr(p["b"])) and got[("a", "c")] is None and got[("b", "b")] == pytest.approx(1)


def test_averages_from_report(spark):
    rows = [(0, 0)] * 8 + [(0, 1)] * 2 + [(1, 1)] * 5 + [(1, 0)] * 5
    r = H.averages(spark.createDataFrame(rows, "y int, yhat int")).first()
    assert r["accuracy"] == pytest.approx(0.65) and r["recall_macro"] == pytest.approx(0.65) and r["precision_macro"] == pytest.approx((8 / 13 + 5 / 7) / 2)


def requests_frame(spark, rows):
    return spark.createDataFrame([(i, c, int(round(t * 1e6))) for i, (c, t) in enumerate(rows)], "n long, client string, ts long")


def test_rate_limit_golden(spark):
    df = requests_frame(spark, [("a", 0), ("a", 0.01), ("a", 0.02), ("a", 0.17), ("b", 0), ("b", 0.01)])
    d = J.rate_limit(df, "client", "ts", ["n"], 2, 100_000)
    assert [r["allowed"] for r in d.orderBy("n").collect()] == [True, True, False, True, True, True]
    assert J.denied_total(d).first()[0] == 1


def brute_limit(times, limit, window):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if k > t - window]
        ok = len(kept) < limit
        out.append(ok)
        if ok:
            kept.append(t)
    return out


@pytest.mark.parametrize("limit,window", [(1, 30), (3, 50), (10, 200)])
def test_rate_limit_is_the_sequential_rule(spark, limit, window):
    rng = np.random.default_rng(limit)
    bursts = np.concatenate([rng.integers(0, 6000, 150), rng.integers(2000, 2600, 250), rng.integers(5200, 5210, 30)])
    times = sorted(int(t) for t in bursts)
    df = spark.createDataFrame([(i, "hot", t) for i, t in enumerate(times)], "n long, client string, ts long")
    got = [r["allowed"] for r in J.rate_limit(df, "client", "ts", ["n"], limit, window, chunk_us=window).orderBy("n").collect()]
    assert got == brute_limit(times, limit, window)


def test_breaker_golden():
    rule = J.Breaker(2, 100, 2)
    state = rule.start()
    for t, ok in ((0, False), (1, False)):
        state, _ = rule.step(state, t, ok)
    assert state[0] == "open" and rule.check(state, 151)[0] == "half_open"
    closed, _ = rule.step(state, 151, True)
    closed, _ = rule.step(closed, 152, True)
    assert closed[0] == "closed" and rule.step(state, 151, False)[0][0] == "open"
    rule = J.Breaker(3, 100, 3)
    state = rule.start()
    for t, ok in enumerate((False, False, True, False, False)):
        state, _ = rule.step(state, t, ok)
    assert state[0] == "open"


def test_breaker_pieces_equal_one_pass(spark):
    rng = np.random.default_rng(9)
    rows, t = [], 0
    for i in range(900):
        t += int(rng.integers(1, 30))
        rows.append((i, "s", t, bool(rng.random() > (0.6 if (t // 1500) % 3 == 0 else 0.02))))
    rule, state, want = J.Breaker(3, 200, 3), J.Breaker(3, 200, 3).start(), []
    for _, _, at, ok in rows:
        state, (seen, executed) = rule.step(state, at, ok)
        want.append((seen, executed, state[0]))
    df = spark.createDataFrame(rows, "n long, service string, ts long, ok boolean")
    got = J.service_health(df, "service", "ts", ["n"], "ok", 3, 200, 3, chunk_us=400)
    assert [(r["state"], r["executed"], r["state_after"]) for r in got.orderBy("n").collect()] == want


def test_cooldown_golden(spark):
    df = requests_frame(spark, [("x", 0), ("x", 10), ("x", 29.9), ("x", 30), ("x", 45), ("x", 60)])
    assert [r["fired"] for r in J.cooldown(df, "client", "ts", ["n"], 30).orderBy("n").collect()] == [True, False, False, True, False, True]


def test_metrics_and_percentiles(spark):
    df = spark.createDataFrame([(i, i * 1_000_000, float(v), i != 1) for i, v in enumerate((10, 20, 30))], "n int, ts_us long, latency_ms double, ok boolean")
    m = R.metrics(df, 10_000_000, success=F.col("ok")).first()
    assert (m["avg_latency_ms"], m["successful_requests"], m["failed_requests"]) == (20, 2, 1)
    hundred = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    assert tuple(R.percentile_by_index(hundred, "v", [95, 99]).first()) == (96, 100)
    assert tuple(R.percentile_by_index(hundred, "v", [95, 99], nearest_rank=True).first()) == (95, 99)


def test_watch_list(spark):
    df = spark.createDataFrame([("a.vulnweb.com",), ("nmap.org.",), ("xnmap.org",), ("TESTPHP.vulnweb.com",)], "q string")
    assert [r[0] for r in df.select(A.match_scenario("q")).collect()] == ["exploits", "recon", None, "exploits"]


def test_feed_stats(spark):
    empty = A.feed_stats(spark.createDataFrame([], "prediction string")).first()
    assert (empty["total_flows"], empty["attack_rate_pct"]) == (1, 0)
    four = A.feed_stats(spark.createDataFrame([("Normal",)] * 3 + [("DoS",)], "prediction string")).first()
    assert (four["total_flows"], four["attack_flows"], four["attack_rate_pct"]) == (4, 1, 25.0)
    assert four["class_counts"] == {"Normal": 3, "DoS": 1}


def test_configuration_is_checked():
    for bad in ({"correlation_threshold": 0}, {"lower_percentile": 99.0, "upper_percentile": 1.0}, {"scaling_strategy": "x"}):
        with pytest.raises(ValueError):
            PreparationConfig(**bad)


def test_running_helpers_on_a_hot_key(spark):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"k": ["hot"] * 400 + ["b"] * 20, "t": rng.permutation(420), "v": rng.integers(0, 5, 420)})
    p["seg"] = p["t"] // 25
    df = spark.createDataFrame(p)
    o = p.sort_values(["k", "t"])
    got = X.running_sums(df, ["k"], "seg", ["t"], {"c": "v"}).orderBy("k", "t").toPandas()
    assert list(got["c"]) == list(o.groupby("k")["v"].cumsum())
    got = X.carry_forward(df, ["k"], "seg", ["t"], F.when(F.col("v") == 0, F.col("t")), "z").orderBy("k", "t").toPandas()
    want = o["t"].where(o["v"] == 0).groupby(o["k"]).ffill()
    assert [None if math.isnan(a) else a for a in got["z"]] == [None if math.isnan(a) else a for a in want]
    got = X.lag_across(df, ["k"], "seg", ["t"], "v", "l").orderBy("k", "t").toPandas()
    want = o.groupby("k")["v"].shift(1)
    assert [None if math.isnan(a) else a for a in got["l"]] == [None if math.isnan(a) else a for a in want]
    got = X.trailing_count(df, ["k"], "t", 10).orderBy("k", "t").toPandas()
    want = [sum(1 for k2, t2 in zip(o["k"], o["t"]) if k2 == k and t - 10 < t2 <= t) for k, t in zip(o["k"], o["t"])]
    assert list(got["trailing"]) == want
    got = X.hash_rank(df.withColumn("h", F.md5(F.col("t").cast("string"))), "h", ["k"]).toPandas().sort_values(["k", "h"])
    assert list(got.groupby("k")["rank"].cumcount() + 1) == list(got["rank"])
