"""Training and scoring compute their input once, parse a record once and don't shuffle rows by class."""

import json

import pytest
from pyspark.sql import functions as F

from netsift.operators.sampling import balanced_weights
from netsift.plans import catalogue  # noqa: F401  (registers the queries)
from netsift.plans import views as V
from netsift.plans.registry import QUERIES
from netsift.session import METHOD_LIMIT, limit_methods
from netsift.functions.cleaning import to_number
from netsift.sources.records import parse_records
from netsift.streaming.scoring import check_records


def tables(spark, path, n=600):
    rows = [{"l_orderkey": i // 3, "l_partkey": i % 40, "l_suppkey": i % 7, "l_linenumber": i % 4 + 1, "l_quantity": float(i % 50 + 1), "l_extendedprice": 10.0 + i * 1.25, "l_discount": (i % 11) / 100,
             "l_tax": (i % 9) / 100, "l_returnflag": "ANR"[i % 3], "l_linestatus": "OF"[i % 2], "l_shipdate": f"1998-0{i % 9 + 1}-11 00:00:00"} for i in range(n)]
    orders = [{"o_orderkey": i, "o_custkey": i % 13, "o_totalprice": 100.0 + i * i, "o_orderpriority": f"{i % 5 + 1}-X"} for i in range(n // 3)]
    spark.createDataFrame(rows).withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(orders).write.parquet(f"{path}/orders.parquet")


@pytest.mark.parametrize("name", ["g5_training_statistics", "g7_stream_scoring"])
def test_flows_are_computed_once(spark, monkeypatch, tmp_path, name):
    tables(spark, tmp_path)
    seen, flows = spark.sparkContext.accumulator(0), V.flows

    def counted(spark, sf_dir):
        def count(frames):
            for pdf in frames:
                seen.add(len(pdf))
                yield pdf

        f = flows(spark, sf_dir)
        return f.mapInPandas(count, f.schema)

    monkeypatch.setattr(V, "flows", counted)
    assert QUERIES[name](spark, str(tmp_path)).collect()
    assert seen.value == 600


def test_a_record_is_parsed_once(spark):
    good = json.dumps({"proto": "tcp", "service": "http", "state": "FIN", "sbytes": 3.0, "other": 1})
    lines = spark.createDataFrame([(1, good), (2, json.dumps({"sbytes": -1.0})), (3, "no json"), (4, None)], "id int, value string")
    checked = check_records(lines).where("failed_field is null")
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    parsed = {r["id"]: r for r in parse_records(lines).collect()}
    assert sorted(parsed) == [1, 2, 3, 4] and parsed[1]["sbytes"] == 3.0 and parsed[2]["sbytes"] == -1.0
    assert parsed[3][1:] == parsed[4][1:]  # nothing but defaults
    assert 2 not in {r["id"] for r in checked.select("id").collect()}


def test_weights_are_broadcast(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), (None, 5)], "cls string, x int")
    weighted = balanced_weights(rows, "cls")
    assert "BroadcastHashJoin" in weighted._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in weighted._jdf.queryExecution().executedPlan().toString()
    got = {r["x"]: r["weight"] for r in weighted.collect()}
    assert got == pytest.approx({1: 5 / 9, 2: 5 / 9, 3: 5 / 9, 4: 5 / 3, 5: None}) and len(got) == 5


def test_numbers_that_are_not_finite(spark):
    row = spark.createDataFrame([("1.5", "NaN", "Infinity", "-Infinity", "x", None, "-0.0")], "a string, b string, c string, d string, e string, f string, g string")
    assert list(row.select(*[to_number(c) for c in "abcdefg"]).first()) == [1.5, None, None, None, None, None, 0.0]
    assert list(row.select(*[to_number(c, 7) for c in "abcdef"]).first()) == [1.5, 7.0, 7.0, 7.0, 7.0, 7.0]


def test_method_limit(spark):
    given = spark.conf.get(METHOD_LIMIT, None)
    try:
        spark.conf.unset(METHOD_LIMIT)
        limit_methods(spark)
        assert spark.conf.get(METHOD_LIMIT) == "8000"
        spark.conf.set(METHOD_LIMIT, "5000")
        limit_methods(spark)
        assert spark.conf.get(METHOD_LIMIT) == "5000"
    finally:
        spark.conf.set(METHOD_LIMIT, given or "8000")
