"""Views that several scans of a query read are computed once."""

import pytest

from netsift.plans import catalogue  # noqa: F401  (registers the queries)
from netsift.plans import views as V
from netsift.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["f3_correlated_removal", "f21_all_strategies", "f21_strategy_comparison", "d12_profile_report", "d14_correlation_matrix"])
def test_flows_are_computed_once(spark, monkeypatch, tmp_path, name):
    rows = [{"l_orderkey": i // 3, "l_partkey": i % 40, "l_suppkey": i % 7, "l_linenumber": i % 4 + 1, "l_quantity": float(i % 50 + 1), "l_extendedprice": 10.0 + i * 1.25, "l_discount": (i % 11) / 100,
             "l_tax": (i % 9) / 100, "l_returnflag": "ANR"[i % 3], "l_linestatus": "OF"[i % 2], "l_shipdate": f"1998-0{i % 9 + 1}-11 00:00:00"} for i in range(300)]
    orders = [{"o_orderkey": i, "o_custkey": i % 13, "o_totalprice": 100.0 + i * i, "o_orderpriority": f"{i % 5 + 1}-X"} for i in range(100)]
    spark.createDataFrame(rows).withColumn("l_shipdate", V.F.to_timestamp("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders).write.parquet(f"{tmp_path}/orders.parquet")
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
    assert seen.value == 300
