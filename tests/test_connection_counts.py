"""Connection counts against brute force, with hot and missing addresses, and how often they shuffle the flows."""

from collections import Counter

import pytest

from netsift.operators import packets as P

DDL = "n int, state string, sttl long, srcip string, dstip string, service string, sport long, dsport long, ct_dst_ltm long"


def flows():
    rows = []
    for i in range(240):
        src = "hot" if i % 3 == 0 else None if i % 7 == 0 else f"c{i % 40}"
        dst = "s" if i % 5 < 2 else None if i % 11 == 0 else f"s{i % 30}"
        rows.append((i, "FIN" if i % 2 else None, i % 4, src, dst, "dns" if i % 8 else None, 1024 + i % 6, i % 3, -1))
    return rows


@pytest.mark.parametrize("hot_rows", [0, 20, 1_000])
def test_counts_of_hot_and_missing_addresses(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(P, "HOT_ROWS", hot_rows, raising=False)
    df = spark.createDataFrame(flows(), DDL).repartition(3)
    got = P.connection_counts(df)
    assert got.columns == [c for c in df.columns if c != "ct_dst_ltm"] + list(P.CONNECTION_COUNTS)
    names = df.columns
    at = {f: [names.index(k) for k in keys] for f, keys in P.CONNECTION_COUNTS.items()}
    tally = {f: Counter(tuple(r[i] for i in index) for r in flows()) for f, index in at.items()}
    want = {r[0]: [tally[f][tuple(r[i] for i in index)] for f, index in at.items()] for r in flows()}
    assert {r["n"]: [r[f] for f in P.CONNECTION_COUNTS] for r in got.collect()} == want
    assert P.connection_counts(df.limit(0)).count() == 0


def test_the_flows_are_shuffled_once_per_leading_key(spark):
    got = P.connection_counts(spark.createDataFrame(flows(), DDL))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= len({keys[0] for keys in P.CONNECTION_COUNTS.values()})
