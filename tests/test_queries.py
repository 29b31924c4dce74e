"""Registered queries against their SQL twins on the smallest tables: one or two of each family.

`python tests/oracle.py 0.01` runs all of them.
"""

import pytest
from oracle import compare, connect

SAMPLE = [
    "a1_flow_csv_scan", "a9_drift_history", "b1_numeric_coercion", "b5_rare_class_merge", "b9_flow_validation", "c6_handshake_timing", "c8_inter_arrival",
    "c11_connection_counts", "d4_binary_columns", "d7_high_correlation_pairs", "d9_mutual_information", "e1_class_caps", "e4_duplicate_removal",
    "e6_three_way_split", "e10_danger_rows", "f2_imputation", "f7_target_encoding", "f14_robust_scaling", "h5_roc_auc", "h10_split_evaluation",
    "i8_psi_baseline_deciles", "i12_chi_square", "i14_numeric_score", "i25_alerts", "j3_rate_limit", "j5_request_gate", "j7_latency_percentiles",
    "j14_scenario_window_tag", "j19_source_liveness", "j19_stream_liveness", "j1_stream_flow_sessions", "j3_stream_rate_limit",
]


@pytest.fixture(scope="session")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, con, sf, name):
    import __spark_entry__ as entry

    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf) is None


def test_every_twin_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and {"feature", "psi", "status"} <= set(rows[0].asDict())
    assert any(r["status"] == "drift" for r in rows)
