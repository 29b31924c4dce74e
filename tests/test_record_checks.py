"""The checks of scoring records: what a filter on them leaves to the optimizer, and the rows they give."""

import json

from pyspark.sql import functions as F

from netsift.streaming.scoring import check_records


def test_a_filter_on_the_checks_is_a_filter_on_their_result(spark):
    lines = spark.createDataFrame([("a", json.dumps({"sport": 80.0, "proto": "tcp"}))], "id string, value string")
    plan = check_records(lines).where("failed_field is null").select("id", "sport")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and all(len(line) < 500 for line in filters)  # not the checks of all fields, which other columns multiply


def test_checked_records_keep_their_rows(spark):
    records = [("good", {"proto": "tcp", "service": "http", "state": "FIN", "sport": 80}), ("empty", {"proto": " "}), ("none", {})]
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in records] + [("broken", "{"), ("null", None)], "id string, value string")
    checked = check_records(lines)
    got = {r["id"]: r for r in checked.collect()}
    assert set(got) == {"good", "empty", "none", "broken", "null"}
    assert got["good"]["failed_field"] is None and got["good"]["sport"] == 80.0
    assert got["empty"]["failed_field"] == "proto" and got["empty"]["failure"] == got["empty"]["violations"][0]["problem"] == "empty"
    assert {r["id"] for r in checked.where("failed_field is null").collect()} == {i for i, r in got.items() if r["failed_field"] is None}
    assert checked.where(F.size("violations") > 0).count() == sum(len(r["violations"]) > 0 for r in got.values())
