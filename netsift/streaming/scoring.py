"""Record-at-a-time scoring as a stream: JSON records, checks, preparation, prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.functions.cleaning import decode_class, validate
from netsift.sources.records import parse_records


def check_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parsed records with `failed_field` and `failure` (NULL for good ones).

    They are exploded like the records, so that a filter on them stays above the checks. Below it would be a constraint on all
    fields, of which the optimizer makes a copy for every choice of renamed fields, until the driver has no memory left.
    """
    checked = validate(parse_records(lines, column))
    return checked.select(F.explode(F.array(F.struct(*checked.columns))).alias("_c")).select("_c.*")


def score_records(lines: DataFrame, preparation, classifier, column: str = "value", keep: list[str] = ()) -> DataFrame:
    """Predictions for the valid records of a table or stream of JSON lines."""
    good = check_records(lines, column).where("failed_field is null").drop("violations", "failed_field", "failure")
    scored = classifier.predict(preparation.transform(good))
    return scored.select(*keep, decode_class("prediction_code", classifier.info["classes"]).alias("prediction"), F.array_max("probability").alias("confidence"))
