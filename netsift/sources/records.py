"""Scoring records: JSON flows with a default for every field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift import schema as S

TEXT_FIELDS = ("proto", "service", "state")
RECORD_DDL = ", ".join(f"{f} {'string' if f in TEXT_FIELDS else 'double'}" for f in S.VALIDATED_FIELDS)


def _default(field: str) -> Column:
    return F.lit(S.RECORD_DEFAULTS.get(field, 0.0))


def with_defaults(parsed: DataFrame) -> DataFrame:
    """All record fields in check order; absent ones take their default, other columns are kept in front."""
    rest = [c for c in parsed.columns if c not in S.VALIDATED_FIELDS]
    return parsed.select(*rest, *[F.coalesce(F.col(f), _default(f)).alias(f) for f in S.VALIDATED_FIELDS])


def parse_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON text to typed records. Extra keys are ignored; works on tables and on streams.

    The record is exploded from an array of its own: filters on its fields then stay above the parser, while below it each
    mention of a field would parse the text again.
    """
    rest = [c for c in lines.columns if c != column]
    return with_defaults(lines.select(*rest, F.explode(F.array(F.from_json(column, RECORD_DDL))).alias("_r")).select(*rest, "_r.*"))
