"""Scalar rules: coercion, text and category cleaning, record checks, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift import schema as S


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_number(col, fill: float | None = None) -> Column:
    """Double, or NULL (or `fill`) where the text does not parse or the value is NaN or infinite."""
    x = _c(col).try_cast("double")
    x = F.when(F.abs(x) < F.lit(float("inf")), x)  # NaN counts as larger than infinity
    return x if fill is None else F.coalesce(x, F.lit(float(fill)))


def norm_text(col) -> Column:
    return F.lower(F.trim(F.coalesce(_c(col).cast("string"), F.lit(""))))


def epoch_micros(ts) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp, independent of the session time zone."""
    ts = _c(ts)
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return (seconds * 1_000_000 + F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def normalise_names(df: DataFrame, blanks: str | None = "_") -> DataFrame:
    """Trim and lower column names; blanks become `_` unless `blanks` is None."""
    names = [n.strip().lower() for n in df.columns]
    return df.toDF(*[n.replace(" ", blanks) if blanks is not None else n for n in names])


def clean_category(col) -> Column:
    """Attack category: missing, `-` and `normal` are Normal, spelling variants are unified."""
    c = F.trim(F.coalesce(_c(col), F.lit("Normal")))
    c = F.when(c.isin("-", "normal"), F.lit("Normal")).otherwise(c)
    variants = F.create_map(*[F.lit(v) for kv in S.CATEGORY_VARIANTS.items() for v in kv])
    return F.coalesce(F.element_at(variants, c), c)


def sizing_category(col) -> Column:
    """Attack category as used to size the normal sample."""
    c = F.lower(F.trim(F.coalesce(_c(col), F.lit("Unknown"))))
    return F.when(c.isin("-", "normal"), F.lit("unknown")).otherwise(c)


def derive_target(category, label) -> Column:
    return F.when(_c(label) == 0, F.lit("Normal")).otherwise(_c(category))


def label_flag(col) -> Column:
    return F.coalesce(to_number(col).cast("int"), F.lit(0))


def is_attack(label="label") -> Column:
    return _c(label) == 1


def is_normal(label="label") -> Column:
    return _c(label) == 0


def fill_zero(df: DataFrame) -> DataFrame:
    """NULL to 0 in every column; text columns get '0'."""
    return df.select(*[
        F.coalesce(F.col(c), F.lit("0" if t == "string" else 0).cast(t)).alias(c) for c, t in df.dtypes
    ])


def decode_class(code, labels: list[str]) -> Column:
    """Class name for a code, or the code as text when it lies outside the list."""
    code = _c(code)
    names = F.array(*[F.lit(x) for x in labels]) if labels else F.array().cast("array<string>")
    return F.coalesce(F.get(names, code.cast("int")), code.cast("int").cast("string"))


def quality_tag(f1) -> Column:
    f1 = _c(f1)
    tag = F.lit("POOR")
    for step, name in reversed(S.QUALITY_STEPS):
        tag = F.when(f1 >= step, F.lit(name)).otherwise(tag)
    return tag


def violations(fields: list[str] | None = None) -> Column:
    """Ordered array of rule violations of a scoring record: {position, field, problem}."""
    checks = []
    for pos, name in enumerate(fields or S.VALIDATED_FIELDS, 1):
        c = F.col(name)
        if name in ("proto", "service", "state"):
            problem = F.when(c.isNull(), F.lit("missing")).when(F.trim(c) == "", F.lit("empty"))
        else:
            x = c.try_cast("double")
            problem = F.when(c.isNull(), F.lit("missing")).when(
                x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit("not finite"))
            if name not in S.SIGNED_FIELDS:
                problem = problem.when(x < 0, F.lit("negative"))
        checks.append(F.struct(F.lit(pos).alias("position"), F.lit(name).alias("field"), problem.alias("problem")))
    return F.filter(F.array(*checks), lambda v: v["problem"].isNotNull())


def validate(df: DataFrame) -> DataFrame:
    """Adds `violations` and the first failure as `failed_field` / `failure` (NULL when valid)."""
    first = F.get(F.col("violations"), 0)
    return (
        df.withColumn("violations", violations([f for f in S.VALIDATED_FIELDS if f in df.columns]))
        .withColumn("failed_field", first["field"])
        .withColumn("failure", first["problem"])
    )


def canonical_columns(df: DataFrame) -> DataFrame:
    """Known flow columns in canonical order; label columns and unknown columns are dropped."""
    return df.select(*[c for c in S.FLOW_COLUMNS if c in df.columns])


def drop_labels(df: DataFrame) -> DataFrame:
    return df.drop(*S.LABEL_COLUMNS)


def slow_requests(df: DataFrame, limit_ms: float = 1000.0) -> DataFrame:
    return df.where(F.col("latency_ms") > limit_ms)


def numeric_ratios(df: DataFrame, columns: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(_c(c).try_cast("double").isNotNull().cast("int")).alias(c) for c in columns]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in columns}


def coerce_mostly_numeric(df: DataFrame, min_ratio: float = 0.85) -> DataFrame:
    """Make a text column numeric when at least `min_ratio` of all rows parse; one scan decides."""
    text = [c for c, t in df.dtypes if t == "string"]
    ratios = numeric_ratios(df, text) if text else {}
    return df.select(*[
        F.col(c).try_cast("double").alias(c) if ratios.get(c, 0.0) >= min_ratio else F.col(c) for c in df.columns
    ])


def merge_rare(df: DataFrame, col: str = "attack_cat", min_count: int = S.RARE_CLASS_MIN,
               keep: tuple[str, ...] = ("Normal", "Generic"), into: str = "Generic") -> DataFrame:
    """Categories with fewer than `min_count` rows become `into`; `keep` never changes."""
    from netsift.functions.scaling import lookup

    rare = (
        df.groupBy(col).agg(F.count("*").alias("_n"))
        .where((F.col("_n") < min_count) & ~F.col(col).isin(*keep))
        .select(col, F.lit(True).alias("_rare"))
    )
    return lookup(df, rare, [col]).withColumn(col, F.when(F.col("_rare"), F.lit(into)).otherwise(F.col(col))).drop("_rare")
