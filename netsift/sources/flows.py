"""Flow table sources and sinks: CSV parts, catalogs, train / test tables, split tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.functions.cleaning import label_flag, normalise_names, to_number

CATEGORY_NAMES = ("proto", "service", "state", "attack_cat")


def exists(spark: SparkSession, path: str) -> bool:
    """True when the path can be read (any file system Spark can list)."""
    try:
        spark.read.text(path)
        return True
    except AnalysisException:
        return False


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Feature catalog: a latin-1 CSV with a `Name` column; names trimmed, blanks to `_`."""
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    return raw.withColumn("Name", F.regexp_replace(F.trim("Name"), " ", "_"))


def catalog_schema(catalog: DataFrame) -> T.StructType:
    """Column types by name: text for categories, int for the label, double otherwise. The catalog lists
    the columns of one table, so its rows are read on the driver."""
    def kind(name: str) -> T.DataType:
        if name.lower() in CATEGORY_NAMES:
            return T.StringType()
        return T.IntegerType() if name.lower() == "label" else T.DoubleType()

    return T.StructType([T.StructField(r["Name"], kind(r["Name"])) for r in catalog.select("Name").collect()])


def _one_csv(spark: SparkSession, path: str, schema: T.StructType | None, header: bool, encoding: str, max_rows: int | None) -> DataFrame:
    """Reads whole lines, leaves out those with too many fields, and parses the rest as text, so that an
    odd value costs a cell and not a row."""
    if schema is None:
        names = spark.read.option("header", header).option("encoding", encoding).csv(path).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    lines = _lines(spark, path, header, encoding)
    fields = _fields()
    text = ", ".join(f"c{i} string" for i in range(len(schema)))
    parsed = lines.where(fields <= len(schema)).select(F.from_csv(F.col("line"), text).alias("r"))
    out = []
    for i, f in enumerate(schema):
        c = F.col(f"r.c{i}")
        out.append((c if isinstance(f.dataType, T.StringType) else to_number(c).cast(f.dataType)).alias(f.name))
    df = parsed.select(*out)
    return df.limit(max_rows) if max_rows is not None else df


def _lines(spark: SparkSession, path: str, header: bool, encoding: str) -> DataFrame:
    return (
        spark.read.schema("line string").option("header", header).option("encoding", encoding)
        .option("sep", "\u0001").option("quote", "").option("escape", "").option("maxCharsPerColumn", -1).csv(path)
    )


def _fields():
    """Number of fields of a line; commas inside quotes don't count."""
    line = F.col("line")
    bare = F.when(line.contains('"'), F.regexp_replace(line, r'"(?:[^"]|"")*"', "")).otherwise(line)
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def rejected_lines(spark: SparkSession, paths: list[str], schema: T.StructType, header: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """(path, line, fields) of the lines `read_flow_csv` leaves out because they have more fields than the schema."""
    there = [path for path in paths if exists(spark, path)]
    if not there:
        return spark.createDataFrame([], "path string, line string, fields int")
    parts = [_lines(spark, path, header, encoding).withColumn("fields", _fields()).where(F.col("fields") > len(schema))
             .select(F.lit(path).alias("path"), "line", F.col("fields").cast("int").alias("fields")) for path in there]
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_flow_csv(spark: SparkSession, paths: list[str], schema: T.StructType | None = None, header: bool | None = None,
                  max_rows: int | None = None, encoding: str = "UTF-8", report: bool = False) -> DataFrame:
    """Union of flow CSV parts. With a schema (from the catalog) the files have no header line.

    Missing files are skipped with a warning; it is an error when none exists. `max_rows` is a cap per file. Lines with
    more fields than the schema are left out: `rejected_lines` has them, and with `report` their number is warned of.
    """
    header = schema is None if header is None else header
    if report and schema is not None and (bad := rejected_lines(spark, paths, schema, header, encoding).count()):
        warnings.warn(f"{bad} lines have more than {len(schema)} fields and are left out", stacklevel=2)
    parts = []
    for path in paths:
        if exists(spark, path):
            parts.append(normalise_names(_one_csv(spark, path, schema, header, encoding, max_rows)))
        else:
            warnings.warn(f"flow file not found: {path}", stacklevel=2)
    if not parts:
        raise FileNotFoundError("none of the flow files exists")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def combine_labelled(spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
    """Union of tables with differing columns; `label` is required and becomes 0 / 1, bad values 0."""
    parts = [normalise_names(t, blanks=None) for t in tables]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if "label" not in out.columns:
        raise ValueError("label column missing from loaded tables")
    return out.withColumn("label", label_flag("label"))


def read_table_or_parts(spark: SparkSession, path: str, parts: list[str], schema: T.StructType | None = None) -> DataFrame:
    """A named train or test table, or the combined parts where it does not exist."""
    if exists(spark, path):
        return read_flow_csv(spark, [path], header=True)
    warnings.warn(f"table not found: {path}; using the combined parts", stacklevel=2)
    return read_flow_csv(spark, parts, schema)


def read_train_test(spark: SparkSession, train: str, test: str, parts: list[str], schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    return read_table_or_parts(spark, train, parts, schema), read_table_or_parts(spark, test, parts, schema)


def stored_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], force_rebuild: bool = False) -> DataFrame:
    """A Parquet table built once and reused; it must have a `label`, which is read as 0 / 1."""
    if force_rebuild or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    df = normalise_names(spark.read.parquet(path), blanks=None)
    if "label" not in df.columns:
        raise ValueError(f"stored table at {path} has no label column")
    return df.withColumn("label", label_flag("label"))


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Features and target together, one folder per value of `split`."""
    df.write.mode("overwrite").partitionBy("split").format(fmt).option("header", True).save(path)


def read_split(spark: SparkSession, path: str, split: str, fmt: str = "parquet") -> DataFrame:
    """One split; only its folder is read."""
    df = spark.read.format(fmt).option("header", True).load(path)
    return df.where(F.col("split") == split).drop("split")
