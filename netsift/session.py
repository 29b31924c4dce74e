"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def build_session(app: str = "netsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        METHOD_LIMIT: "8000",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    The cluster names it in spark.checkpoint.dir; without it, a run on several machines is refused. Only with a
    local master (tests, a laptop) a local folder is created and recorded, so later calls reuse it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="netsift-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root


def limit_methods(spark: SparkSession) -> None:
    """Java doesn't compile methods of more than 8,000 bytes of bytecode but interprets them, several times slower; the
    projections of the preparation grow that large. Below the limit Spark generates one class per projection instead.
    A limit that the session already has stays."""
    if spark.conf.get(METHOD_LIMIT, None) is None:
        spark.conf.set(METHOD_LIMIT, "8000")


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package once per application, so that tasks find it wherever they were started."""
    context = spark.sparkContext
    home = os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_netsift_shipped", None) == home:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="netsift-code-"), "netsift.zip")  # served by the driver to the end
    with zipfile.ZipFile(archive, "w") as out:
        for path, _, names in os.walk(home):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(path, name)
                out.write(full, os.path.relpath(full, os.path.dirname(home)))
    context.addPyFile(archive)
    context._netsift_shipped = home


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody used before, inside the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and continue from the written table.

    Cuts lineage and survives the loss of executors, which caching alone does not. `codec` is for tables that are large.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if codec:
        writer = writer.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
