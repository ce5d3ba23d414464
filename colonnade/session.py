"""Session construction and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app_name: str = "colonnade", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; cluster settings are left to spark-submit."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is configured and the session is
    local, as in tests."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="colonnade-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back: later passes read only the
    columns they need instead of recomputing, and the copy survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Compute a frame with one row per column, metric or reported group now, and keep its rows as a
    local table.  For such small frames only: their size does not grow with the data."""
    return df.sparkSession.createDataFrame(df.toArrow())


def local_table(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A small constant table, column by column."""
    fields = T.StructType.fromDDL(schema).fields
    table = spark.createDataFrame(pa.table({f.name: pa.array(columns[f.name]) for f in fields}))
    return table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    fields = T.StructType.fromDDL(schema).fields
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
