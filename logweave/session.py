"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "logweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC wall clocks and adaptive execution."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a local session, which is one machine, gets a folder of its own."""
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY) or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[[^-]*\])?$", context.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="logweave-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{_own_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def _own_scratch(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/logweave/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application. Frames built from them cannot be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# Parquet looks at the size of pages and row groups every 100 rows at first; of large rows it is to look at each.
LARGE_ROWS = {
    "parquet.page.size.row.check.min": "1",
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size": str(16 << 20),
    "parquet.enable.dictionary": "false",
}


def materialize(df: DataFrame, label: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    With ``large_rows``, of some hundred KB each, pages and row groups end by size: a page is compressed in buffers beside the
    heap that are as large as it is."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**LARGE_ROWS if large_rows else {}).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_folder = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more, so that rounds do not fill the disk. Spark deletes the
    shuffles of frames once the driver has collected them as garbage, which it is asked to do here."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.scratch_folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    context._jvm.System.gc()


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Use all cores for costly expressions over an input of few splits; larger inputs stay where they are read.

    With ``rows`` there are as many tasks as keep each to about so many; the input is counted, so let it be a table."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        wanted = max(wanted, -(-df.count() // rows))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


@contextmanager
def _held(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_splits(spark: SparkSession, max_bytes: int = 16 << 20):
    """Tables read by actions inside are cut into splits of so many bytes: a task that sorts wide rows holds no more."""
    return _held(spark, "spark.sql.files.maxPartitionBytes", str(max_bytes))


def small_batches(spark: SparkSession, max_bytes: int = 4 << 20):
    """Python workers of actions inside get so many bytes of rows at a time, or one row: some MB of a row stand in the JVM, beside
    its heap and in the worker at once."""
    return _held(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))


def sized_broadcast(df: DataFrame, label: str, max_bytes: int = 32 << 20) -> DataFrame:
    """Materialise a side table and broadcast it only when its rows, as Spark holds them, are small; else leave it to a
    shuffle join. Texts and arrays count with their lengths."""
    table = materialize(df, label)
    side = table.hint("broadcast") if held_bytes(table) <= max_bytes else table
    side.scratch_folder = table.scratch_folder
    return side


def held_bytes(table: DataFrame) -> int:
    """About the bytes of a table in memory: 16 per row and column, and what texts, binaries and nested values hold."""
    wide = [f.name for f in table.schema.fields if f.dataType.typeName() in ("string", "binary")]
    nested = [f.name for f in table.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "variant")]
    size = F.lit(16 * max(1, len(table.columns)))
    for name in wide:
        size = size + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
    for name in nested:
        size = size + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
    return table.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]
