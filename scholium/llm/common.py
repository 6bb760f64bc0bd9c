"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as Java and DuckDB patterns both read it; what lies between is a word.
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's own setting that shuffle files go at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own setting of how many rows go to Python at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its scan gives fewer, as a small table in one row group does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go where the cluster says. Only a local session that names no folder, as in tests, gets one of its own;
    on a cluster that would be a folder that executors do not share, so a missing setting is an error there."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder; on a cluster it has to be one that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and drops its lineage: later steps reread it, also after a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, also where body names it many times or inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order; null counts as the empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def spill(df: DataFrame, *by: str) -> DataFrame:
    """Like cut(), but as a compressed table in the same folder; the shuffle files of what led to df go as soon as it stands,
    and the table with the session, if discard() has not removed it before. by names columns to part the table by."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    with_cleanup(spark, lambda: df.write.option("compression", "zstd").partitionBy(*by).parquet(path))
    end_with_session(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.spilled_to = path
    return table


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder's name below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"


def end_with_session(spark: SparkSession, path: str) -> None:
    """Has a folder removed when the session's JVM ends."""
    fs, where = _file(spark, path)
    fs.deleteOnExit(where)


def with_cleanup(spark: SparkSession, write: Callable[[], None]) -> None:
    """Runs a write whose shuffle files go when it ends, and which hands rows to Python in small batches, as texts may be long. The
    settings are the session's and are put back."""
    held = {CLEANUP: "true", BATCH: "1000"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        write()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _file(spark: SparkSession, path: str) -> tuple:
    """(file system, path) as Hadoop knows them."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def discard(table: DataFrame, part: str = "") -> None:
    """Removes a table of spill(), or a part of it, once everything that was made of it is written itself."""
    fs, where = _file(table.sparkSession, f"{table.spilled_to}/{part}" if part else table.spilled_to)
    fs.delete(where, True)
