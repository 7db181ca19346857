"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes after which a batch for Python workers ends; one row may be larger.
BATCH_BYTES = 4 << 20


def local_session(name: str = "fieldloom", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the library is written for (UTC, ANSI, AQE)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FIELDLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's batches between the JVM and Python workers end at BATCH_BYTES, so that long texts don't make them large.

    Both sides hold a batch more than once while it passes, and the memory stays with them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def work_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{work_dir(spark)}/fieldloom/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, so a lost executor costs the
    reader's own tasks only, and what was computed once isn't computed again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the base tables, as stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
