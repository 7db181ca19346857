"""Guarded commits: a batch is staged, compared with the counts of the last commit, published, and only then becomes what the next one is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.relational import count_guard
from fieldloom.operators.upsert import replace_partitions
from fieldloom.session import materialise


def _versions(spark: SparkSession, state: str) -> list[int]:
    """Numbers of the complete versions of a state table: those whose writer got to its end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{n}/_SUCCESS")))


def baseline(spark: SparkSession, state: str, key: str, key_type: str = "string") -> DataFrame:
    """(key, n) of the last commit; without one, as after one that broke off first, there are no rows."""
    known = _versions(spark, state)
    schema = f"{key} {key_type}, n bigint"
    return spark.read.schema(schema).parquet(f"{state}/v={known[-1]}") if known else spark.createDataFrame([], schema)


def commit(batch: DataFrame, published: str, state: str, key: str) -> DataFrame:
    """Publish the groups of a batch that pass; (key, n, last, verdict) of all groups.

    A group below half of its last count is blocked: its rows and its baseline stay as they were. The others replace their partition of
    `published`, then a new version of the baseline is written beside the old ones, which a reader takes only once it is whole. If the job is
    lost between the two, the same batch can be committed again. Groups that the batch lacks keep rows and baseline. Null keys drop out.
    """
    spark, key_type = batch.sparkSession, batch.schema[key].dataType.simpleString()
    staged = materialise(batch.filter(F.col(key).isNotNull()), "staged")
    last = materialise(baseline(spark, state, key, key_type), "baseline")
    verdicts = materialise(count_guard(staged.groupBy(key).agg(F.count(F.lit(1)).alias("n")), last, [key]), "verdicts")
    passing = verdicts.filter("verdict <> 'block'").select(key, "n")
    replace_partitions(spark, staged.join(passing, key, "left_semi"), published, key)
    after = passing.unionByName(last.join(passing, key, "left_anti").select(key, "n"))
    version = max(_versions(spark, state), default=0) + 1
    after.write.mode("overwrite").parquet(f"{state}/v={version}")
    return verdicts
