"""Keyed writes as folds: Parquet has no MERGE, so a batch of updates is folded by key in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fold_upserts(stored: DataFrame, updates: DataFrame, key: str, seq: str, overwrite: list[str], enrich: list[str], guarded: str, guard_source: str, rank: Column) -> DataFrame:
    """What applying the updates one by one in order of seq leaves.

    A key's base is its stored row, or its first update, taken as it is. overwrite columns end with the last row's
    value, enrich columns with the last known one. The guarded pair (value, source) is replaced by a later known
    value whose source's rank isn't below that of the source that stands, even if that one came without a value; a pair
    without source is replaced by any. What stands never loses rank, so the best known pair wins unless the base's source outranks it.
    """
    columns = [*overwrite, *enrich, guarded, guard_source]
    rows = stored.select(key, F.lit(-1).cast("long").alias("_seq"), *columns).unionByName(updates.select(key, F.col(seq).cast("long").alias("_seq"), *columns)).withColumn("_rank", rank)
    known = F.when(F.col(guarded).isNotNull(), F.struct("_rank", "_seq"))
    best = F.max_by(F.struct(guarded, guard_source, "_rank"), known)
    base = F.min_by(F.struct(guarded, guard_source, F.when(F.col(guard_source).isNull(), -1).otherwise(F.col("_rank")).alias("_rank")), "_seq")
    folded = rows.groupBy(key).agg(*[F.max_by(c, "_seq").alias(c) for c in overwrite], *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in enrich], best.alias("_best"), base.alias("_base"))
    wins = F.coalesce(F.col("_base")[guarded].isNotNull() | (F.col("_best")["_rank"] >= F.col("_base")["_rank"]), F.lit(False))
    pick = lambda c: F.when(wins, F.col("_best")[c]).otherwise(F.col("_base")[c]).alias(c)
    return folded.select(key, *overwrite, *enrich, pick(guarded), pick(guard_source))


def patch(stored: DataFrame, updates: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """Partial upsert: the last known value of some columns; keys without a stored row are new ones."""
    last = updates.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_{c}") for c in columns])
    joined = stored.join(last, key, "full")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns])


def last_write(df: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """The last row of each key, unknown values included."""
    s = F.max_by(F.struct(*columns), seq)
    return df.groupBy(key).agg(s.alias("_s")).select(key, *[F.col("_s")[c].alias(c) for c in columns])


def replace_by_key(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of incoming instead of all stored rows of its keys; an empty batch changes nothing."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming.select(*stored.columns))


def replace_partitions(spark: SparkSession, incoming: DataFrame, path: str, key: str) -> None:
    """The same on a Parquet folder partitioned by key: only partitions that incoming has are overwritten."""
    incoming.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def retain(df: DataFrame, time: str, cutoff: Column) -> DataFrame:
    """Rows not older than cutoff."""
    return df.filter(F.col(time) >= cutoff)


def replace_subscription(stored: DataFrame, row: DataFrame, key: str) -> DataFrame:
    """Delete by key, then append."""
    return stored.join(row, key, "left_anti").unionByName(row.select(*stored.columns))


def write_back(stored: DataFrame, merged: DataFrame, key: str, overwrite: list[str], only_new: list[str]) -> DataFrame:
    """Merged rows over the stored ones: overwrite columns take the merged value, the others are only set for new keys."""
    m = merged.select(key, *[F.col(c).alias(f"_{c}") for c in [*overwrite, *only_new]], F.lit(True).alias("_new"))
    s = stored.withColumn("_old", F.lit(True))
    j = s.join(m, key, "full")
    pick = lambda c: F.when(F.col("_new") & F.lit(c in overwrite), F.col(f"_{c}")).when(F.col("_old"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return j.select(*[pick(c) if c in overwrite or c in only_new else F.col(c) for c in stored.columns])


def append(rows: DataFrame, path: str) -> None:
    """A batch at the end of a table; Spark chunks it."""
    rows.write.mode("append").parquet(path)


def append_quietly(rows: DataFrame, path: str) -> bool:
    """append() of a beacon that may be lost: what goes wrong is told by False, never raised."""
    try:
        append(rows, path)
    except Exception:
        return False
    return True
