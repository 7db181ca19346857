"""Order-based operators: latest, first, islands, carried values, running caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows without key all stay."""
    w = Window.partitionBy(key).orderBy(order)
    return df.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").unionByName(df.filter(F.col(key).isNull()))


def first_per_identity(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each first known key, upper-cased: rows without the first key are told apart by the next."""
    return latest(df.withColumn("_k", F.upper(F.coalesce(*[F.col(k).cast("string") for k in keys]))), ["_k"], [F.col(order).asc()]).drop("_k")


def islands(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: number, value, first and last place, length."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1), F.lit(True))
    numbered = df.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w)).withColumn("_at", F.row_number().over(w))
    return numbered.groupBy(*by, "run").agg(F.first(value).alias(value), F.min("_at").alias("first_at"), F.max("_at").alias("last_at"), F.count(F.lit(1)).alias("length"))


def carried(df: DataFrame, by: list[str], order: list[str], heading: Column, name: str) -> DataFrame:
    """The last heading at or before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(heading, ignorenulls=True).over(w))


def until(df: DataFrame, by: list[str], order: list[str], stop: Column) -> DataFrame:
    """Rows before the first one that stops."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_stop", F.max(F.coalesce(stop, F.lit(False))).over(w)).filter(~F.col("_stop")).drop("_stop")


def capped(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def distinct_then_top(df: DataFrame, by: list[str], unique: str, order: list[Column], k: int) -> DataFrame:
    """Of each key: one row per `unique` (the first in order), then the first k."""
    once = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by, unique).orderBy(*order))).filter("_n = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k).drop("_n")


def keep_newest_until(df: DataFrame, by: list[str], newest_first: list[Column], size: str, most: float) -> DataFrame:
    """Rows, newest first, while their sizes add up to at most `most`."""
    w = Window.partitionBy(*by).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("kept_size", F.sum(size).over(w)).filter(F.col("kept_size") <= most)


def transitions(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before; the first of a key isn't a transition."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def normalised(df: DataFrame, by: list[str], value: str, name: str = "y") -> DataFrame:
    """Value between its key's extremes, 0.5 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(name, F.when(high == low, 0.5).otherwise((F.col(value) - low) / F.nullif(high - low, F.lit(0.0))))


def steps(df: DataFrame, by: list[str], order: list[str], name: str = "x") -> DataFrame:
    """Place of each row between 0 and 1, 0 for a single one."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn(name, F.coalesce(F.try_divide(F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1, n - 1), F.lit(0.0)))


def sections(df: DataFrame, by: list[str], at: str, end: str) -> DataFrame:
    """Each start position with where the next begins, or the end."""
    return df.withColumn("until", F.coalesce(F.lead(at).over(Window.partitionBy(*by).orderBy(at)), F.col(end)))


def series(df: DataFrame, by: list[str], time: str, order: str, value: str, others: list[str]) -> DataFrame:
    """Each series: the latest row's columns, its known values and their times in order, and statistics of them."""
    last = F.struct(time, order)
    points = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(order).alias("o"), F.col(value).alias("v")))))
    s = df.groupBy(*by).agg(F.max(time).alias("last_at"), *[F.max_by(c, last).alias(c) for c in others], points.alias("p"))
    v = F.transform("p", lambda x: x["v"])
    return s.withColumn("points", v).withColumn("times", F.transform("p", lambda x: x["t"])).drop("p").withColumn("low", F.array_min("points")).withColumn("high", F.array_max("points")).withColumn("n", F.size("points"))
