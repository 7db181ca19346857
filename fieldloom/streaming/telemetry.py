"""Telemetry as streams: samples and beacons from JSON lines, stamped where they arrive; alerts with state for each key; published changes.

Every function takes a streaming DataFrame (a batch one where nothing is kept between batches) and returns one; `drained` runs a stream
over all that is there and returns what its sink holds. State and progress live in the checkpoint folder, so a stream that was
killed goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldloom.functions import text
from fieldloom.session import new_path
from fieldloom.streaming.alerts import step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SAMPLE = "category string, metric string, value double, unit string, scope string, status string, recorded_at long"
LEVELS = ("ok", "warn", "crit")


def read_lines(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Streaming lines (`value`) of all text files that appear in folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)


def samples(lines: DataFrame, raw: str = "value") -> DataFrame:
    """Metric samples of JSON lines. One stamp for all samples of a batch that bring none; lines that aren't objects, or lack
    category or metric, are dropped. A field of the wrong type is null."""
    s = lines.select(F.from_json(raw, SAMPLE, {"mode": "PERMISSIVE"}).alias("s")).select("s.*").filter("category is not null and metric is not null")
    return s.withColumn("recorded_at", F.coalesce("recorded_at", F.unix_timestamp(F.current_timestamp())))


def series_key() -> F.Column:
    """category/metric, then /scope if there is one."""
    return F.concat_ws("/", "category", "metric", F.nullif("scope", F.lit("")))


def analytics(lines: DataFrame, raw: str = "value") -> DataFrame:
    """Page views from beacons, one wide row each. The time is the server's: a clock that a client sends is never read."""
    return text.beacons(lines, raw).withColumn("recorded_at", F.unix_timestamp(F.current_timestamp()))


class Alerts(StatefulProcessor):
    """Last run, level and time of the last alert of a key. A key that missed a run starts anew; an idle one is forgotten by a timer."""

    def __init__(self, cooldown: int, idle: int) -> None:
        self.cooldown, self.idle = cooldown, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alert", "run bigint, status string, at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = tuple(self.state.get()) if self.state.exists() else None
        got = pd.concat(list(rows)).sort_values(["run", "seq"], kind="stable").drop_duplicates("run")
        out, last = [], None
        for run, ts, status in zip(got["run"].tolist(), got["ts"].tolist(), got["status"].tolist(), strict=True):
            if known is not None and run <= known[0]:
                continue  # the run's first sample came with an earlier batch
            kind, (level, at) = step(known[1:] if known is not None and known[0] == run - 1 else None, status, ts, self.cooldown)
            known, last = (run, level, at), ts
            if kind:
                out.append((key[0], ts, kind))
        if last is not None:
            self.state.update(known)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.idle) * 1000)
        yield pd.DataFrame(out, columns=["key", "ts", "kind"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame([], columns=["key", "ts", "kind"])

    def close(self) -> None:
        pass


def alert_stream(rows: DataFrame, cooldown: int, idle: int = 3 * 86400, late: str = "1 day") -> DataFrame:
    """(key, ts, kind) of samples (key, run, seq, ts, status) as they come: the alerts that alerts_by_key finds in the whole history.

    The sample with the smallest seq of a key and run counts; other levels than ok, warn and crit don't. State is one row for
    each key that was seen in the last `idle` seconds of event time; samples later than `late` are dropped with their state.
    """
    kept = rows.filter(F.col("status").isin(*LEVELS)).select("key", F.col("run").cast("long"), F.col("seq").cast("long"), F.col("ts").cast("long"), "status")
    timed = kept.withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", late)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return timed.groupBy("key").transformWithStateInPandas(Alerts(cooldown, idle), "key string, ts bigint, kind string", "append", "eventtime")


def changed(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of now that are new or differ from before (kind added or changed), and keys that are gone (removed, other columns null)."""
    values = [c for c in now.columns if c not in keys]
    old = before.select(*keys, F.struct(*values).alias("_old"))
    both = now.select(*keys, F.struct(*values).alias("_new")).join(old, keys, "full")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_new").eqNullSafe(F.col("_old")), "changed")
    return both.withColumn("kind", kind).filter("kind is not null").select(*keys, *[F.col("_new")[c].alias(c) for c in values], "kind")


def publisher(keys: list[str], baseline: Callable[[], DataFrame | None], publish: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands a batch's changes against the baseline to publish, and does nothing for a batch without any.

    publish gets the batch id: a batch that is run again after a failure has the same id, so writing under that name makes it idempotent.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        before = baseline()
        told = changed(before if before is not None else batch.limit(0), batch, keys)
        if not told.isEmpty():
            publish(told, batch_id)

    return each


def drained(stream: DataFrame, sink: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run stream over all that is there, into a Parquet sink, and return the sink's rows (those of earlier runs as well)."""
    spark = stream.sparkSession
    sink, checkpoint = sink or new_path(spark, "sink"), checkpoint or new_path(spark, "progress")
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)
