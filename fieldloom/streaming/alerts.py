"""Stateful alerting and rate limits: a step function, its batch fold and its streaming form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step(prev: tuple[str, int] | None, status: str, now: int, cooldown: int) -> tuple[str | None, tuple[str, int]]:
    """(alert or None, next state). Entering crit alerts; staying there alerts again after the cooldown; leaving it says so once."""
    if status == "crit":
        if prev is None or prev[0] != "crit" or now - prev[1] >= cooldown:
            return "crit", ("crit", now)
        return None, prev
    return ("recovered" if prev is not None and prev[0] == "crit" else None), (status, now)


def alerts_by_key(samples: DataFrame, cooldown: int) -> DataFrame:
    """All alerts of a history: samples(key, run, ts, status), runs numbered from 0 in order.

    A key's samples stream in order through one task that holds one state. A key that a run
    doesn't have is forgotten, as is the state before. The first sample of a key in a run counts, other levels than ok, warn and crit don't.
    """
    s = samples.filter(F.col("status").isin("ok", "warn", "crit")).groupBy("key", "run").agg(F.min_by(F.struct("ts", "status"), "ts").alias("s"))
    rows = s.select("key", F.col("run").cast("long").alias("run"), F.col("s.ts").cast("long").alias("ts"), F.col("s.status").alias("status"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, prev = None, None
        for b in batches:
            kinds = []
            for key, n, ts, status in zip(*[c.to_pylist() for c in b.columns], strict=True):
                kind, state = step(prev if last == (key, n - 1) else None, status, ts, cooldown)
                last, prev = (key, n), state
                kinds.append(kind)
            kind = pa.array(kinds, pa.string())
            yield pa.RecordBatch.from_arrays([b["key"], b["ts"], kind], ["key", "ts", "kind"]).filter(kind.is_valid())

    key = rows.schema["key"].dataType.simpleString()
    return rows.repartition("key").sortWithinPartitions("key", "run").mapInArrow(run, f"key {key}, ts bigint, kind string")


def alert_stream(samples: DataFrame, cooldown: int) -> DataFrame:
    """Streaming form: samples(key, run, ts, status) -> (key, ts, kind); state is one row per key."""

    def update(key: tuple[str], batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        prev = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["run", "ts"], kind="stable")
        rows = rows[rows["status"].isin(["ok", "warn", "crit"])].drop_duplicates("run")
        out = []
        for r in rows.itertuples():
            known = (prev[1], prev[2]) if prev is not None and prev[0] == r.run - 1 else None
            kind, (status, at) = step(known, r.status, int(r.ts), cooldown)
            prev = (int(r.run), status, int(at))
            if kind:
                out.append((key[0], int(r.ts), kind))
        if prev is not None:
            state.update(prev)
        yield pd.DataFrame(out, columns=["key", "ts", "kind"])

    return samples.groupBy("key").applyInPandasWithState(update, "key string, ts bigint, kind string", "run bigint, status string, at bigint", "append", "NoTimeout")


def rate_limited(df: DataFrame, by: list[str], ts: str, order: str, window: int, most: int) -> DataFrame:
    """Rows let through by windows of `window` seconds that begin with the first row after the last one ended.

    Windows aren't aligned to the clock, so each key's times stream in order through one task that holds one window.
    """
    rows = df.select(*by, F.col(ts).cast("long").alias(ts), F.col(order).cast("long").alias(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begin, n = None, None, 0
        for b in batches:
            let = []
            for *key, now in zip(*[b[c].to_pylist() for c in [*by, ts]], strict=True):
                if key != last or begin is None or (now is not None and now - begin >= window):
                    last, begin, n = key, now, 0
                n += 1
                let.append(n <= most)
            yield b.filter(pa.array(let, pa.bool_()))

    return rows.repartition(*by).sortWithinPartitions(*by, ts, order).mapInArrow(run, rows.schema)


def stale(df: DataFrame, ts: str, now: Column, seconds: int) -> DataFrame:
    """newest, and whether it is older than so many seconds."""
    return df.agg(F.max(ts).alias("newest")).withColumn("stale", (now - F.col("newest")) > seconds)


def trailing(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Rows of the last so many seconds before the newest one."""
    return with_newest(df, ts, "_newest").filter(F.col(ts) >= F.col("_newest") - seconds).drop("_newest")


def with_newest(df: DataFrame, ts: str, name: str) -> DataFrame:
    """Each row with the newest time of all, found in parts and broadcast as one row."""
    return df.crossJoin(F.broadcast(df.agg(F.max(ts).alias(name))))
