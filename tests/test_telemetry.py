"""Streams from files to sinks: killed and started again, with state that is forgotten, and published only where something changed."""

import json
import time

import pytest
from pyspark.sql import functions as F

from fieldloom.plans import catalog
from fieldloom.streaming import alerts, telemetry

ROWS = "key string, run long, seq long, ts long, status string"


def write_run(spark, folder, rows, n):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/in/run={n}")


def alert_query(spark, folder, idle=1000, late="0 seconds"):
    rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    return telemetry.alert_stream(rows, 100, idle, late)


def run_once(spark, folder, **how):
    stream = alert_query(spark, folder, **how).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
    query = stream.trigger(availableNow=True).start()
    query.awaitTermination()
    return query.recentProgress


def test_alerts_over_restarts_equal_the_batch(spark, tmp_path):
    """Each run arrives in a stream of its own, which starts from the checkpoint of the one before."""
    folder = f"file://{tmp_path}"
    steps = [("a", "ok"), ("a", "crit"), ("a", "crit"), ("a", "warn"), ("a", "crit")]
    history = []
    for n, (key, status) in enumerate(steps):
        ts = 1000 + n * 60
        rows = [(key, n, 1, ts, status), (key, n, 2, ts, "crit"), ("b", n, 1, ts, "crit"), ("none", n, 1, ts, None), ("odd", n, 1, ts, "panic")]
        if n != 2:
            rows.append(("gap", n, 1, ts, "crit"))  # absent for one run: alerts again
        history += rows
        write_run(spark, folder, rows, n)
        run_once(spark, folder)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").collect())
    batch = alerts.alerts_by_key(spark.createDataFrame([r for r in history if r[2] == 1], ROWS), 100)
    assert got == sorted(tuple(r) for r in batch.collect())
    assert ("b", 1000, "crit") in got and ("b", 1120, "crit") in got and ("b", 1060, "crit") not in got
    assert [k for key, _, k in got if key == "a"] == ["crit", "recovered", "crit"]
    assert [ts for key, ts, _ in got if key == "gap"] == [1000, 1180]


def test_killed_stream_goes_on(spark, tmp_path):
    """A stream that is stopped between batches, without a final one, loses and repeats nothing."""
    folder = f"file://{tmp_path}"
    history = [("k", n, 1, 1000 + 60 * n, "crit" if n % 3 else "ok") for n in range(8)]
    for row in history[:4]:
        write_run(spark, folder, [row], row[1])
        time.sleep(1.1)  # files are taken in order of their time
    writer = alert_query(spark, folder).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
    query = writer.start()
    until = time.time() + 60
    while time.time() < until and (query.lastProgress is None or query.lastProgress["batchId"] < 1):
        time.sleep(0.2)
    query.stop()
    for row in history[4:]:
        write_run(spark, folder, [row], row[1])
        time.sleep(1.1)
    run_once(spark, folder)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").collect())
    want = alerts.alerts_by_key(spark.createDataFrame(history, ROWS), 100)
    assert got == sorted(tuple(r) for r in want.collect())


def test_idle_keys_are_forgotten(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write_run(spark, folder, [(f"k{i}", 0, 1, 1000, "crit") for i in range(20)], 0)
    before = run_once(spark, folder)
    write_run(spark, folder, [("late", 9, 1, 9000, "ok")], 1)
    run_once(spark, folder)
    write_run(spark, folder, [("late", 10, 1, 9060, "ok")], 2)
    after = run_once(spark, folder)
    rows = lambda progress: max(s["numRowsTotal"] for p in progress for s in p["stateOperators"])
    assert rows(before) >= 20
    assert [p["stateOperators"][0]["numRowsTotal"] for p in after][-1] <= 3


def test_samples_and_beacons(spark, tmp_path):
    lines = [
        {"category": "db", "metric": "rows", "value": 3, "status": "ok"},
        {"category": "db", "metric": "rows", "value": "many", "scope": "eu", "recorded_at": 5},
        {"category": "db"},
        [1],
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join([json.dumps(x) for x in lines] + ["{broken", ""]))
    began = int(time.time())
    out = telemetry.drained(telemetry.samples(telemetry.read_lines(spark, f"file://{tmp_path}/in")).withColumn("key", telemetry.series_key()), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    rows = {r.key: r for r in out.collect()}
    assert set(rows) == {"db/rows", "db/rows/eu"}
    assert rows["db/rows"].recorded_at >= began and rows["db/rows/eu"].recorded_at == 5
    assert (rows["db/rows"].value, rows["db/rows/eu"].value) == (3.0, None)


def test_publisher_is_silent_without_changes(spark, tmp_path):
    folder, told = f"file://{tmp_path}", []
    state = {"rows": None}

    def publish(changes, batch_id):
        told.append((batch_id, sorted((r.k, r.v, r.kind) for r in changes.collect())))

    each = telemetry.publisher(["k"], lambda: state["rows"], publish)
    for rows in ([(1, "a"), (2, None)], [(1, "a"), (2, None)], [(1, "b"), (3, "c")]):
        batch = spark.createDataFrame(rows, "k long, v string")
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("k long, v string").parquet(f"{folder}/in")
        stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
        state["rows"] = batch
    assert told == [(0, [(1, "a", "added"), (2, None, "added")]), (2, [(1, "b", "changed"), (2, None, "removed"), (3, "c", "added")])]


@pytest.mark.parametrize("name", ["t04_alert_stream", "s16_beacon_stream"])
def test_stream_queries_have_sql(name):
    assert name in catalog.oracle_sql()
