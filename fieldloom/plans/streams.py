"""Queries that run as streams over the tables, from files to a sink, and what is published of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import measures
from fieldloom.plans.registry import EV, query
from fieldloom.session import new_path, table
from fieldloom.streaming import telemetry

DAY = 86400
LEVEL = "CASE WHEN value >= 90 THEN 'crit' WHEN value >= 70 THEN 'warn' ELSE 'ok' END"


def _event_stream(s: SparkSession, d: str) -> DataFrame:
    files = f"{d}/events.parque[t]"  # a pattern fits one file as well as a folder of them; a plain path has to be a folder
    return s.readStream.schema(table(s, d, "events").schema).parquet(files).withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))


@query(f"""WITH RECURSIVE e AS (SELECT 'u' || user_id AS key, t // {DAY} AS n, arg_min(t, event_id) AS t, arg_min({LEVEL}, event_id) AS status FROM {EV} GROUP BY 1, 2),
           f AS (SELECT key, n, t, status, t AS at, CASE WHEN status = 'crit' THEN 'crit' END AS kind FROM e WHERE NOT EXISTS (SELECT 1 FROM e p WHERE p.key = e.key AND p.n = e.n - 1)
           UNION ALL SELECT e.key, e.n, e.t, e.status, CASE WHEN e.status = 'crit' AND f.status = 'crit' AND e.t - f.at < {2 * DAY} THEN f.at ELSE e.t END,
           CASE WHEN e.status = 'crit' AND (f.status <> 'crit' OR e.t - f.at >= {2 * DAY}) THEN 'crit' WHEN e.status <> 'crit' AND f.status = 'crit' THEN 'recovered' END FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
           SELECT key, t AS ts, kind FROM f WHERE kind IS NOT NULL""")
def t04_alert_stream(s: SparkSession, d: str) -> DataFrame:
    """Alerts of users' levels, a run a day: files to state to sink."""
    e = _event_stream(s, d)
    rows = e.select(F.concat(F.lit("u"), "user_id").alias("key"), F.floor(F.col("t") / DAY).alias("run"), F.col("event_id").alias("seq"), F.col("t").alias("ts"), measures.ladder(F.col("value"), 70, 90).alias("status"))
    return telemetry.drained(telemetry.alert_stream(rows, 2 * DAY))


@query("""SELECT '/p/' || event_id AS url, CASE WHEN event_id % 5 = 1 OR value * 50000 >= 3600000 THEN NULL ELSE floor(value * 50000 * 1000 + 0.5) / 1000 END AS lcp,
          CASE WHEN event_id % 3 = 0 THEN floor(value / 7 * 1000 + 0.5) / 1000 END AS cls, CASE WHEN event_id % 2 = 0 THEN repeat(event_type, 12)[:32] END AS nav, true AS stamped
          FROM events WHERE event_id % 7 > 0 AND event_id % 11 > 0 AND (event_id % 3 = 0 OR (event_id % 5 <> 1 AND value * 50000 < 3600000))""")
def s16_beacon_stream(s: SparkSession, d: str) -> DataFrame:
    """Beacons land as JSON lines, some broken or of another site; page views leave with the server's time, not the 1 that clients sent."""
    v, i = F.col("value"), F.col("event_id")
    lcp = F.when(i % 5 == 1, F.concat(F.lit('"'), v, F.lit('"'))).otherwise((v * 50000).cast("string"))
    cls = F.when(i % 3 == 0, (v / 7).cast("string")).otherwise("null")
    nav = F.when(i % 2 == 0, F.concat(F.lit('"'), F.repeat("event_type", 12), F.lit('"'))).otherwise("7")
    site = F.when(i % 7 > 0, "/p/").otherwise("http://x/p/")
    raw = F.concat(F.lit('{"recorded_at":1,"url":"'), site, "event_id", F.lit('","metrics":{"LCP":'), lcp, F.lit(',"CLS":'), cls, F.lit(',"X":1},"nav":'), nav, F.when(i % 11 > 0, "}").otherwise(""))
    landed = new_path(s, "beacons")
    table(s, d, "events").select(raw.alias("value")).write.text(landed)
    views = telemetry.drained(telemetry.analytics(telemetry.read_lines(s, landed)))
    return views.select("url", "lcp", "cls", "nav", (F.col("recorded_at") > 1_700_000_000).alias("stamped"))


@query("""SELECT 'web/' || event_type || CASE WHEN event_id % 3 > 0 THEN '/u' || user_id ELSE '' END AS key, count(*) AS n, count(value) FILTER (event_id % 4 > 0) AS numbers, count(*) FILTER (event_id % 5 > 0) AS stamped, min(CASE WHEN event_id % 5 = 0 THEN event_id END) AS oldest
          FROM events WHERE event_id % 13 > 0 GROUP BY 1""")
def t01_sample_stream(s: SparkSession, d: str) -> DataFrame:
    """Samples appended as they come: those without a time get that of their run; lines without a metric drop out, other types become null."""
    i = F.col("event_id")
    named = F.struct(
        F.lit("web").alias("category"), F.when(i % 13 > 0, F.col("event_type")).alias("metric"),
        F.when(i % 3 > 0, F.concat(F.lit("u"), "user_id")).otherwise("").alias("scope"), F.when(i % 5 == 0, i).alias("recorded_at"),
    )
    number = F.when(i % 4 > 0, F.col("value").cast("string")).otherwise('{"k":1}')  # one in four is an object
    raw = F.concat(F.rtrim(F.to_json(named), F.lit("}")), F.lit(',"value":'), number, F.lit("}"))
    landed = new_path(s, "samples")
    table(s, d, "events").select(raw.alias("value")).write.text(landed)
    kept = telemetry.drained(telemetry.samples(telemetry.read_lines(s, landed)).withColumn("key", telemetry.series_key()))
    old = F.col("recorded_at") < 1_700_000_000
    return kept.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("numbers"), F.count(F.when(~old, 1)).alias("stamped"), F.min(F.when(old, F.col("recorded_at"))).alias("oldest")
    )


@query("""WITH before AS (SELECT user_id, event_type, count(*) AS n, max(value) AS top FROM events WHERE event_id % 3 > 0 AND user_id % 10 <> 3 GROUP BY 1, 2),
          now AS (SELECT user_id, event_type, count(*) AS n, max(value) AS top FROM events WHERE (event_id % 3 > 0 OR user_id % 4 = 0) AND user_id % 10 <> 4 GROUP BY 1, 2)
          SELECT user_id, event_type, now.n, round(now.top, 6) AS top, CASE WHEN before.n IS NULL THEN 'added' WHEN now.n IS NULL THEN 'removed' ELSE 'changed' END AS kind
          FROM now FULL JOIN before USING (user_id, event_type) WHERE before.n IS DISTINCT FROM now.n OR before.top IS DISTINCT FROM now.top""")
def t08_published_changes(s: SparkSession, d: str) -> DataFrame:
    """What a publish would tell: series that are new, gone, or differ from what was last published."""
    e = table(s, d, "events")
    counted = lambda rows: rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    before = counted(e.filter("event_id % 3 > 0 and user_id % 10 <> 3"))
    now = counted(e.filter("(event_id % 3 > 0 or user_id % 4 = 0) and user_id % 10 <> 4"))
    return telemetry.changed(before, now, ["user_id", "event_type"]).withColumn("top", F.round("top", 6))
