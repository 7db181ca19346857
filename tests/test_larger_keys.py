"""Queries on keys and row counts beyond those of the test tables, against their SQL."""

import duckdb
from pyspark.sql import functions as F
from test_catalog import plain

from fieldloom.functions import hours, schedules
from fieldloom.plans import catalog


def same(spark, tmp_path, name, **tables):
    """Whether a query's rows are those of its SQL on these tables."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path / table}.parquet/*.parquet')")
    told = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    got = sorted(tuple(plain(v) for v in r) for r in catalog.queries()[name](spark, str(tmp_path)).select(*columns).collect())
    want = sorted(tuple(plain(v) for v in r) for r in told.fetchall())
    assert want
    return got == want


def test_formatted_of_large_users(spark, tmp_path):
    users = spark.range(20).selectExpr("id AS event_id", "CAST(CASE WHEN id < 10 THEN 4090 + id ELSE 1234560 + id END AS BIGINT) AS user_id")
    assert same(spark, tmp_path, "p24_formatted", events=users)


def test_hours_display_reads_a_day_once(spark):
    """Each day's text is computed once, however often its runs name it: before, it stood in the expression some hundred times."""
    assert str(hours.hours_text(F.col("week"))).count("by NOTAM") == 1


def test_weeks_read_fields_once(spark):
    """Fields and times are named once by the readers of hours; before, each stood in the expression several times and was read as often."""
    json, notation = str(schedules.document_week(F.col("j"))), str(schedules.notation_week(F.col("t"), F.col("lon")))
    assert json.count("$.startTime") == 1 and json.count("$.dayOfWeek") == 1
    assert notation.count("sunrise, dawn") + notation.count("IN (sunrise") <= 2


def test_texts_are_cut_once(spark):
    """No filter that Spark has moved below computes words again."""
    for name in ("p12_sections", "p13_items"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(text") == 1, name
