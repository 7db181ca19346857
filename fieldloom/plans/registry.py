"""Where the modules of plans register their queries and the SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))


EV = "(SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"
