"""Queries on walks over links between pages. Which pages link is made from their ids, circles included; what they are, from their html."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import walks
from fieldloom.plans.registry import query
from fieldloom.session import table

#: up to twelve targets a page, some of them the same or beyond the table
TARGET = "(page_id * (seq + 2) + seq * seq + 1) % 1009"


@query(f"""WITH RECURSIVE adj AS (SELECT page_id AS page, list(t ORDER BY seq, t) AS ts FROM (SELECT page_id, {TARGET} AS t, min(seq) AS seq FROM pages, range(12) r(seq) WHERE seq <= page_id % 12 GROUP BY 1, 2) GROUP BY 1),
           kinds AS (SELECT list(page_id) FILTER (page_id % 9 > 0) AS readable, list(page_id) FILTER (page_id % 9 > 0 AND length(html) % 23 = 0) AS wanted FROM pages),
           w AS (SELECT page_id AS start, page_id AS page, [page_id] AS seen, list_contains(wanted, page_id) AS found, 0 AS hops, 0 AS n, NOT list_contains(wanted, page_id) AS open FROM pages, kinds
             UNION ALL SELECT start, coalesce(hit, nxt), list_concat(seen, c), hit IS NOT NULL, hops + 1, n + 1, hit IS NULL
             FROM (SELECT *, list_filter(c, lambda x: list_contains(wanted, x))[1] AS hit, list_filter(c, lambda x: list_contains(readable, x))[1] AS nxt
               FROM (SELECT w.*, kinds.*, list_filter(ts, lambda x: NOT list_contains(seen, x))[:8] AS c FROM w JOIN adj ON adj.page = w.page, kinds WHERE open AND n < 3)) WHERE nxt IS NOT NULL)
           SELECT start, arg_max(page, n) AS page, arg_max(found, n) AS found, CAST(max(hops) AS INTEGER) AS hops FROM w GROUP BY start""")
def s18_frontier(s: SparkSession, d: str) -> DataFrame:
    """From every page: three hops, eight untried candidates a hop, to the first page of the wanted kind."""
    p = table(s, d, "pages")
    links = p.select("page_id", F.explode(F.sequence(F.lit(0), (F.col("page_id") % 12).cast("int"))).alias("seq")).select(F.col("page_id").alias("page"), "seq", F.expr(TARGET).alias("target"))
    known = p.filter("page_id % 9 > 0").select(F.col("page_id").alias("page"), (F.length("html") % 23 == 0).alias("wanted"))
    return walks.hunt(p.select(F.col("page_id").alias("start")), links, known)


@query("""WITH RECURSIVE ptr AS (SELECT page_id AS page, (page_id * 3 + 1) % 1009 AS target FROM pages WHERE length(html) % 3 > 0), w AS (SELECT page_id AS start, page_id AS page, 0 AS hops FROM pages
          UNION ALL SELECT start, target, hops + 1 FROM w JOIN ptr USING (page) WHERE hops < 4) SELECT start, arg_max(page, hops) AS page, max(hops) AS hops FROM w GROUP BY start""")
def s19_redirects(s: SparkSession, d: str) -> DataFrame:
    """Pages that only point on, followed four times at most; circles end there."""
    p = table(s, d, "pages")
    pointers = p.filter(F.length("html") % 3 > 0).select(F.col("page_id").alias("page"), ((F.col("page_id") * 3 + 1) % 1009).alias("target"))
    return walks.follow(p.select(F.col("page_id").alias("start")), pointers, 4)
