"""Named queries over the driver tables, each with the SQL that computes the same rows.

coordinates made from their keys, alike in both languages), telemetry by events, updates by orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import dates, measures, text
from fieldloom.operators import proximity, relational, upsert, windows
from fieldloom.plans.registry import EV, ORACLE, QUERIES, Query, events, query
from fieldloom.session import table
from fieldloom.streaming import alerts

# ---- series and telemetry


@query("""SELECT event_type, round(max_by(value, (ts, event_id)), 6) AS latest, count(value) AS n,
          round(quantile_cont(value, 0.75), 6) AS p75 FROM events GROUP BY event_type""")
def a03_series_latest(s: SparkSession, d: str) -> DataFrame:
    latest = F.max_by("value", F.struct("ts", "event_id"))
    return table(s, d, "events").groupBy("event_type").agg(F.round(latest, 6).alias("latest"), F.count("value").alias("n"), F.round(F.percentile("value", 0.75), 6).alias("p75"))


@query(f"""SELECT event_type, user_id, max(t) AS last_at, arg_max(event_id, (t, event_id)) AS event_id, round(min(v), 6) AS low, round(max(v), 6) AS high,
           count(v) AS n, string_agg(CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY t, event_id) FILTER (v IS NOT NULL) AS points
           FROM (SELECT *, nullif(value, round(value)) AS v FROM {EV}) GROUP BY event_type, user_id""")
def a03_series_points(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).withColumn("v", F.nullif("value", F.round("value"))).withColumn("id", F.col("event_id"))
    out = windows.series(e, ["event_type", "user_id"], "t", "event_id", "v", ["id"])
    points = F.nullif(F.array_join(F.transform("points", lambda v: F.round(v * 100).cast("bigint").cast("string")), ","), F.lit(""))
    return out.select("event_type", "user_id", "last_at", F.col("id").alias("event_id"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.col("n").cast("bigint").alias("n"), points.alias("points"))


STATUS = "CASE WHEN value >= 90 THEN 'crit' WHEN value >= 70 THEN 'warn' ELSE 'ok' END"


@query(f"""SELECT event_type, count(*) FILTER (st = 'crit') AS n_crit, count(*) FILTER (st = 'warn') AS n_warn, count(*) FILTER (st = 'ok') AS n_ok,
           CASE WHEN count(*) FILTER (st = 'crit') > 0 THEN 'crit' WHEN count(*) FILTER (st = 'warn') > 0 THEN 'warn' WHEN count(*) FILTER (st = 'ok') > 0 THEN 'ok' END AS worst,
           coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (st = 'crit'), '') AS crit_labels
           FROM (SELECT event_type, {STATUS} AS st, 'u' || CAST(user_id % 40 AS VARCHAR) AS label FROM events) GROUP BY event_type""")
def a04_roll_up(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_type", measures.ladder(F.col("value"), 70, 90).alias("st"), F.concat(F.lit("u"), F.col("user_id") % 40).alias("label"))
    return relational.roll_up(e, "st", "label", ["event_type"])


@query(f"SELECT max(t) AS newest, max(t) < 2000000000 - 2400 AS stale FROM {EV}")
def a05_newest(s: SparkSession, d: str) -> DataFrame:
    return alerts.stale(events(s, d), "t", F.lit(2_000_000_000), 2400)


@query("""SELECT event_type, sum(big) AS requests, sum(small) AS cached, round(CASE WHEN sum(big) > 0 THEN sum(small) / sum(big) END, 4) AS ratio
          FROM (SELECT event_type, CASE WHEN value >= 50 THEN value END AS big, CASE WHEN value < 0 THEN value END AS small FROM events) GROUP BY event_type""")
def a06_absent_sums(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_type", F.when(F.col("value") >= 50, F.col("value")).alias("big"), F.when(F.col("value") < 0, F.col("value")).alias("small"))
    big, small = F.sum("big"), F.sum("small")
    return e.groupBy("event_type").agg(big.alias("requests"), small.alias("cached"), F.round(F.when(big > 0, small / big), 4).alias("ratio"))


@query("""SELECT user_id, n, errors, round(errors / n, 5) AS rate, CASE WHEN errors / n >= 0.3 THEN 'crit' WHEN errors / n >= 0.2 THEN 'warn' ELSE 'ok' END AS level
          FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id)""")
def a07_error_rate(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    rate = F.col("errors") / F.col("n")
    return g.select("user_id", "n", "errors", F.round(rate, 5).alias("rate"), measures.ladder(rate, 0.2, 0.3).alias("level"))


@query("""SELECT event_type, metric, round(v, 4) AS value FROM (UNPIVOT (SELECT event_type, sum(value) AS total, max(value) AS most, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY event_type)
          ON total, most, n INTO NAME metric VALUE v)""")
def a08_unpivot(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "events").groupBy("event_type").agg(F.sum("value").alias("total"), F.max("value").alias("most"), F.count(F.lit(1)).cast("double").alias("n"))
    return g.unpivot("event_type", ["total", "most", "n"], "metric", "v").select("event_type", "metric", F.round("v", 4).alias("value"))


@query("""SELECT user_id % 20 AS page, round(quantile_cont(value, 0.75), 6) AS p75, CASE WHEN quantile_cont(value, 0.75) >= 75 THEN 'crit' WHEN quantile_cont(value, 0.75) >= 70 THEN 'warn' ELSE 'ok' END AS level
          FROM events GROUP BY 1""")
def a09_p75(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "events").groupBy((F.col("user_id") % 20).alias("page")).agg(F.percentile("value", 0.75).alias("p"))
    return g.select("page", F.round("p", 6).alias("p75"), measures.ladder(F.col("p"), 70, 75).alias("level"))


@query("""SELECT c_nationkey, CASE WHEN c_nationkey % 7 = 0 THEN 0 ELSE n END AS "with", total, CASE WHEN c_nationkey % 7 = 0 OR n = 0 THEN 'none' WHEN n = total THEN 'full' ELSE 'partial' END AS bucket
          FROM (SELECT c_nationkey, count(*) FILTER (c_acctbal > 0) AS n, count(*) AS total FROM customer GROUP BY 1)""")
def a10_coverage(s: SparkSession, d: str) -> DataFrame:
    return relational.coverage(table(s, d, "customer"), ["c_nationkey"], F.col("c_acctbal") > 0, F.col("c_nationkey") % 7 == 0)


@query("""SELECT n.k AS c_nationkey, n.n, l.n AS last, CASE WHEN l.n IS NULL OR l.n = 0 THEN 'pass' WHEN n.n < l.n * 0.5 THEN 'block' WHEN n.n < l.n * 0.85 THEN 'warn' ELSE 'pass' END AS verdict
          FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) n LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_custkey % (c_nationkey + 1) < 20 AND c_nationkey <> 3 GROUP BY 1) l ON n.k = l.k""")
def a12_count_guard(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    last = c.filter((F.col("c_custkey") % (F.col("c_nationkey") + 1) < 20) & (F.col("c_nationkey") != 3)).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return relational.count_guard(c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")), last, ["c_nationkey"])


@query("""SELECT p_brand, count(*) AS n, count(*) - count(DISTINCT p_size) AS duplicates, count(*) FILTER (p_size > 45) AS bad_size, round(avg(CASE WHEN p_type LIKE '%STEEL%' THEN 1.0 ELSE 0.0 END), 6) AS bad_share FROM part GROUP BY 1""")
def a13_quality_report(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    p = table(s, d, "part").withColumn("again", F.row_number().over(w) > 1)
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if("again").alias("duplicates"), F.count_if(F.col("p_size") > 45).alias("bad_size"), F.round(F.avg(F.col("p_type").contains("STEEL").cast("double")), 6).alias("bad_share"))


@query("""SELECT o_orderstatus, count(*) FILTER (o_totalprice > 100000) AS running, count(*) FILTER (o_totalprice > 150000) AS unhealthy, count(*) FILTER (o_orderpriority LIKE '1%') AS stopped FROM orders GROUP BY 1""")
def a15_overlapping_buckets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 100000).alias("running"), F.count_if(F.col("o_totalprice") > 150000).alias("unhealthy"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("stopped"))


@query("""SELECT c_nationkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, seen) AS r FROM
          (SELECT c_nationkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS seen FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)) WHERE r = 1""")
def a02_mode_first(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return relational.mode_first(j, ["c_nationkey"], "o_orderpriority", "o_orderkey")


@query("""SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_acctbal, c_custkey) AS children FROM customer WHERE c_acctbal > 5000 GROUP BY 1""")
def a19_children(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").filter("c_acctbal > 5000").withColumn("k", F.struct("c_acctbal", "c_custkey"))
    g = relational.gather(c, ["c_nationkey"], ["c_custkey"], "k", "items")
    return g.select("c_nationkey", F.array_join(F.transform("items", lambda x: x["c_custkey"].cast("string")), ",").alias("children"))


@query("""SELECT category, n, first_p_name, place FROM (SELECT split_part(p_type, ' ', 1) AS category, count(*) AS n, min(p_name) AS first_p_name FROM part GROUP BY 1)
          JOIN (VALUES ('PROMO', 1), ('ECONOMY', 2), ('STANDARD', 3), ('SMALL', 4)) v(c, place) ON category = c""")
def a21_by_category(s: SparkSession, d: str) -> DataFrame:
    return relational.by_category(table(s, d, "part"), F.split("p_type", " ")[0], ["PROMO", "ECONOMY", "STANDARD", "SMALL"], "p_name")


@query("""SELECT user_id, coalesce(sum(CASE WHEN value > 95 THEN value END), 0) AS bytes FROM events GROUP BY 1""")
def a24_sum_or_zero(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("value") > 95, F.col("value"))), F.lit(0.0)).alias("bytes"))


@query("""SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1""")
def a26_partition_by_type(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


# ---- filters, search and limits

@query("""SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'""")
def f01_conjunction(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").filter(relational.conjunction([F.col("c_nationkey") == 7, F.col("c_mktsegment") == "building".upper(), None])).select("c_custkey", "c_name")


@query("""SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'machinery'""")
def f02_no_case(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").filter(F.lower("c_mktsegment") == "MACHINERY".lower()).select("c_custkey")


@query("""SELECT p_partkey, p_name, p_type FROM part WHERE p_type ILIKE '%ring%' OR p_name ILIKE '%ring%' ORDER BY p_name, p_partkey LIMIT 5""")
def f03_search(s: SparkSession, d: str) -> DataFrame:
    hits = relational.search(table(s, d, "part").withColumn("k", F.struct("p_name", "p_partkey")), "rING", ["p_type", "p_name"], 5, "k")
    return hits.select("p_partkey", "p_name", "p_type")


@query("""SELECT p_partkey, p_type FROM part WHERE (p_type ILIKE '%br%1%' OR p_brand ILIKE '%br%1%') AND p_size < 10 ORDER BY p_partkey LIMIT 8""")
def f04_scoped_search(s: SparkSession, d: str) -> DataFrame:
    return relational.search(table(s, d, "part"), "br%1", ["p_type", "p_brand"], 8, "p_partkey", F.col("p_size") < 10).select("p_partkey", "p_type")


@query("""SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 910 AND 950""")
def f05_box(s: SparkSession, d: str) -> DataFrame:
    return relational.box(table(s, d, "part"), "p_size", "p_retailprice", 10, 20, 910, 950).select("p_partkey")


@query("""SELECT doc_id, quality IS NULL AS unknown FROM (SELECT doc_id, nullif(quality, 1) AS quality FROM labels)""")
def f06_nulls(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "labels").select("doc_id", F.nullif("quality", F.lit(1)).isNull().alias("unknown"))


@query(f"""SELECT event_id, t FROM {EV} WHERE event_type = 'error' AND value >= 50 ORDER BY t DESC, event_id DESC LIMIT 200""")
def f07_optional_conjuncts(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).filter(relational.conjunction([F.col("event_type") == "error", None, F.col("value") >= 50]))
    return e.orderBy(F.desc("t"), F.desc("event_id")).limit(relational.clamped_limit(200)).select("event_id", "t")


@query("""SELECT doc_id, lang, source, n_chars FROM documents""")
def f08_drop_column(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").drop("text")


@query("""SELECT doc_id FROM labels WHERE CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality = 1 END AND toxic = 0""")
def f12_known_true(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "labels").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return relational.known_true(l, ["a", "b"]).select("doc_id")


@query("""SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('FRANCE', 'GERMANY', 'JAPAN') OR n_nationkey IN (1, 2)""")
def f11_membership(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").filter(F.col("n_name").isin("FRANCE", "GERMANY", "JAPAN") | F.col("n_nationkey").isin(1, 2))
    return table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@query("""SELECT code, regexp_matches(code, '^[A-Z]{4}$') AS ingest, regexp_matches(code, '^[A-Z0-9]{4}$') AS api, regexp_matches(code, '^[A-Z]{2,4}$') AS contact
          FROM (SELECT DISTINCT upper(substr(p_name, 1, 1 + CAST(p_partkey % 5 AS INTEGER))) AS code FROM part)""")
def f16_code_guards(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "part").select(F.upper(F.substring(F.col("p_name"), F.lit(1), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("code")).distinct()
    return c.select("code", text.code_guards(F.col("code")).alias("g")).select("code", "g.*")


@query("""SELECT p_name, p_partkey FROM part ORDER BY p_name, p_partkey""")
def o01_order_by_title(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_name", "p_partkey").orderBy("p_name", "p_partkey")


# ---- joins

@query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal IS NOT NULL AND o_totalprice > 200000""")
def j01_inner(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").filter("o_totalprice > 200000").join(table(s, d, "customer").filter("c_acctbal is not null"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("""SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))""")
def j03_without_row(s: SparkSession, d: str) -> DataFrame:
    return relational.missing(table(s, d, "documents"), table(s, d, "labels"), "doc_id", ["lang", "source"], "n_chars")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE nullif(quality, 0) IS NOT NULL)""")
def j04_without_value(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "labels").withColumn("quality", F.nullif("quality", F.lit(0)))
    return relational.without_value(table(s, d, "documents"), l, "doc_id", "quality").select("doc_id")


@query("""SELECT s_suppkey, coalesce(CASE WHEN n_regionkey = 1 THEN 'x' || s_name END, s_name) AS s_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def j06_override(s: SparkSession, d: str) -> DataFrame:
    base = table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    over = base.join(table(s, d, "nation").filter("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("x"), "s_name").alias("s_name"))
    return relational.override(base, over, "s_suppkey", ["s_name"]).select("s_suppkey", "s_name")


@query("""SELECT k, coalesce(a.v, b.v, c.v) AS v, coalesce(a.w, b.w, c.w) AS w, concat_ws('+', CASE WHEN a.hit THEN 'stored' END, CASE WHEN b.hit THEN 'community' END, CASE WHEN c.hit THEN 'service' END) AS source
          FROM (SELECT c_custkey AS k, nullif(c_acctbal, abs(c_acctbal)) AS v, c_name AS w, true AS hit FROM customer WHERE c_custkey % 2 = 0) a
          FULL JOIN (SELECT c_custkey AS k, c_acctbal AS v, CASE WHEN c_custkey % 4 = 1 THEN 'b' END AS w, true AS hit FROM customer WHERE c_custkey % 3 = 0) b USING (k)
          FULL JOIN (SELECT c_custkey AS k, CAST(c_nationkey AS DOUBLE) AS v, c_mktsegment AS w, true AS hit FROM customer WHERE c_custkey % 5 = 0) c USING (k)""")
def j07_precedence(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").withColumn("k", F.col("c_custkey"))
    a = c.filter("k % 2 = 0").select("k", F.nullif("c_acctbal", F.abs("c_acctbal")).alias("v"), F.col("c_name").alias("w"))
    b = c.filter("k % 3 = 0").select("k", F.col("c_acctbal").alias("v"), F.when(F.col("k") % 4 == 1, "b").alias("w"))
    e = c.filter("k % 5 = 0").select("k", F.col("c_nationkey").cast("double").alias("v"), F.col("c_mktsegment").alias("w"))
    return relational.precedence_merge([("stored", a), ("community", b), ("service", e)], "k", ["v", "w"])


@query("""SELECT k, change FROM (SELECT c_custkey AS k, 'added' AS change FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0 UNION ALL SELECT c_custkey, 'removed' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0)""")
def j08_snapshot_diff(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    return relational.symmetric_difference(k.filter("k % 2 = 0"), k.filter("k % 3 = 0"), "k")


@query("""SELECT o_custkey, coalesce(max_by(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderdate <= TIMESTAMP '1995-01-01'), min_by(o_orderkey, (o_orderdate, o_orderkey))) AS o_orderkey FROM orders GROUP BY 1""")
def j11_as_of(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return relational.as_of(o, ["o_custkey"], "at", "o_orderkey", F.struct(F.lit("1995-01-01").cast("timestamp_ntz").cast(o.schema["o_orderdate"].dataType).alias("o_orderdate"), F.lit(2**62).alias("o_orderkey"))).select("o_custkey", "o_orderkey")


@query("""SELECT k, v FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0)
          UNION ALL SELECT k, v FROM (SELECT CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE c_custkey END AS k, -c_acctbal AS v FROM customer WHERE c_custkey % 3 = 0) b WHERE k IS NULL OR k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 10 <> 0)""")
def j14_add_if_absent(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    a = c.filter("c_custkey % 2 = 0").select(F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("k"), F.col("c_acctbal").alias("v"))
    b = c.filter("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 15 != 0, F.col("c_custkey")).alias("k"), (-F.col("c_acctbal")).alias("v"))
    return relational.add_if_absent(a, b, "k")


@query("""SELECT r_name, n_name, path FROM (SELECT r_name, n_name FROM region, nation WHERE r_regionkey < 3) CROSS JOIN (VALUES ('a'), ('b')) v(path)""")
def j16_expansion(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "region").filter("r_regionkey < 3").select("r_name")
    return r.crossJoin(table(s, d, "nation").select("n_name")).withColumn("path", F.explode(F.array(F.lit("a"), F.lit("b"))))


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def j19_exists(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").filter("o_totalprice > 300000").select(F.sha2(F.col("o_custkey").cast("string"), 256).alias("h"))
    return table(s, d, "customer").join(o, F.sha2(F.col("c_custkey").cast("string"), 256) == F.col("h"), "left_semi").select("c_custkey")


@query("""SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS o_orderpriority FROM orders GROUP BY 1""")
def j21_newest(s: SparkSession, d: str) -> DataFrame:
    return relational.newest(table(s, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderpriority")


@query("""SELECT o_custkey, coalesce(arg_min(o_orderkey, o_orderkey) FILTER (o_orderpriority LIKE '%URGENT%'), min(o_orderkey)) AS v FROM orders GROUP BY 1""")
def j22_labelled_pick(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").withColumn("v", F.col("o_orderkey"))
    return relational.labelled_or_first(o, ["o_custkey"], F.col("o_orderpriority").contains("URGENT"), "v", "o_orderkey")


LAT, LON = "({k} * 37 % 1400) / 10.0 - 70", "({k} * 91 % 3600) / 10.0 - 180"
HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
SITES = f"(SELECT c_custkey AS site, CAST({LAT.format(k='c_custkey')} AS DOUBLE) AS lat, CAST({LON.format(k='c_custkey')} AS DOUBLE) AS lon FROM customer)"
PROBES = f"(SELECT s_suppkey AS id, CAST({LAT.format(k='s_suppkey')} AS DOUBLE) + 0.3 AS lat, CAST({LON.format(k='s_suppkey')} AS DOUBLE) + 0.2 AS lon FROM supplier)"
PAIRS = f"(SELECT id, site, {HAV} AS km FROM {PROBES} a JOIN {SITES} b ON b.lat BETWEEN a.lat - 300 / 111.0 AND a.lat + 300 / 111.0 AND b.lon BETWEEN a.lon - 300 / 111.0 / greatest(cos(radians(a.lat)), 0.2) AND a.lon + 300 / 111.0 / greatest(cos(radians(a.lat)), 0.2))"


def _sites(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def at(key: str) -> list:
        return [(F.col(key) * 37 % 1400 / 10.0 - 70).alias("lat"), (F.col(key) * 91 % 3600 / 10.0 - 180).alias("lon")]

    sites = table(s, d, "customer").select(F.col("c_custkey").alias("site"), *at("c_custkey"))
    probes = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), *at("s_suppkey")).withColumn("lat", F.col("lat") + 0.3).withColumn("lon", F.col("lon") + 0.2)
    return probes, sites


@query(f"SELECT id, site, round(km, 6) AS km FROM {PAIRS}")
def j02_box_join(s: SparkSession, d: str) -> DataFrame:
    return proximity.within_box(*_sites(s, d), "id", "site", 300).select("id", "site", F.round("km", 6).alias("km"))


@query(f"SELECT id, site, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, site) AS r FROM {PAIRS}) WHERE r = 1")
def j09_nearest(s: SparkSession, d: str) -> DataFrame:
    return proximity.nearest(*_sites(s, d), "id", "site", 300).select("id", "site", F.round("km", 6).alias("km"))


@query(f"SELECT id, site, rank, round(km, 6) AS km FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY km, site) AS INTEGER) AS rank FROM {PAIRS} WHERE km <= 300 AND site <> id) WHERE rank <= 4")
def j10_k_nearest(s: SparkSession, d: str) -> DataFrame:
    return proximity.k_nearest(*_sites(s, d), "id", "site", 4, 300).select("id", "site", "rank", F.round("km", 6).alias("km"))


# ---- windows

@query(f"""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t DESC, event_id DESC) AS r FROM {EV}) WHERE r = 1""")
def w01_latest(s: SparkSession, d: str) -> DataFrame:
    return windows.latest(events(s, d), ["user_id", "event_type"], [F.desc("t"), F.desc("event_id")]).select("event_id", "user_id", "event_type")


@query("""SELECT event_id, k FROM (SELECT event_id, k, row_number() OVER (PARTITION BY k ORDER BY event_id) AS r FROM (SELECT event_id, nullif(user_id % 50, 7) AS k FROM events)) WHERE r = 1 OR k IS NULL""")
def w02_first_per_key(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", F.nullif(F.col("user_id") % 50, F.lit(7)).alias("k"))
    return windows.first_per_key(e, "k", "event_id")


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY upper(coalesce(CAST(nullif(user_id % 50, 7) AS VARCHAR), event_type)) ORDER BY event_id) AS r FROM events) WHERE r = 1""")
def w13_first_per_identity(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "event_type", F.nullif(F.col("user_id") % 50, F.lit(7)).alias("k"))
    return windows.first_per_identity(e, ["k", "event_type"], "event_id").select("event_id")


@query(f"""SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, CAST(min(pos) AS INTEGER) AS first_at, CAST(max(pos) AS INTEGER) AS last_at, count(*) AS length FROM
           (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM
           (SELECT *, row_number() OVER w AS pos, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))) GROUP BY user_id, run""")
def w03_islands(s: SparkSession, d: str) -> DataFrame:
    return windows.islands(events(s, d), ["user_id"], ["t", "event_id"], "event_type")


@query("""SELECT conv_id, turn, (SELECT count(*) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn) AS before FROM conversations a""")
def w12_steps(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations")
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    x = windows.steps(c.withColumn("n", n), ["conv_id"], ["turn"])
    return x.select("conv_id", "turn", F.round(F.col("x") * F.greatest(F.col("n") - 1, F.lit(1))).cast("bigint").alias("before"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations""")
def w05_carried(s: SparkSession, d: str) -> DataFrame:
    return windows.carried(table(s, d, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "heading").select("conv_id", "turn", "heading")


@query("""SELECT conv_id, turn FROM (SELECT *, max(CASE WHEN length(text) > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM conversations) WHERE stop = 0""")
def w06_until(s: SparkSession, d: str) -> DataFrame:
    return windows.until(table(s, d, "conversations"), ["conv_id"], ["turn"], F.length("text") > 400).select("conv_id", "turn")


@query(f"""SELECT user_id, event_type, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM
           (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM {EV}) WHERE r = 1) WHERE rank <= 2""")
def w07_distinct_then_top(s: SparkSession, d: str) -> DataFrame:
    return windows.distinct_then_top(events(s, d), ["user_id"], "event_type", [F.desc("value"), F.col("event_id").asc()], 2).select("user_id", "event_type", "rank")


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 50""")
def w08_capped(s: SparkSession, d: str) -> DataFrame:
    return windows.capped(table(s, d, "documents"), ["source"], ["doc_id"], 50).select("doc_id")


@query("""SELECT doc_id, CAST(kept AS BIGINT) AS kept_size FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM documents) WHERE kept <= 30000""")
def w09_evict(s: SparkSession, d: str) -> DataFrame:
    return windows.keep_newest_until(table(s, d, "documents"), ["source"], [F.desc("doc_id")], "n_chars", 30000).select("doc_id", "kept_size")


@query(f"""SELECT event_id, previous FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS previous FROM {EV}) WHERE previous IS NOT NULL AND previous <> event_type""")
def w10_transitions(s: SparkSession, d: str) -> DataFrame:
    return windows.transitions(events(s, d), ["user_id"], ["t", "event_id"], "event_type").select("event_id", "previous")


@query("""SELECT event_id, round(CASE WHEN hi = lo THEN 0.5 ELSE (value - lo) / (hi - lo) END, 6) AS y FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id, event_type))""")
def w11_normalised(s: SparkSession, d: str) -> DataFrame:
    return windows.normalised(table(s, d, "events"), ["user_id", "event_type"], "value").select("event_id", F.round("y", 6).alias("y"))


@query("""SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 99) AS until FROM conversations""")
def w04_sections(s: SparkSession, d: str) -> DataFrame:
    return windows.sections(table(s, d, "conversations").withColumn("end", F.lit(99).cast("bigint")), ["conv_id"], "turn", "end").select("conv_id", "turn", "until")


@query("""SELECT user_id, arg_min(v, event_id) FILTER (v IS NOT NULL) AS v FROM (SELECT user_id, event_id, CASE WHEN value > 60 THEN value END AS v FROM events) GROUP BY 1""")
def w14_first_known(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("v", F.when(F.col("value") > 60, F.col("value")))
    return e.groupBy("user_id").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("event_id"))).alias("v"))


@query("""SELECT source, arg_min(doc_id, (CASE WHEN lang = 'de' THEN 0 WHEN lang = 'fr' THEN 1 ELSE 2 END, doc_id)) AS doc_id, CAST(min(CASE WHEN lang = 'de' THEN 0 WHEN lang = 'fr' THEN 1 ELSE 2 END) AS INTEGER) AS rank FROM documents GROUP BY 1""")
def o09_priority_pick(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").withColumn("seq", F.col("doc_id"))
    return relational.priority_pick(docs, ["source"], [F.col("lang") == "de", F.col("lang") == "fr"], "doc_id", "seq")


@query("""SELECT a.doc_id FROM documents a JOIN (SELECT source, min(CASE lang WHEN 'es' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END) AS m FROM documents GROUP BY 1) b ON a.source = b.source AND CASE lang WHEN 'es' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END = m""")
def s20_first_that_yields(s: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("lang") == "es", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    return relational.first_that_yields(table(s, d, "documents").withColumn("candidate", rank), ["source"], "candidate").select("doc_id")


# ---- sets

@query("""SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey FROM orders""")
def x01_bag_union(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")).unionByName(table(s, d, "orders").select(F.col("o_custkey").alias("k")))


@query("""SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000""")
def x03_difference(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(s, d, "orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("k")))


@query("""SELECT o_orderpriority, min(o_orderkey) AS seen FROM orders GROUP BY 1""")
def x04_distinct_first_seen(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("seen"))


@query("""SELECT p_partkey, len(list_filter(string_split('small plated copper brass', ' '), lambda w: NOT list_contains(string_split(lower(p_type), ' '), w))) = 0 AS all_in,
          list_has_all(string_split('promo standard economy small medium large plated brushed anodized burnished polished tin nickel brass steel copper', ' '), string_split(lower(p_type), ' ')) AS within FROM part""")
def x05_word_subset(s: SparkSession, d: str) -> DataFrame:
    known = F.lit("promo standard economy small medium large plated brushed anodized burnished polished tin nickel brass steel copper")
    return table(s, d, "part").select("p_partkey", relational.word_subset(F.lit("small plated copper brass"), F.col("p_type")).alias("all_in"), relational.word_subset(F.col("p_type"), known).alias("within"))


# ---- keyed writes as folds

UPD = """SELECT o_custkey AS k, o_orderkey AS seq, o_totalprice AS price, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS note, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderpriority END AS hours,
         CASE o_orderkey % 6 WHEN 0 THEN 'eaip' WHEN 1 THEN 'dfs-ocr-hours' WHEN 2 THEN 'pdf-ocr-hours' WHEN 3 THEN 'openaip' WHEN 4 THEN 'osm' END AS src FROM orders"""
STO = """SELECT c_custkey AS k, -1 AS seq, c_acctbal AS price, NULL AS note, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS hours, CASE c_custkey % 4 WHEN 0 THEN 'pdf-ocr-hours' WHEN 1 THEN 'openaip' WHEN 2 THEN 'osm' END AS src
         FROM customer WHERE c_custkey % 3 = 0"""


# a row is taken if the pair that stands has no source or one that doesn't outrank it: what stands never loses rank, so it's the base's rank that counts
@query(f"""WITH r AS (SELECT *, CASE src WHEN 'eaip' THEN 4 WHEN 'dfs-ocr-hours' THEN 3 WHEN 'pdf-ocr-hours' THEN 3 WHEN 'openaip' THEN 2 WHEN 'osm' THEN 1 ELSE 0 END AS rank, row_number() OVER (PARTITION BY k ORDER BY seq) AS n FROM ({STO} UNION ALL {UPD})),
           b AS (SELECT k, src AS base_src, rank AS base_rank FROM r WHERE n = 1),
           g AS (SELECT k, arg_max(price, seq) AS price, arg_max(note, seq) FILTER (note IS NOT NULL) AS note FROM r GROUP BY k),
           h AS (SELECT k, hours, src FROM (SELECT r.*, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN n = 1 AND src IS NULL THEN -1 ELSE rank END DESC, seq DESC) AS best
                 FROM r JOIN b USING (k) WHERE n = 1 OR (hours IS NOT NULL AND (base_src IS NULL OR rank >= base_rank))) WHERE best = 1)
           SELECT g.k, price, note, hours, src FROM g JOIN h USING (k)""")
def k02_upsert_fold(s: SparkSession, d: str) -> DataFrame:
    o, c = table(s, d, "orders"), table(s, d, "customer")
    src = F.get(F.array(*[F.lit(x) for x in ("eaip", "dfs-ocr-hours", "pdf-ocr-hours", "openaip", "osm", None)]), (F.col("o_orderkey") % 6).cast("int"))
    own = F.get(F.array(*[F.lit(x) for x in ("pdf-ocr-hours", "openaip", "osm", None)]), (F.col("c_custkey") % 4).cast("int"))
    updates = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("note"), F.when(F.col("o_orderkey") % 4 != 1, F.col("o_orderpriority")).alias("hours"), src.alias("src"))
    stored = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("price"), F.lit(None).cast("string").alias("note"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("hours"), own.alias("src"))
    return upsert.fold_upserts(stored, updates, "k", "seq", ["price"], ["note"], "hours", "src", measures.source_rank(F.col("src")))


@query("""SELECT coalesce(c_custkey, o_custkey) AS k, coalesce(hours, c_mktsegment) AS hours, c_name AS name FROM customer c FULL JOIN
          (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) FILTER (o_totalprice > 100000) AS hours FROM orders GROUP BY 1) o ON c_custkey = o_custkey""")
def k04_patch(s: SparkSession, d: str) -> DataFrame:
    stored = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("hours"), F.col("c_name").alias("name"))
    updates = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("hours"))
    return upsert.patch(stored, updates, "k", "seq", ["hours"])


@query("""WITH incoming AS (SELECT s_suppkey, s_nationkey, s_acctbal * 2 AS bal FROM supplier WHERE s_nationkey % 2 = 0 AND s_acctbal > 5000)
          SELECT s_suppkey, s_nationkey, s_acctbal AS bal FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.s_nationkey = s.s_nationkey) UNION ALL SELECT * FROM incoming""")
def k01_replace(s: SparkSession, d: str) -> DataFrame:
    """Groups that the batch holds are replaced whole; those without incoming rows stay as they were."""
    stored = table(s, d, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("bal"))
    incoming = stored.filter("s_nationkey % 2 = 0 and bal > 5000").withColumn("bal", F.col("bal") * 2)
    return upsert.replace_by_key(stored, incoming, "s_nationkey")


@query("""SELECT o_custkey, arg_max(p, o_orderkey) AS p FROM (SELECT o_custkey, o_orderkey, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END, '-') AS p FROM orders) GROUP BY 1""")
def k08_last_write(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").withColumn("p", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")))
    return upsert.last_write(o, "o_custkey", "o_orderkey", ["p"]).withColumn("p", F.coalesce("p", F.lit("-")))


@query(f"SELECT event_id FROM {EV} WHERE t >= (SELECT max(t) FROM {EV}) - 86400")
def k07_retain(s: SparkSession, d: str) -> DataFrame:
    return alerts.trailing(events(s, d), "t", 86400).select("event_id")


@query("""SELECT n_nationkey, string_agg(s_name, ', ' ORDER BY s_name) AS line FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def k13_text_index(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), ", ").alias("line"))


# ---- dates and numbers

DAY = "CAST(o_orderdate AS DATE)"
CYC = f"(DATE '2026-07-09' + CAST(floor(date_diff('day', DATE '2026-07-09', {DAY}) / 28.0) AS INTEGER) * 28)"
INW = f"((date_diff('day', DATE '2026-07-09', {DAY}) % 28) + 28) % 28 <= 2"


@query(f"""SELECT o_orderkey, CAST({CYC} AS VARCHAR) AS cycle, CAST({CYC} + 28 AS VARCHAR) AS next, {INW} AS inside,
           CASE WHEN {INW} THEN 'window' WHEN isodow({DAY}) = 7 THEN 'weekly' ELSE 'skip' END AS reason, CAST({CYC} - 56 AS VARCHAR) AS third FROM orders""")
def d01_cycles(s: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    third = F.element_at(dates.recent_cycles(day, 3), 3)
    return table(s, d, "orders").select("o_orderkey", dates.current_cycle(day).cast("string").alias("cycle"), dates.next_cycle(day).cast("string").alias("next"), dates.in_change_window(day).alias("inside"), dates.crawl_day(day)["reason"].alias("reason"), third.cast("string").alias("third"))


@query("""SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute, printf('%02d:%02d', hour(ts), minute(ts)) AS clock FROM events""")
def d06_weekday_minute(s: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(s, d, "events").select("event_id", dates.utc_weekday(ts).alias("dow"), dates.utc_minute(ts).alias("minute"), dates.clock_text(dates.utc_minute(ts)).alias("clock"))


@query(f"""SELECT event_id, CASE WHEN a IS NULL THEN '-' WHEN a < 60 THEN 'gerade eben' WHEN a < 3600 THEN 'vor ' || (a // 60) || ' min' WHEN a < 86400 THEN 'vor ' || (a // 3600) || ' h' ELSE 'vor ' || (a // 86400) || ' d' END AS age
           FROM (SELECT event_id, CASE WHEN event_id % 50 > 0 THEN greatest(0, (SELECT max(t) FROM {EV}) - t - 100) END AS a FROM {EV})""")
def d12_age(s: SparkSession, d: str) -> DataFrame:
    return alerts.with_newest(events(s, d), "t", "newest").select("event_id", dates.age_text(F.when(F.col("event_id") % 50 > 0, F.col("newest") - F.col("t") - 100)).alias("age"))


@query("""SELECT k, CAST(try_strptime(printf('%04d-%02d-%02d', 2000 + k % 30, k % 14, k % 33), '%Y-%m-%d') AS DATE)::VARCHAR AS day FROM (SELECT CAST(p_partkey AS INTEGER) AS k FROM part)""")
def d17_edition_day(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.cast("int").alias("k"), dates.edition_day(k % 33, k % 14, k % 30).cast("string").alias("day"))


@query(f"""SELECT id, site, round({HAV}, 6) AS km, round(300 / 111.0 / greatest(cos(radians(a.lat)), 0.2), 6) AS half FROM {PROBES} a JOIN {SITES} b ON id = site""")
def m01_haversine(s: SparkSession, d: str) -> DataFrame:
    probes, sites = _sites(s, d)
    j = probes.join(sites.select("site", F.col("lat").alias("slat"), F.col("lon").alias("slon")), F.col("id") == F.col("site"))
    return j.select("id", "site", F.round(measures.haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")), 6).alias("km"), F.round(measures.box_half_widths(F.col("lat"), 300)[1], 6).alias("half"))


@query("""SELECT p_partkey, CAST(floor(cos(radians(w - h)) * s + 0.5) AS INTEGER) AS head, CAST(floor(abs(sin(radians(w - h)) * s) + 0.5) AS INTEGER) AS "cross", CASE WHEN sin(radians(w - h)) >= 0 THEN 'right' ELSE 'left' END AS side
          FROM (SELECT p_partkey, (p_partkey % 36 + 1) * 10 AS h, p_partkey * 7 % 360 AS w, p_size AS s FROM part WHERE (p_partkey * 7 - (p_partkey % 36 + 1) * 10) % 30 <> 0)""")
def m03_wind(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(s, d, "part").filter("(p_partkey * 7 - (p_partkey % 36 + 1) * 10) % 30 <> 0")
    return p.select("p_partkey", measures.wind_components((k % 36 + 1) * 10, k * 7 % 360, F.col("p_size")).alias("w")).select("p_partkey", "w.*")


@query("""SELECT p_partkey, CAST(floor(p_size / 0.3048 + 0.5) AS INTEGER) AS ft, CAST(floor((p_size - 25) / 2.0 + 0.5) AS BIGINT) AS js, CASE WHEN p_partkey % 40 BETWEEN 1 AND 36 THEN CAST(p_partkey % 40 * 10 AS INTEGER) END AS heading,
          ['N','NE','E','SE','S','SW','W','NW'][1 + CAST(floor((p_partkey % 360) / 45.0 + 0.5) AS BIGINT) % 8] AS point FROM part""")
def m07_roundings(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    suffix = F.when(k % 4 == 0, "L").when(k % 4 == 1, "W").when(k % 4 == 2, "5").otherwise("")
    end = F.concat(F.when(k % 3 == 0, " ").otherwise(""), F.lpad((k % 40).cast("string"), 2, "0"), suffix)
    return table(s, d, "part").select("p_partkey", measures.feet(F.col("p_size")).alias("ft"), measures.round_up_half((F.col("p_size") - 25) / 2.0).alias("js"), measures.runway_heading(end).cast("int").alias("heading"), measures.compass_point(k % 360).alias("point"))


@query("""SELECT event_id, CASE WHEN v BETWEEN 0 AND 1 THEN round_even(v * 100, 1) WHEN v BETWEEN 0 AND 100 THEN round_even(v, 1) END AS pct FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN floor(value) / 64 WHEN event_id % 3 = 1 THEN floor(value * 8) / 4 ELSE value - 5 END AS v FROM events WHERE event_id % 3 <> 2 OR value = floor(value * 8) / 8)""")
def m09_percent(s: SparkSession, d: str) -> DataFrame:
    value, k = F.col("value"), F.col("event_id") % 3
    e = table(s, d, "events").filter((k != 2) | (value == F.floor(value * 8) / 8))
    return e.select("event_id", measures.percent(F.when(k == 0, F.floor(value) / 64).when(k == 1, F.floor(value * 8) / 4).otherwise(value - 5)).alias("pct"))


SURFACES = ["ASPH", "concrete", "Bitumen", "sealed", "TARMAC", "PEM", "Gras", "turf", "GRN", "lawn", "gravel", "GVL", "dirt", "sand/clay", "coral", "laterite", "murram", "soil", "water", "snow", "ice", "con", "bit", "unknown", "", None, "grass on asphalt", "ice road, gravel"]


@query(f"""SELECT p_partkey, CASE WHEN regexp_matches(s, 'asp|asph|concrete|conc|pav|bitum|seal|tar|paved|pem') THEN 'paved' WHEN regexp_matches(s, 'gras|turf|grn|lawn') THEN 'grass' WHEN regexp_matches(s, 'grav|gvl|dirt|earth|sand|clay|coral|later|murram|soil') THEN 'loose'
           WHEN regexp_matches(s, 'water') THEN 'water' WHEN regexp_matches(s, 'snow|ice') THEN 'snow' ELSE 'other' END AS surface
           FROM (SELECT p_partkey, lower({[x if x is not None else 'NULL' for x in SURFACES]!r}[1 + p_partkey % {len(SURFACES)}]) AS s FROM part)""".replace("'NULL'", "NULL"))
def m06_surface(s: SparkSession, d: str) -> DataFrame:
    free = F.get(F.array(*[F.lit(x) for x in SURFACES]), (F.col("p_partkey") % len(SURFACES)).cast("int"))
    return table(s, d, "part").select("p_partkey", measures.surface_class(free).alias("surface"))


# ---- text

@query("""SELECT page_id, trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, lower(regexp_extract(url, '^[^?#]*')) LIKE '%.pdf' AS pdf FROM pages""")
def p17_slugs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", text.slug(F.col("url")).alias("slug"), text.is_pdf(F.col("url")).alias("pdf"))


@query("""SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS n_links, regexp_extract(html, 'href="([^"]*)"', 1) AS first_link FROM pages""")
def p23_links(s: SparkSession, d: str) -> DataFrame:
    found = text.links(F.col("html"))
    return table(s, d, "pages").select("page_id", F.size(found).cast("bigint").alias("n_links"), F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first_link"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def n08_json_field(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""SELECT event_id, trim(type) AS type, trim(mhz) AS mhz, CASE WHEN user_id % 3 > 0 THEN CAST(user_id * 10 AS INTEGER) END AS length, CASE WHEN user_id % 2 > 0 THEN CAST(user_id AS INTEGER) END AS width FROM (SELECT event_id, user_id, unnest(string_split('TWR, 118.' || event_id % 9 || ';GND,;,121.5; ATIS ,' || user_id || ',x', ';')) AS p FROM events)
          CROSS JOIN LATERAL (SELECT split_part(p, ',', 1) AS type, split_part(p, ',', 2) AS mhz) WHERE trim(mhz) <> '' AND trim(type) <> ''""")
def n07_frequencies(s: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("TWR, 118."), F.col("event_id") % 9, F.lit(";GND,;,121.5; ATIS ,"), F.col("user_id"), F.lit(",x"))
    size = F.concat(F.when(F.col("user_id") % 3 > 0, (F.col("user_id") * 10).cast("string")).otherwise(F.lit("")), F.when(F.col("user_id") % 2 > 0, F.concat(F.lit("x"), F.col("user_id"))).otherwise(F.lit("x4 m")))
    return table(s, d, "events").select("event_id", text.dimensions(size).alias("size"), F.inline(text.frequencies(t))).select("event_id", "type", "mhz", "size.length", "size.width")


#: links of each shape, with the parts of a day from the page's number, and those that carry no edition
EDITION_LINKS = [
    "/aip/{y}-{m}-{d}-AIRAC/html", "/{y}-{m}-{d}-NON-AIRAC/", "/eAIP/AIRAC-{y}-{m}-{d}/x", "/nl_{y}_{m}_{d}/x", "/lo/{yy}{m}{d}/ad", "/BasicVFR/{y}{MON}{d}/C0", "/amdt_wef_{d}{mon}{y}/", "/AIP_SR_EFF_{d}{MON}{y}/", "/{yy}-{m}-{d}-AIRAC/", "/aip/{y}-{m}-{d}/DOCS/",
    "/chart_{y}{m}{d}.pdf", "/{d}.{m}.{y}/x", "/x/{y}-{m}-{d}.html", "/20{yy}XXX{d}/",
]
MON = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


@query(f"""SELECT page_id, CASE WHEN k < 10 THEN CAST(CAST(try_strptime(y || '-' || m || '-' || d, '%Y-%m-%d') AS DATE) AS VARCHAR) END AS day FROM (SELECT page_id, page_id % 14 AS k, printf('20%02d', page_id % 40) AS y, printf('%02d', 1 + page_id % 13) AS m, printf('%02d', 1 + page_id % 31) AS d FROM pages)
           WHERE m <> '13' OR k NOT IN (5, 6, 7)""")
def d14_edition_date(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    y, m, day = F.format_string("20%02d", (k % 40).cast("int")), (k % 13 + 1).cast("int"), F.format_string("%02d", (k % 31 + 1).cast("int"))
    mon = F.coalesce(F.get(F.array(*[F.lit(x) for x in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")]), m - 1), F.lit("xxx"))
    url = F.get(F.array(*[F.lit(x) for x in EDITION_LINKS]), (k % 14).cast("int"))
    for name, value in (("{y}", y), ("{yy}", F.substring(y, 3, 2)), ("{m}", F.format_string("%02d", m)), ("{d}", day), ("{mon}", mon), ("{MON}", F.upper(mon))):
        url = F.replace(url, F.lit(name), value)
    return table(s, d, "pages").filter((m != 13) | ~(k % 14).isin(5, 6, 7)).select("page_id", text.edition_date(url).cast("string").alias("day"))


# ---- state

@query(f"""WITH RECURSIVE e AS (SELECT 'u' || user_id AS key, t, event_id, {STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM {EV}),
           f AS (SELECT key, n, t, status, t AS at, CASE WHEN status = 'crit' THEN 'crit' END AS kind FROM e WHERE n = 1
           UNION ALL SELECT e.key, e.n, e.t, e.status, CASE WHEN e.status = 'crit' AND f.status = 'crit' AND e.t - f.at < 20000 THEN f.at ELSE e.t END,
           CASE WHEN e.status = 'crit' AND (f.status <> 'crit' OR e.t - f.at >= 20000) THEN 'crit' WHEN e.status <> 'crit' AND f.status = 'crit' THEN 'recovered' END FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
           SELECT key, t AS ts, kind FROM f WHERE kind IS NOT NULL""")
def t04_alerts(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = events(s, d).select(F.concat(F.lit("u"), "user_id").alias("key"), (F.row_number().over(w) - 1).cast("bigint").alias("run"), F.col("t").alias("ts"), measures.ladder(F.col("value"), 70, 90).alias("status"))
    return alerts.alerts_by_key(e, 20000)


@query(f"""WITH RECURSIVE e AS (SELECT user_id, t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM {EV}),
           f AS (SELECT user_id, n, t, event_id, t AS begin, 1 AS c FROM e WHERE n = 1 UNION ALL
           SELECT e.user_id, e.n, e.t, e.event_id, CASE WHEN e.t - f.begin >= 100000 THEN e.t ELSE f.begin END, CASE WHEN e.t - f.begin >= 100000 THEN 1 ELSE f.c + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
           SELECT user_id, t, event_id FROM f WHERE c <= 2""")
def t07_rate_limit(s: SparkSession, d: str) -> DataFrame:
    return alerts.rate_limited(events(s, d), ["user_id"], "t", "event_id", 100000, 2)


# ---- additions beyond the reference


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def extra_rollup(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
          FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def extra_pricing(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz").cast(table(s, d, "lineitem").schema["l_shipdate"].dataType))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


from fieldloom.plans import facilities, links, sections, sources, streams, texts, weather, weeks  # noqa: E402, F401  they register their queries


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
