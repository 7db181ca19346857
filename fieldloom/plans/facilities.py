"""Queries on facilities and their facts: guards, merges, editions, keyed writes and what goes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import dates, measures, text
from fieldloom.operators import relational, upsert
from fieldloom.plans.registry import EV, events, query
from fieldloom.session import new_path, table

# ---- quality of what came in

TITLES = "(SELECT p_partkey AS k, p_brand, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'LOX' ELSE 'ED' || chr(65 + CAST(p_partkey % 9 AS INTEGER)) || chr(65 + CAST(p_size % 7 AS INTEGER)) END AS code, CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || 'ED' || chr(65 + CAST(p_partkey % 9 AS INTEGER)) || chr(65 + CAST(p_size % 7 AS INTEGER)) WHEN 1 THEN 'VAC' WHEN 2 THEN 'Aerodrome data ' || p_name ELSE p_name END AS title FROM part)"


def _titles(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    own = F.concat(F.lit("ED"), F.char((k % 9 + 65).cast("int")), F.char(F.col("p_size") % 7 + 65))
    code = F.when(k % 11 == 0, None).when(k % 7 == 0, "LOX").otherwise(own)
    title = F.when(k % 4 == 0, F.concat("p_name", F.lit(" "), own)).when(k % 4 == 1, "VAC").when(k % 4 == 2, F.concat(F.lit("Aerodrome data "), "p_name")).otherwise(F.col("p_name"))
    return table(s, d, "part").select(k.alias("k"), "p_brand", code.alias("code"), title.alias("title"))


@query(f"""WITH r AS (SELECT *, CASE WHEN code IS NULL THEN NULL WHEN row_number() OVER (PARTITION BY code ORDER BY k) > 1 THEN 'dup' WHEN length(code) <> 4 THEN 'icao' WHEN NOT upper(title) LIKE '%' || code THEN 'title' ELSE 'ok' END AS v FROM {TITLES})
           SELECT p_brand, count(*) FILTER (v IS DISTINCT FROM 'dup') AS kept, count(*) FILTER (v <> 'dup') AS icao_bearing, count(*) FILTER (v = 'dup') AS dropped_duplicates, count(*) FILTER (v = 'icao') AS bad_icao, count(*) FILTER (v = 'title') AS bad_title,
           round(coalesce(count(*) FILTER (v = 'title') / nullif(count(*) FILTER (v <> 'dup'), 0), 0), 6) AS bad_title_ratio, coalesce(array_to_string((list(title ORDER BY k) FILTER (v = 'dup'))[1:5], '|'), '') AS samples FROM r GROUP BY 1""")
def a13_sanitize_report(s: SparkSession, d: str) -> DataFrame:
    r = relational.quality_report(_titles(s, d), ["p_brand"], "code", "title", "k")
    return r.select("p_brand", "kept", "icao_bearing", "dropped_duplicates", "bad_icao", "bad_title", F.round("bad_title_ratio", 6).alias("bad_title_ratio"), F.array_join("duplicate_samples", "|").alias("samples"))


@query(f"""SELECT p_brand, count(*) AS n, count(*) FILTER (bad) AS bad, count(*) FILTER (bad) / count(*) >= 0.2 AS warn FROM (SELECT p_brand, name = '' OR upper(name) = 'VAC' OR name LIKE 'Aerodrome data%' AS bad
           FROM (SELECT *, CASE WHEN code IS NOT NULL AND upper(title) LIKE '%' || code THEN trim(title[:length(title) - length(code)]) ELSE title END AS name FROM {TITLES})) GROUP BY 1""")
def a14_title_ratio(s: SparkSession, d: str) -> DataFrame:
    t = _titles(s, d).withColumn("bad", text.bad_title(F.col("title"), F.col("code")))
    return t.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), (F.avg(F.col("bad").cast("int")) >= 0.2).alias("warn"))


@query("""SELECT n.k AS c_nationkey, n.n, n.has, l.has AS last_has, CASE WHEN l.has > 0 AND n.has = 0 THEN 'collapsed' WHEN l.has > 0 AND n.has / n.n < (l.has / l.n) * 0.7 THEN 'dropped' ELSE 'ok' END AS verdict FROM
          (SELECT c_nationkey AS k, count(*) AS n, count(*) FILTER (c_acctbal > 400 * c_nationkey AND c_nationkey <> 5) AS has FROM customer GROUP BY 1) n LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n, count(*) FILTER (c_acctbal > 2500) AS has FROM customer WHERE c_nationkey <> 3 GROUP BY 1) l ON n.k = l.k""")
def a11_pdf_coverage(s: SparkSession, d: str) -> DataFrame:
    c, one = table(s, d, "customer"), F.count(F.lit(1)).alias("n")
    now = c.groupBy("c_nationkey").agg(one, F.count_if((F.col("c_acctbal") > F.col("c_nationkey") * 400) & (F.col("c_nationkey") != 5)).alias("has"))
    last = c.filter("c_nationkey <> 3").groupBy("c_nationkey").agg(one, F.count_if(F.col("c_acctbal") > 2500).alias("has"))
    return relational.coverage_guard(now, last, ["c_nationkey"])


@query("""SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1""")
def a01_first_of_group(s: SparkSession, d: str) -> DataFrame:
    """A group's bare columns, which the reference leaves to the store, are those of its smallest id."""
    first = F.min_by(F.struct("o_orderstatus", "o_orderpriority"), "o_orderkey")
    return table(s, d, "orders").groupBy("o_custkey").agg(first.alias("f")).select("o_custkey", "f.*")


@query("""SELECT scope, metric, value, unit, status FROM (SELECT upper(o_orderpriority) AS scope, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS pdf, bool_or(o_orderstatus = 'P') AS published, round(avg(o_totalprice), 2) AS took FROM orders GROUP BY 1)
          CROSS JOIN LATERAL (VALUES ('crawl_ok', CASE WHEN published THEN 1.0 ELSE 0.0 END, 'count', CASE WHEN NOT published THEN 'crit' WHEN n > 0 THEN 'ok' ELSE 'warn' END), ('crawl_airport_count', CAST(n AS DOUBLE), 'count', NULL), ('crawl_pdf_count', CAST(pdf AS DOUBLE), 'count', NULL), ('crawl_duration_s', took, 's', NULL)) v(metric, value, unit, status)""")
def a16_crawl_metrics(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "orders").groupBy(F.upper("o_orderpriority").alias("scope")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("pdf"), F.max(F.col("o_orderstatus") == "P").alias("published"), F.round(F.avg("o_totalprice"), 2).alias("took"))
    status = F.when(~F.col("published"), "crit").when(F.col("n") > 0, "ok").otherwise("warn")
    row = lambda name, value, unit, st: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), st.alias("status"))
    none = F.lit(None).cast("string")
    rows = F.array(row("crawl_ok", F.col("published").cast("int"), "count", status), row("crawl_airport_count", F.col("n"), "count", none), row("crawl_pdf_count", F.col("pdf"), "count", none), row("crawl_duration_s", F.col("took"), "s", none))
    return r.select("scope", F.inline(rows))


@query(f"""SELECT user_id, round(min(value), 6) AS low, round(max(value), 6) AS high, round(arg_max(value, (t, event_id)), 6) AS last, count(value) AS n FROM {EV} GROUP BY 1""")
def a17_series_stats(s: SparkSession, d: str) -> DataFrame:
    last = F.max_by("value", F.struct("t", "event_id"))
    return events(s, d).groupBy("user_id").agg(F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.round(last, 6).alias("last"), F.count("value").alias("n"))


@query("""SELECT c_nationkey, type, string_agg(CAST(c_custkey AS VARCHAR), ', ' ORDER BY c_custkey) AS mhz FROM (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' OR c_custkey % 10 = 0 THEN 'Frequency' ELSE c_mktsegment END AS type FROM customer) GROUP BY 1, 2""")
def a18_frequencies_by_type(s: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 10 == 0, None).when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_mktsegment"))
    kind = F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.lit("Frequency"))
    g = table(s, d, "customer").withColumn("type", kind).groupBy("c_nationkey", "type").agg(F.array_sort(F.collect_list("c_custkey")).alias("items"))
    return g.select("c_nationkey", "type", F.array_join("items", ", ").alias("mhz"))


@query("""SELECT c_nationkey, list_reduce(list_prepend('', list(c_mktsegment ORDER BY c_custkey) FILTER (c_custkey % 3 > 0)), lambda a, x: CASE WHEN list_contains(string_split(a, ','), x) THEN a WHEN a = '' THEN x ELSE a || ',' || x END) AS surfaces FROM customer GROUP BY 1""")
def a22_distinct_surfaces(s: SparkSession, d: str) -> DataFrame:
    """Known values in the order in which they were first seen."""
    c = table(s, d, "customer").filter("c_custkey % 3 > 0").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("seen"))
    return c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", "c_mktsegment"))), lambda x: x["c_mktsegment"]), ",").alias("surfaces"))


@query("""SELECT p_partkey, CASE WHEN len > 0 AND m > 0 THEN greatest(0.4, least(1.0, len / m)) ELSE 0.7 END AS scale, CAST(h % 180 AS INTEGER) AS bearing FROM (SELECT *, max(CASE WHEN len > 0 THEN len END) OVER (PARTITION BY p_brand) AS m FROM (SELECT p_partkey, p_brand, (p_partkey % 40) * 10 AS h, CASE WHEN p_size > 5 THEN p_size - 10 END AS len FROM part WHERE p_partkey % 40 BETWEEN 1 AND 36))""")
def a23_runway_scale(s: SparkSession, d: str) -> DataFrame:
    """Strips of runways with a readable end: length relative to the longest, at least 0.4, 0.7 where it isn't known."""
    k = F.col("p_partkey")
    p = table(s, d, "part").withColumn("h", measures.runway_heading(F.lpad((k % 40).cast("string"), 2, "0"))).filter("h is not null").withColumn("len", F.when(F.col("p_size") > 5, F.col("p_size") - 10))
    longest = F.max(F.when(F.col("len") > 0, F.col("len"))).over(Window.partitionBy("p_brand"))
    scale = F.when((F.col("len") != 0) & (longest > 0), F.greatest(F.lit(0.4), F.least(F.lit(1.0), F.col("len") / longest))).otherwise(0.7)
    return p.withColumn("scale", F.when(F.col("len") > 0, scale).otherwise(F.lit(0.7))).select("p_partkey", "scale", (F.col("h") % 180).cast("int").alias("bearing"))


@query("""SELECT c_custkey AS k, CASE WHEN b.k IS NULL THEN 'missing in second' ELSE 'missing in first' END AS side FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) a LEFT JOIN (SELECT -1 AS k) b ON c_custkey = b.k
          UNION ALL SELECT c_custkey, 'missing in first' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0""")
def a27_key_parity(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    both = relational.symmetric_difference(k.filter("k % 2 = 0"), k.filter("k % 3 = 0"), "k")
    return both.select("k", F.when(F.col("change") == "removed", "missing in second").otherwise("missing in first").alias("side"))


@query("""SELECT field, coalesce(arg_min(stem, seq) FILTER (suffix = ''), arg_min(stem, seq)) AS first_stem, string_agg(CASE WHEN suffix = '' THEN 'VFR' ELSE upper(suffix) END, ',' ORDER BY seq) AS charts FROM (SELECT p_partkey AS seq, split_part(p_name, ' ', 1) AS field, CASE WHEN p_size % 3 = 0 THEN '' ELSE replace(p_type, ' ', '_') END AS suffix, p_name AS stem FROM part) GROUP BY 1""")
def a28_charts_by_stem(s: SparkSession, d: str) -> DataFrame:
    """Files by the part of their stem before the first _, whose rest names the chart; the plain one, or else the first, is primary."""
    stem = F.concat(F.split("p_name", " ")[0], F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("_"), F.replace("p_type", F.lit(" "), F.lit("_")))))
    f = table(s, d, "part").select(F.col("p_partkey").alias("seq"), "p_name", stem.alias("stem"))
    f = f.withColumn("field", F.split("stem", "_")[0]).withColumn("suffix", F.regexp_replace("stem", "^[^_]*_?", ""))
    name = F.when(F.col("suffix") == "", "VFR").otherwise(F.upper("suffix"))
    first = F.coalesce(F.min_by("p_name", F.when(F.col("suffix") == "", F.col("seq"))), F.min_by("p_name", "seq"))
    return f.groupBy("field").agg(first.alias("first_stem"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", name.alias("name")))), lambda x: x["name"]), ",").alias("charts"))


@query("""SELECT doc_id, CASE WHEN (length(text) - length(replace(text, 'th', ''))) / 2 + (length(text) - length(replace(text, 'ä', ''))) > (length(text) - length(replace(text, 'on', ''))) / 2 THEN 'de' ELSE 'en' END AS lang FROM documents""")
def a25_language_vote(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.language_vote(F.col("text"), "th", "on", "[ä]").alias("lang"))


# ---- filters

@query("""SELECT c_custkey FROM customer WHERE coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal > 0 END, false)""")
def f10_active(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").withColumn("active", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal") > 0)).filter("active").select("c_custkey")


@query("""SELECT c_nationkey, c_mktsegment, bool_or(c_custkey % 5 = 0 AND c_acctbal > 9000) AS paved, count(*) FILTER (c_acctbal > 9900) > 0 AS fuel FROM customer GROUP BY 1, 2""")
def f14_any_match(s: SparkSession, d: str) -> DataFrame:
    surface = F.when((F.col("c_custkey") % 5 == 0) & (F.col("c_acctbal") > 9000), "Tarmac").when(F.col("c_custkey") % 5 == 1, "grass").when(F.col("c_custkey") % 5 == 2, "Asfalt")
    g = table(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.collect_list(F.struct(surface.alias("surface"))).alias("runways"), F.collect_list(F.when(F.col("c_acctbal") > 9900, F.lit("AVGAS"))).alias("fuel"))
    return g.select("c_nationkey", "c_mktsegment", F.coalesce(F.exists("runways", lambda r: F.coalesce(r["surface"].rlike(measures.HARD_SURFACE), F.lit(False))), F.lit(False)).alias("paved"), (F.size("fuel") > 0).alias("fuel"))


@query("""SELECT c_custkey, '{' || array_to_string(list_filter([CASE WHEN c_acctbal > 0 THEN '"fuel":true' END, CASE WHEN c_custkey % 3 = 0 THEN '"customs":true' END], lambda x: x IS NOT NULL), ',') || '}' AS marker FROM customer""")
def f15_flags(s: SparkSession, d: str) -> DataFrame:
    """Flags that aren't known to be true don't appear."""
    flag = lambda c: F.when(c, F.lit(True))
    return table(s, d, "customer").select("c_custkey", F.to_json(F.struct(flag(F.col("c_acctbal") > 0).alias("fuel"), flag(F.col("c_custkey") % 3 == 0).alias("customs"))).alias("marker"))


@query("""SELECT event_id, url, lcp, cls, nav FROM (SELECT event_id, '/p/' || user_id AS url, CASE WHEN event_id % 5 = 1 OR value * 50000 >= 3600000 OR value < 0 THEN NULL ELSE floor(value * 50000 * 1000 + 0.5) / 1000 END AS lcp, CASE WHEN event_id % 3 = 0 AND value > 10 THEN floor(value / 7 * 1000 + 0.5) / 1000 END AS cls,
          CASE WHEN event_id % 2 = 0 THEN repeat(event_type, 12)[:32] END AS nav FROM events WHERE event_id % 7 > 0) WHERE lcp IS NOT NULL OR cls IS NOT NULL""")
def f17_beacons(s: SparkSession, d: str) -> DataFrame:
    v, i = F.col("value"), F.col("event_id")
    lcp = F.when(i % 5 == 1, F.concat(F.lit('"'), v, F.lit('"'))).otherwise((v * 50000).cast("string"))
    cls = F.when((i % 3 == 0) & (v > 10), (v / 7).cast("string")).when(i % 3 == 0, F.lit("-1")).otherwise(F.lit("null"))
    nav = F.when(i % 2 == 0, F.concat(F.lit('"'), F.repeat("event_type", 12), F.lit('"'))).otherwise(F.lit("7"))
    raw = F.concat(F.lit('{"url":"'), F.when(i % 7 > 0, F.lit("/p/")).otherwise(F.lit("http://x/")), "user_id", F.lit('","metrics":{"LCP":'), lcp, F.lit(',"CLS":'), cls, F.lit(',"X":1},"nav":'), nav, F.lit("}"))
    return text.beacons(table(s, d, "events").select("event_id", raw.alias("raw")), "raw").select("event_id", "url", "lcp", "cls", "nav")


@query("""SELECT event_id, kind, message, source, lineno FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'unhandledrejection' ELSE 'error' END AS kind, repeat(event_type, 120)[:500] AS message, CASE WHEN event_id % 4 > 0 THEN 'f' || user_id END AS source, CASE WHEN value >= 20 THEN CAST(floor(value) AS BIGINT) END AS lineno FROM events WHERE event_id % 6 > 0)""")
def f18_client_errors(s: SparkSession, d: str) -> DataFrame:
    v, i = F.col("value"), F.col("event_id")
    line = F.when(v >= 20, v.cast("string")).when(i % 2 == 0, F.lit("-3")).otherwise(F.lit('"x"'))
    raw = F.concat(
        F.lit('{"kind":"'), F.when(F.col("event_type") == "error", "unhandledrejection").otherwise("other"), F.lit('","message":"'), F.when(i % 6 != 3, F.repeat("event_type", 120)).otherwise(F.when(i % 6 == 3, F.repeat("event_type", 120))),
        F.lit('","url":"'), F.when(i % 6 > 0, "/x").otherwise("x"), F.lit('","source":'), F.when(i % 4 > 0, F.concat(F.lit('"f'), "user_id", F.lit('"'))).otherwise(F.lit('""')), F.lit(',"lineno":'), line, F.lit("}"),
    )
    return text.client_errors(table(s, d, "events").select("event_id", raw.alias("raw")), "raw").select("event_id", "kind", "message", "source", "lineno")


@query("""SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%' AND p_brand = 'Brand#1' AND p_size < 20""")
def f19_validated_search(s: SparkSession, d: str) -> DataFrame:
    """A search whose arguments are checked before anything is read: bad ones give no rows."""
    term, brand = "  rING ".strip(), "Brand#1"
    if not relational.valid_search(term, "DE", "vfr"):
        return table(s, d, "part").limit(0).select("p_partkey", "p_name")
    return table(s, d, "part").filter(F.col("p_name").ilike(f"%{term}%") & (F.col("p_brand") == brand) & (F.col("p_size") < 20)).select("p_partkey", "p_name")


# ---- joins and merges

@query("""SELECT k, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_orderkey, l_linenumber, l_partkey) AS parts FROM (SELECT o_orderkey, 'K' || o_custkey AS k FROM orders WHERE o_totalprice > 200000) JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY 1""")
def j05_children_by_ident(s: SparkSession, d: str) -> DataFrame:
    """Children found through an ident -> code map; those of unknown idents, and closed ones, drop out."""
    idents = table(s, d, "orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("K"), "o_custkey").alias("k"))
    kids = table(s, d, "lineitem").filter("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_partkey").join(idents, "l_orderkey")
    g = kids.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey"))).alias("x"))
    return g.select("k", F.array_join(F.transform("x", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("""SELECT k, coalesce(a.v, b.v, c.v) AS v, coalesce(CASE WHEN len(a.xs) > 0 THEN a.xs END, CASE WHEN len(b.xs) > 0 THEN b.xs END, c.xs)[1] AS x, a.town, CASE WHEN k % 50 = 0 THEN 'fixed' ELSE coalesce(a.w, b.w) END AS w,
          concat_ws('+', CASE WHEN a.k IS NOT NULL THEN 'ourairports' END, CASE WHEN b.k IS NOT NULL THEN 'openaip' END, CASE WHEN c.k IS NOT NULL THEN 'awc' END) AS source
          FROM (SELECT c_custkey AS k, nullif(c_acctbal, abs(c_acctbal)) AS v, CASE WHEN c_custkey % 4 = 0 THEN [c_name] ELSE [] END AS xs, c_mktsegment AS town, CASE WHEN c_custkey % 8 = 0 THEN c_name END AS w FROM customer WHERE c_custkey % 2 = 0) a
          FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS v, CASE WHEN c_custkey % 6 = 0 THEN ['b'] ELSE [] END AS xs, CASE WHEN c_custkey % 9 > 0 THEN 'b' END AS w FROM customer WHERE c_custkey % 3 = 0) b USING (k)
          FULL JOIN (SELECT c_custkey AS k, CAST(NULL AS DOUBLE) AS v, CASE WHEN c_custkey % 10 = 0 THEN ['c'] END AS xs FROM customer WHERE c_custkey % 5 = 0) c USING (k)
          WHERE coalesce(a.v, b.v) IS NOT NULL OR a.town IS NOT NULL OR len(b.xs) > 0 OR c.xs IS NOT NULL OR b.w IS NOT NULL OR k % 50 = 0""")
def j07_facts_merge(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").withColumn("k", F.col("c_custkey"))
    none = F.array().cast("array<string>")
    stored = c.filter("k % 2 = 0").select("k", F.nullif("c_acctbal", F.abs("c_acctbal")).alias("v"), F.when(F.col("k") % 4 == 0, F.array("c_name")).otherwise(none).alias("xs"), F.col("c_mktsegment").alias("town"), F.when(F.col("k") % 8 == 0, F.col("c_name")).alias("w"), F.lit("ourairports").alias("source"))
    community = c.filter("k % 3 = 0").select("k", F.when(F.col("k") % 9 > 0, F.col("c_acctbal")).alias("v"), F.when(F.col("k") % 6 == 0, F.array(F.lit("b"))).otherwise(none).alias("xs"), F.when(F.col("k") % 9 > 0, "b").alias("w"))
    service = c.filter("k % 5 = 0").select("k", F.when(F.col("k") % 10 == 0, F.array(F.lit("c"))).alias("xs"))
    over = c.filter("k % 50 = 0").select("k", F.lit("fixed").alias("w"))
    m = relational.facts_merge(stored, [("openaip", community), ("awc", service)], over, "k", ["v", "w"], ["xs"], ["town"])
    return m.select("k", "v", F.get("xs", F.lit(0)).alias("x"), "town", "w", "source")


@query("""SELECT c_custkey AS k, 'edition' AS change FROM customer WHERE c_custkey % 3 = 0""")
def j08_new_edition(s: SparkSession, d: str) -> DataFrame:
    """All rows after a change of edition; a failed snapshot, which is unioned here as well, gives none."""
    k = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    old, new = k.filter("k % 2 = 0"), k.filter("k % 3 = 0")
    return relational.changed_details(old, new, "k", True, True).unionByName(relational.changed_details(old, new, "k", False, True))


@query("""SELECT c_custkey AS k, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'i' || c_custkey END, CASE WHEN c_custkey % 2 = 0 THEN c_name END) AS name FROM customer""")
def j12_names(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").withColumn("k", F.col("c_custkey"))
    index = c.filter("k % 3 = 0").select("k", F.concat(F.lit("i"), "k").alias("name"), F.lit(1).alias("seq")).unionByName(c.filter("k % 6 = 0").select("k", F.lit("later").alias("name"), F.lit(2).alias("seq")))
    rows = c.filter("k % 2 = 0").select("k", F.col("c_name").alias("name"), F.lit(1).alias("seq"))
    return relational.named(c.select("k"), [index, rows], "k", "name")


@query("""SELECT k, first_key, string_agg(u, ',' ORDER BY n) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY g, seq) AS n FROM (SELECT *, row_number() OVER (PARTITION BY k, u ORDER BY g, seq) AS r, first_value(seq) OVER (PARTITION BY k ORDER BY g, seq) AS first_key
          FROM (SELECT 0 AS g, o_orderkey AS seq, upper(o_orderpriority) AS k, o_orderstatus || (o_custkey % 40) AS u FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, o_orderkey, upper(o_orderpriority), o_orderstatus || (o_custkey % 60) FROM orders WHERE o_orderkey % 3 = 0)) WHERE r = 1) WHERE n <= 50 GROUP BY 1, 2""")
def j13_charts_union(s: SparkSession, d: str) -> DataFrame:
    def group(every: int, kinds: int) -> DataFrame:
        o = table(s, d, "orders").filter(F.col("o_orderkey") % every == 0)
        return o.select(F.upper("o_orderpriority").alias("k"), F.col("o_orderkey").alias("seq"), F.array(F.struct(F.concat("o_orderstatus", F.col("o_custkey") % kinds).alias("u"))).alias("charts"))

    m = relational.union_by_key([group(2, 40), group(3, 60)], "k", ["seq"], "seq", "charts", "u")
    return m.select("k", F.col("seq").alias("first_key"), F.array_join(F.transform("charts", lambda x: x["u"]), ",").alias("urls"))


@query("""SELECT c_custkey, coalesce(n, 0) AS n, newest FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS newest FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def j15_lists_looked_up(s: SparkSession, d: str) -> DataFrame:
    """Grouped on the large side first, then looked up."""
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("newest"))
    return table(s, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "newest")


@query("""SELECT source, n_nationkey AS code FROM (SELECT DISTINCT source FROM documents), nation WHERE n_nationkey < 20 AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = documents_source(source) AND d.doc_id % 97 = n_nationkey)""".replace("documents d WHERE d.source = documents_source(source)", "documents d WHERE d.source IS NOT DISTINCT FROM source_list.source").replace("(SELECT DISTINCT source FROM documents),", "(SELECT DISTINCT source FROM documents) source_list,").replace("SELECT source, n", "SELECT source_list.source, n"))
def j17_missing_codes(s: SparkSession, d: str) -> DataFrame:
    lists = table(s, d, "documents").select("source", (F.col("doc_id") % 97).cast("int").alias("code"))
    return relational.coverage_of(table(s, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("code")), lists, "code", "source")


@query("""SELECT user_id, now.status, old.status AS previous, CASE WHEN now.status = 'crit' AND old.status IS DISTINCT FROM 'crit' THEN 'crit' WHEN now.status <> 'crit' AND old.status = 'crit' THEN 'recovered' END AS alert
          FROM (SELECT user_id, CASE WHEN max(value) >= 105 THEN 'crit' ELSE 'ok' END AS status FROM events WHERE event_id % 2 = 0 GROUP BY 1) now LEFT JOIN (SELECT user_id, CASE WHEN max(value) >= 105 THEN 'crit' ELSE 'ok' END AS status FROM events WHERE event_id % 2 = 1 AND user_id % 5 > 0 GROUP BY 1) old USING (user_id)""")
def j18_state_join(s: SparkSession, d: str) -> DataFrame:
    def run(cond: str, name: str) -> DataFrame:
        return table(s, d, "events").filter(cond).groupBy("user_id").agg(measures.ladder(F.max("value"), 1e9, 105).alias(name))

    j = run("event_id % 2 = 0", "status").join(run("event_id % 2 = 1 and user_id % 5 > 0", "previous"), "user_id", "left")
    entered = (F.col("status") == "crit") & ~F.col("previous").eqNullSafe(F.lit("crit"))
    return j.withColumn("alert", F.when(entered, "crit").when((F.col("status") != "crit") & (F.col("previous") == "crit"), "recovered"))


@query("""SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN DATE '2026-01-01' + CAST(s_suppkey % 28 AS INTEGER) END, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 3 = 0 THEN DATE '2025-02-01' + CAST(s_suppkey % 28 AS INTEGER) END, CASE WHEN n_regionkey > 0 THEN DATE '2024-06-13' END)::VARCHAR AS airac FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def j20_field_edition(s: SparkSession, d: str) -> DataFrame:
    """The edition that a field's own chart link names, or without a chart its page; else its country's."""
    k = F.col("s_suppkey")
    dated = lambda start, mark: F.concat(F.lit(mark), F.date_format(F.date_add(F.lit(start).cast("date"), (k % 28).cast("int")), "yyyy-MM-dd"), F.lit("/a.pdf"))
    f = table(s, d, "supplier").select("s_suppkey", "s_nationkey", F.when(k % 4 == 0, dated("2026-01-01", "/x/")).alias("pdf"), F.when(k % 3 == 0, dated("2025-02-01", "/y/")).otherwise("/none").alias("url"))
    meta = table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.when(F.col("n_regionkey") > 0, F.lit("2024-06-13").cast("date")).alias("stamp"))
    own = F.when(F.col("pdf").isNotNull(), text.edition_date(F.col("pdf"))).otherwise(text.edition_date(F.col("url")))
    return f.join(meta, "s_nationkey", "left").select("s_suppkey", F.coalesce(own, "stamp").cast("string").alias("airac"))


@query("""SELECT o_custkey, coalesce(arg_max(o_orderkey, (day, -o_orderkey)) FILTER (day <= DATE '1995-01-01'), arg_min(o_orderkey, (day, o_orderkey)) FILTER (day IS NOT NULL), min(o_orderkey) FILTER (day IS NULL)) AS o_orderkey FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders) GROUP BY 1""")
def j23_dated_or_first(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").withColumn("day", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate").cast("date"))).withColumn("seq", F.col("o_orderkey"))
    return relational.dated_or_first(o, ["o_custkey"], "day", "seq", "o_orderkey", F.lit("1995-01-01").cast("date"))


# ---- order and picks

@query("""SELECT c_nationkey, arg_max(c_custkey, (head, -c_custkey)) FILTER (head > 0) AS best FROM (SELECT *, CAST(c_acctbal / 1000 AS INTEGER) - 4 AS head FROM customer) GROUP BY 1""")
def o05_most_headwind(s: SparkSession, d: str) -> DataFrame:
    """The largest value above 0, the first of equals; none if no value is."""
    c = table(s, d, "customer").withColumn("head", F.round(F.col("c_acctbal") / 1000).cast("int") - 4)
    return c.groupBy("c_nationkey").agg(F.max_by("c_custkey", F.when(F.col("head") > 0, F.struct("head", -F.col("c_custkey")))).alias("best"))


@query("""SELECT event_type AS metric, coalesce(scope, '') AS scope, count(*) AS n FROM (SELECT event_type, CASE WHEN user_id % 4 > 0 THEN 's' || user_id % 4 END AS scope FROM events) GROUP BY 1, 2 ORDER BY 1, 2""")
def o06_compound_sort(s: SparkSession, d: str) -> DataFrame:
    scope = F.coalesce(F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("s"), F.col("user_id") % 4)), F.lit(""))
    return table(s, d, "events").groupBy(F.col("event_type").alias("metric"), scope.alias("scope")).agg(F.count(F.lit(1)).alias("n")).orderBy("metric", "scope")


@query("""SELECT p_partkey, CASE WHEN a = b THEN CAST(a AS VARCHAR) WHEN a < b THEN a || ',' || b ELSE b || ',' || a END AS headings FROM (SELECT p_partkey, (p_partkey % 36 + 1) * 10 AS a, (p_size % 36 + 1) * 10 AS b FROM part)""")
def o07_ends_by_heading(s: SparkSession, d: str) -> DataFrame:
    """A runway's ends, each heading once, in order of heading."""
    ident = F.format_string("%02d/%02dL", (F.col("p_partkey") % 36 + 1).cast("int"), F.col("p_size") % 36 + 1)
    return table(s, d, "part").select("p_partkey", F.array_join(measures.runway_ends(ident), ",").alias("headings"))


@query("""SELECT n_name, CAST(row_number() OVER (ORDER BY lower(n_name)) AS INTEGER) AS place FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM nation)""")
def o08_locale_order(s: SparkSession, d: str) -> DataFrame:
    """Names as people order them: letters before case."""
    n = table(s, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("n_name"))
    listed = n.agg(F.array_sort(F.collect_list(F.struct(F.collate("n_name", "UNICODE").alias("c"), "n_name"))).alias("x"))  # names of a small dimension
    return listed.select(F.posexplode("x").alias("place", "x")).select("x.n_name", (F.col("place") + 1).alias("place"))


@query("""SELECT source, coalesce(arg_min(doc_id, doc_id) FILTER (lang LIKE 'f%'), arg_min(doc_id, doc_id) FILTER (lang LIKE 'd%'), min(doc_id)) AS doc_id FROM documents GROUP BY 1""")
def o10_designation(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").withColumn("seq", F.col("doc_id"))
    return relational.priority_pick(docs, ["source"], [F.upper("lang").startswith("F"), F.upper("lang").startswith("D")], "doc_id", "seq").drop("rank")


@query("""SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r > 3""")
def w15_without_first(s: SparkSession, d: str) -> DataFrame:
    return relational.page_of_links(table(s, d, "conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn")


# ---- keyed writes and what goes out

@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 6 > 0 THEN 'new' ELSE 'old' END AS v, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 6 > 0 THEN 20 ELSE 10 END AS updated_at FROM nation""")
def k01_replace_partitions(s: SparkSession, d: str) -> DataFrame:
    """Countries replaced as whole partitions of a table, and their stamps; countries without incoming rows stay."""
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.lit("old").alias("v"))
    path = new_path(s, "by-country")
    n.write.partitionBy("n_nationkey").parquet(path)
    incoming = n.filter("n_nationkey % 2 = 0 and n_nationkey % 6 > 0").withColumn("v", F.lit("new"))
    upsert.replace_partitions(s, incoming, path, "n_nationkey")
    stamps = n.select("n_nationkey", F.lit(1).alias("seq"), F.lit(10).alias("updated_at")).unionByName(incoming.select("n_nationkey", F.lit(2).alias("seq"), F.lit(20).alias("updated_at")))
    meta = upsert.last_write(stamps, "n_nationkey", "seq", ["updated_at"])
    return s.read.schema("v string, n_nationkey int").parquet(path).join(meta, "n_nationkey").select("n_nationkey", "v", "updated_at")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'stored' END AS v, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN 'kept' END AS text FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""".replace("CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN 'kept' END", "CASE WHEN c_custkey % 2 = 0 THEN 'kept' ELSE c_mktsegment END"))
def k03_write_back(s: SparkSession, d: str) -> DataFrame:
    """One merged row per key over the stored table: columns outside the conflict list are only set where a row is new."""
    c = table(s, d, "customer").withColumn("k", F.col("c_custkey"))
    stored = c.filter("k % 2 = 0").select("k", F.lit("stored").alias("v"), F.lit("kept").alias("text"))
    merged = c.filter("k % 3 = 0").select("k", F.col("c_name").alias("v"), F.col("c_mktsegment").alias("text"))
    return upsert.write_back(stored, merged, "k", ["v"], ["text"])


@query("""SELECT o_orderkey, o_totalprice AS value FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 = 0""")
def k05_appended(s: SparkSession, d: str) -> DataFrame:
    """Two batches appended to one table; rows that both hold are there twice."""
    o = table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    path = new_path(s, "appended")
    upsert.append(o.filter("o_orderkey % 2 = 0"), path)
    upsert.append(o.filter("o_orderkey % 5 = 0"), path)
    return s.read.schema(o.schema).parquet(path)


@query("""SELECT event_id, value FROM events WHERE event_id < 7""")
def k06_single_appends(s: SparkSession, d: str) -> DataFrame:
    """Single rows appended one by one; one that can't be written is dropped without stopping the rest."""
    e, path = table(s, d, "events").select("event_id", "value"), new_path(s, "beacons")
    for i in range(7):  # a beacon each
        upsert.append_quietly(e.filter(F.col("event_id") == i), path)
    upsert.append_quietly(e.filter("event_id = 8").withColumn("value", F.raise_error(F.lit("broken"))), path)
    return s.read.schema(e.schema).parquet(path)


@query("""SELECT n_nationkey, count(s_suppkey) AS n, coalesce(string_agg('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}', ',' ORDER BY s_suppkey), '') AS airports FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def k09_json_index(s: SparkSession, d: str) -> DataFrame:
    """A country's facilities as JSON, in order; a country without any has an empty list."""
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"))
    item = F.struct("s_suppkey", "s_name")
    own = table(s, d, "supplier").groupBy(F.col("s_nationkey").cast("int").alias("n_nationkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    items = F.coalesce("items", F.array().cast("array<struct<s_suppkey:bigint,s_name:string>>"))
    return n.join(own, "n_nationkey", "left").select("n_nationkey", F.size(items).cast("bigint").alias("n"), F.array_join(F.transform(items, lambda x: F.to_json(x)), ",").alias("airports"))


@query("""SELECT s_suppkey, l AS locale, '/' || l || '/' || CASE WHEN s_suppkey % 2 = 0 THEN 'vfr' ELSE 'ifr' END || '?' || s_suppkey AS url FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN LATERAL (SELECT unnest(CASE WHEN n_regionkey > 1 THEN ['n' || n_nationkey, 'n' || n_nationkey || '-EN'] ELSE ['n' || n_nationkey] END) AS l)
          WHERE s_suppkey % 2 = 0 OR n_regionkey <> 4""")
def k10_sitemap(s: SparkSession, d: str) -> DataFrame:
    """A link for each facility and locale of its country, where the country has the type."""
    n = table(s, d, "nation").select("n_nationkey", "n_regionkey", F.concat(F.lit("n"), "n_nationkey").alias("cc"))
    locales = n.select("n_nationkey", "n_regionkey", F.explode(F.when(F.col("n_regionkey") > 1, F.array("cc", F.concat("cc", F.lit("-EN")))).otherwise(F.array("cc"))).alias("locale"))
    kind = F.when(F.col("s_suppkey") % 2 == 0, "vfr").otherwise("ifr")
    j = table(s, d, "supplier").withColumn("type", kind).join(locales, F.col("s_nationkey") == F.col("n_nationkey")).filter((F.col("type") == "vfr") | (F.col("n_regionkey") != 4))
    return j.select("s_suppkey", "locale", F.concat(F.lit("/"), "locale", F.lit("/"), "type", F.lit("?"), "s_suppkey").alias("url"))


@query("""SELECT url FROM (SELECT url, min(seq) AS seq FROM (SELECT '/c/' || c_nationkey AS url, c_custkey AS seq FROM customer UNION ALL SELECT '/d/' || (o_custkey % 500), 1000000 + o_orderkey FROM orders) GROUP BY 1) ORDER BY seq LIMIT 400""")
def k11_change_feed(s: SparkSession, d: str) -> DataFrame:
    """Links of changed pages, each once, the first so many."""
    a = table(s, d, "customer").select(F.concat(F.lit("/c/"), "c_nationkey").alias("url"), F.col("c_custkey").alias("seq"))
    b = table(s, d, "orders").select(F.concat(F.lit("/d/"), F.col("o_custkey") % 500).alias("url"), (F.col("o_orderkey") + 1_000_000).alias("seq"))
    return a.unionByName(b).groupBy("url").agg(F.min("seq").alias("seq")).orderBy("seq").limit(400).select("url")


@query("""SELECT c_custkey AS endpoint, CASE WHEN c_custkey IN (3, 7) THEN 'again' ELSE c_name END AS name FROM customer""")
def k14_resubscribed(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select(F.col("c_custkey").alias("endpoint"), F.col("c_name").alias("name"))
    return upsert.replace_subscription(c, c.filter("endpoint in (3, 7)").withColumn("name", F.lit("again")), "endpoint")


@query("""SELECT url, arg_max(etag, seq) AS etag, arg_max(bytes, seq) AS bytes FROM (SELECT 'u' || o_custkey AS url, o_orderkey AS seq, CASE WHEN o_orderkey % 4 > 0 THEN 'e' || o_orderkey END AS etag, length(o_orderpriority) AS bytes FROM orders) WHERE etag IS NOT NULL GROUP BY 1""")
def s05_page_cache(s: SparkSession, d: str) -> DataFrame:
    """Bodies by link, the last one with a validator; compressed when stored, whole when read back."""
    o = table(s, d, "orders").select(F.concat(F.lit("u"), "o_custkey").alias("url"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("e"), "o_orderkey")).alias("etag"), F.col("o_orderpriority").cast("binary").alias("body"))
    kept = upsert.last_write(o.filter("etag is not null"), "url", "seq", ["etag", "body"])
    return kept.select("url", "etag", F.length("body").cast("bigint").alias("bytes"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%m-%d %H:%M') ELSE strftime(ts, '%H:%M') END AS clock FROM events""")
def d13_axis_clock(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", dates.axis_clock(F.col("ts").cast("timestamp"), F.col("event_id") % 2 == 0).alias("clock"))
