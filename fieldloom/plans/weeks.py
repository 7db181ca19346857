"""Queries on opening hours out of texts and documents, and on what is asked of them.

Texts are made of columns of the tables by one expression that both languages evaluate ({div} is their whole division); the SQL then
reads them as rows of segments and days, not as the nested expressions that the functions use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import dates, distances, hours, schedules
from fieldloom.plans.registry import query
from fieldloom.plans.texts import KIND, _week
from fieldloom.session import table

DUCK = {"div": "//"}
SPARK = {"div": "div"}
PRICE = "CAST(floor(o_totalprice) AS BIGINT)"


def _day(i: str) -> str:
    return f"substr('MONTUEWEDTHUFRISATSUN', CAST(({i}) % 7 AS INT) * 3 + 1, 3)"


def _clock(i: str) -> str:
    """HHMM, with hours to 25 and minutes to 63."""
    return f"lpad(CAST(({i}) % 26 AS STRING), 2, '0') || lpad(CAST((({i}) {{div}} 26) % 64 AS STRING), 2, '0')"


def _segment(x: str, y: str) -> str:
    return f"""CASE ({x}) % 11 WHEN 0 THEN 'H24' WHEN 1 THEN {_day(f"({x}) {{div}} 11")} || '-' || {_day(y)} || ' ' || {_clock(y)} || '-' || {_clock(x)}
      WHEN 2 THEN {_day(y)} || ' – ' || {_day(f"({x}) {{div}} 11")} || ' ' || {_clock(x)} || '-' || {_clock(y)} WHEN 3 THEN {_day(y)} || ' SR - ' || {_clock(x)}
      WHEN 4 THEN 'daily ' || {_clock(y)} || ' – ' || {_clock(x)} WHEN 5 THEN {_day(y)} || '-' || {_day(f"({x}) {{div}} 7")} || ' CLSD' WHEN 6 THEN {_day(y)} || ' O/R'
      WHEN 7 THEN {_clock(x)} || '-SS' WHEN 8 THEN 'avbl by NOTAM' WHEN 9 THEN 'see ' || lower(o_orderpriority) ELSE {_day(x)} || '  h24' END"""


K, P = "o_orderkey", PRICE
HOURS_TEXT = f"""CASE WHEN {K} % 17 > 0 THEN {_segment(K, P)} || CASE {K} % 5 WHEN 0 THEN chr(10) ELSE '; ' END || {_segment(P, K)}
  || CASE WHEN {K} % 3 = 0 THEN ';' || {_segment(f"{K} + {P}", f"{K} * 3")} ELSE '' END END"""
TABLE_PAGE = f"""CASE WHEN {K} % 4 = 0 THEN 'AD 2.3 AD 2.4 contents ' ELSE '' END || 'AD 2.3 HOURS 1 Operator ' || ({HOURS_TEXT})
  || CASE {K} % 3 WHEN 0 THEN ' 2 Customs H24' WHEN 1 THEN ' Customs and immigration 0600-0700' ELSE ' none ' END || ' AD 2.' || CASE WHEN {K} % 2 = 0 THEN '4' ELSE '13' END || ' end'"""


def week_rows(df: DataFrame, key: str, week: Column) -> DataFrame:
    days = df.select(F.col(key).alias("k"), F.posexplode(week).alias("day", "w"))
    return days.select("k", "day", "w.kind", F.col("w.open.t").alias("open_t"), F.col("w.open.m").alias("open_m"), F.col("w.close.t").alias("close_t"), F.col("w.close.m").alias("close_m"))


def _minutes(token: str) -> str:
    return f"CASE WHEN regexp_matches({token}, '^[0-9]{{{{4}}}}$') AND CAST({token}[:2] AS INTEGER) <= 24 AND CAST({token}[3:] AS INTEGER) <= 59 THEN CAST({token}[:2] AS INTEGER) * 60 + CAST({token}[3:] AS INTEGER) END"


#: picks for each day the statement that counts out of said(k, pos, day, kind, ot, om, ct, cm)
WEEKS = """, first AS (SELECT k, day, {pick}(struct_pack(kind, ot, om, ct, cm), pos) AS w FROM said GROUP BY k, day),
  weeks AS (SELECT k, CAST(day AS INTEGER) AS day, coalesce(w.kind, 'unknown') AS kind, w.ot AS open_t, CAST(w.om AS INTEGER) AS open_m, w.ct AS close_t, CAST(w.cm AS INTEGER) AS close_m
    FROM (SELECT DISTINCT k FROM said) CROSS JOIN range(7) r(day) LEFT JOIN first USING (k, day)
    UNION ALL SELECT k, CAST(day AS INTEGER), kind, NULL, NULL, NULL, NULL FROM whole CROSS JOIN range(7) r(day) WHERE kind IS NOT NULL)"""


def _text_sql(source: str) -> str:
    """CTEs up to weeks for the free texts of source(k, raw)."""
    n, w = schedules.NAMES, r"\b(\d{{3,4}}|SR|SS)\s*[-–—]\s*(\d{{3,4}}|SR|SS)\b"
    days = rf"\b({n})(?:\s*[-–—]\s*({n}))?\b"
    at = lambda c: f"(strpos('MONTUEWEDTHUFRISATSUN', {c}) - 1) // 3"
    return rf"""WITH src AS ({source}), t AS (SELECT k, trim(regexp_replace(upper(raw), '\s+', ' ', 'g')) AS up FROM src WHERE raw IS NOT NULL),
      whole AS (SELECT k, CASE WHEN up LIKE '%NOTAM%' AND NOT regexp_matches(up, '{w}') THEN 'notam' WHEN regexp_matches(up, '\bH24\b') AND NOT regexp_matches(up, '{days}') THEN 'h24' END AS kind FROM t),
      seg AS (SELECT k, trim(unnest(string_split(up, ';'))) AS s, unnest(range(len(string_split(up, ';')))) AS pos FROM t),
      st AS (SELECT k, pos, regexp_matches(s, 'DAILY|DLY') AS daily, regexp_extract(s, '{days}', 1) AS a, regexp_extract(s, '{days}', 2) AS b, regexp_extract(s, '{w}', 1) AS o, regexp_extract(s, '{w}', 2) AS c,
        CASE WHEN regexp_matches(s, '\bH24\b') THEN 'h24' WHEN regexp_matches(s, '{w}') THEN 'window' WHEN regexp_matches(s, '\bCLSD\b|\bCLOSED\b') THEN 'closed' WHEN regexp_matches(s, '\b(O/?R|PPR|ON REQUEST|AS REQUIRED|HX|HO)\b') THEN 'unknown' END AS kind FROM seg),
      mn AS (SELECT *, {_minutes("o")} AS om, {_minutes("c")} AS cm, o IN ('SR', 'SS') AS os, c IN ('SR', 'SS') AS cs FROM st WHERE kind IS NOT NULL),
      ok AS (SELECT *, kind = 'window' AND (os OR om IS NOT NULL) AND (cs OR cm IS NOT NULL) AS fits FROM mn),
      said AS (SELECT k, pos, day, CASE WHEN kind = 'window' AND NOT fits THEN 'unknown' ELSE kind END AS kind, CASE WHEN fits THEN CASE WHEN os THEN lower(o) ELSE 'time' END END AS ot, CASE WHEN fits THEN om END AS om,
        CASE WHEN fits THEN CASE WHEN cs THEN lower(c) ELSE 'time' END END AS ct, CASE WHEN fits THEN cm END AS cm
        FROM ok CROSS JOIN range(7) r(day) WHERE k NOT IN (SELECT k FROM whole WHERE kind IS NOT NULL)
        AND (daily OR a = '' OR (b = '' AND day = {at("a")}) OR (b <> '' AND CASE WHEN {at("b")} >= {at("a")} THEN day BETWEEN {at("a")} AND {at("b")} ELSE day >= {at("a")} OR day <= {at("b")} END)))""" + WEEKS


TEXT_WEEKS = _text_sql(f"SELECT o_orderkey AS k, {HOURS_TEXT} AS raw FROM orders").format(**DUCK, pick="arg_min")
PAGE_WEEKS = _text_sql(
    rf"""SELECT k, CASE WHEN least(n, c) > 1 THEN body[:least(n, c) - 1] END AS raw FROM (SELECT k, body, coalesce(nullif(strpos(lower(body), 'customs'), 0), 99999) AS c,
      CASE WHEN regexp_matches(body, '\s2\s') THEN length(regexp_extract(body, '(?s)^(.*?)\s2\s', 1)) + 1 ELSE 99999 END AS n
      FROM (SELECT k, unnest(regexp_extract_all(page, '(?is)AD\s*2\.3\b(.*?)(?:\bAD\s*2\.(?:4|\d\d)\b)', 1)) AS body FROM (SELECT o_orderkey AS k, {TABLE_PAGE} AS page FROM orders))) WHERE least(n, c) < 99999"""
).format(**DUCK, pick="arg_min")


@query(TEXT_WEEKS + " SELECT * FROM weeks")
def p03_text_week(s: SparkSession, d: str) -> DataFrame:
    return week_rows(table(s, d, "orders").withColumn("raw", F.expr(HOURS_TEXT.format(**SPARK))), "o_orderkey", schedules.text_week(F.col("raw")))


@query(PAGE_WEEKS + " SELECT * FROM weeks")
def p04_operator_row(s: SparkSession, d: str) -> DataFrame:
    """Hours of the operator's row alone; the rows of services that follow don't count, pages whose row has no end say nothing."""
    return week_rows(table(s, d, "orders").withColumn("page", F.expr(TABLE_PAGE.format(**SPARK))), "o_orderkey", schedules.page_week(F.col("page")))


# ---- documents and short notation

PART = "p_partkey"
COST = "CAST(floor(p_retailprice * 7) AS BIGINT)"


def _entry(x: str, y: str) -> str:
    day, colon = f"""'{{{{"dayOfWeek":' || CAST(({y}) % 9 AS STRING)""", lambda i: f"lpad(CAST(({i}) % 26 AS STRING), 2, '0') || CASE WHEN ({i}) % 5 > 0 THEN ':' ELSE '' END || lpad(CAST((({i}) {{div}} 26) % 62 AS STRING), 2, '0')"
    return f"""CASE ({x}) % 9 WHEN 0 THEN '7' WHEN 1 THEN '{{{{"dayOfWeek":"1","byNotam":true}}}}' WHEN 2 THEN {day} || ',"byNotam":true}}}}' WHEN 3 THEN {day} || ',"sunrise":true,"endTime":"' || {colon(y)} || '"}}}}'
      WHEN 4 THEN '{{{{"dayOfWeek":1.5,"byNotam":true}}}}' WHEN 5 THEN {day} || ',"startTime":' || CAST({y} AS STRING) || ',"sunset":true}}}}' WHEN 6 THEN {day} || ',"sunrise":"true","startTime":"' || {colon(x)} || ':30","sunset":true,"byNotam":1}}}}'
      ELSE {day} || ',"startTime":"' || {colon(x)} || '","endTime":"' || {colon(y)} || '"}}}}' END"""


DOCUMENT = f"""CASE WHEN {PART} % 23 = 0 THEN '[1]' ELSE '{{{{"operatingHours":[' || {_entry(PART, COST)} || ',' || {_entry(COST, PART)} || ',' || {_entry(f"{PART} + {COST}", f"{PART} * 5")} || ']' || CASE WHEN {PART} % 19 > 0 THEN '}}}}' ELSE '' END END"""


def _document_sql(colon: str) -> str:
    side = lambda name: f"CASE WHEN json_type(e, '$.{name}') = 'VARCHAR' THEN trim(e ->> '$.{name}') END"
    time = lambda x: f"CASE WHEN regexp_matches({x}, '^[0-9]{{{{2}}}}{colon}[0-9]{{{{2}}}}') AND CAST({x}[:2] AS INTEGER) <= 24 AND CAST(replace({x}, ':', '')[3:4] AS INTEGER) <= 59 THEN CAST({x}[:2] AS INTEGER) * 60 + CAST(replace({x}, ':', '')[3:4] AS INTEGER) END"
    true = lambda name: f"coalesce(json_type(e, '$.{name}') = 'BOOLEAN' AND CAST(e ->> '$.{name}' AS BOOLEAN), false)"
    return f"""WITH src AS (SELECT {PART} AS k, {DOCUMENT} AS raw FROM part), j AS (SELECT k, json(raw) AS j FROM src WHERE json_valid(raw)),
      es AS (SELECT k, unnest(json_extract(j, '$.operatingHours[*]')) AS e, unnest(range(len(json_extract(j, '$.operatingHours[*]')))) AS pos FROM j WHERE json_type(j, '$.operatingHours') = 'ARRAY'),
      fs AS (SELECT k, pos, CAST(e ->> '$.dayOfWeek' AS INTEGER) AS day, {true("byNotam")} AS notam, {true("sunrise")} AS sr, {true("sunset")} AS ss, {side("startTime")} AS a, {side("endTime")} AS b FROM es WHERE json_type(e, '$.dayOfWeek') IN ('UBIGINT', 'BIGINT')),
      ms AS (SELECT *, {time("a")} AS om, {time("b")} AS cm FROM fs WHERE day BETWEEN 0 AND 6), ok AS (SELECT *, NOT notam AND (sr OR om IS NOT NULL) AND (ss OR cm IS NOT NULL) AS fits FROM ms),
      whole AS (SELECT NULL AS k, NULL AS kind WHERE false),
      said AS (SELECT k, pos, day, CASE WHEN notam THEN 'notam' WHEN fits THEN 'window' ELSE 'unknown' END AS kind, CASE WHEN fits THEN CASE WHEN sr THEN 'sr' ELSE 'time' END END AS ot, CASE WHEN fits AND NOT sr THEN om END AS om,
        CASE WHEN fits THEN CASE WHEN ss THEN 'ss' ELSE 'time' END END AS ct, CASE WHEN fits AND NOT ss THEN cm END AS cm FROM ok)""" + WEEKS


@query(_document_sql(":").format(**DUCK, pick="arg_min") + " SELECT * FROM weeks")
def p05_document_week(s: SparkSession, d: str) -> DataFrame:
    return week_rows(table(s, d, "part").withColumn("raw", F.expr(DOCUMENT.format(**SPARK))), PART, schedules.document_week(F.col("raw")))


@query(_document_sql(":?").format(**DUCK, pick="arg_min") + " SELECT * FROM weeks")
def p05_document_week_loose(s: SparkSession, d: str) -> DataFrame:
    """The other reader of the same documents, which takes times without a colon as well."""
    return week_rows(table(s, d, "part").withColumn("raw", F.expr(DOCUMENT.format(**SPARK))), PART, schedules.document_week(F.col("raw"), colon=False))


CUST, BALANCE, LON = "c_custkey", "CAST(floor(abs(c_acctbal)) AS BIGINT)", "CASE WHEN c_custkey % 11 > 0 THEN CAST(c_custkey * 91 % 3600 AS DOUBLE) / 10e0 - 180e0 END"


def _rule(x: str, y: str) -> str:
    day = lambda i: f"substr('MoTuWeThFrSaSu', CAST(({i}) % 7 AS INT) * 2 + 1, 2)"
    at = lambda i: f"CAST(({i}) % 26 AS STRING) || ':' || lpad(CAST((({i}) {{div}} 26) % 62 AS STRING), 2, '0')"
    return f"""CASE ({x}) % 11 WHEN 0 THEN 'Off' WHEN 1 THEN {day(x)} || '-' || {day(y)} || ' ' || {at(y)} || '-' || {at(x)} WHEN 2 THEN {day(f"({x}) {{div}} 11")} || '-' || {day(y)} || '  ' || {at(x)} || '- ' || {at(y)}
      WHEN 3 THEN {day(x)} || ',' || {day(y)} || ' ' || {at(x)} || '-sunset' WHEN 4 THEN 'Sunrise-dusk' WHEN 5 THEN 'PH off' WHEN 6 THEN {day(x)} || ' 24/7' WHEN 7 THEN {at(x)} || ' - ' || {at(y)} WHEN 8 THEN {day(y)} || ' closed'
      WHEN 9 THEN 'Mo - Fr ' || {at(x)} || '-' || {at(y)} ELSE {day(y)} || ' ' || {at(x)} || '-12:00,' || {at(y)} || '-23:00' END"""


NOTATION = f"""CASE WHEN {CUST} % 29 = 0 THEN '24 / 7 "always"' ELSE {_rule(CUST, BALANCE)} || '; ' || {_rule(BALANCE, CUST)} || ' "a note; of two parts";' || {_rule(f"{CUST} + {BALANCE}", f"{CUST} * 3")} END"""


def _notation_sql() -> str:
    lead, days = r"^([A-Za-z]{{2}}(?:\s*[-,]\s*[A-Za-z]{{2}})*)\s+(.+)$", "(mo|tu|we|th|fr|sa|su)"
    at = lambda c: f"(strpos('motuwethfrsasu', {c}) - 1) // 2"
    time = lambda c: f"CASE WHEN regexp_matches({c}, '^[0-9]{{{{1,2}}}}:[0-9]{{{{2}}}}$') AND CAST(split_part({c}, ':', 1) AS INTEGER) <= 24 AND CAST(split_part({c}, ':', 2) AS INTEGER) <= 59 THEN CAST(split_part({c}, ':', 1) AS INTEGER) * 60 + CAST(split_part({c}, ':', 2) AS INTEGER) - CAST(floor(lon / 15 + 0.5) AS INTEGER) * 60 END"
    sun = lambda c: f"CASE WHEN {c} IN ('sunrise', 'dawn') THEN 'sr' WHEN {c} IN ('sunset', 'dusk') THEN 'ss' END"
    return rf"""WITH src AS (SELECT {CUST} AS k, {LON} AS lon, {NOTATION} AS raw FROM customer), t AS (SELECT k, lon, trim(regexp_replace(trim(raw), '"[^"]*"', ' ', 'g')) AS clean FROM src),
      whole AS (SELECT k, CASE WHEN regexp_matches(clean, '^24\s*/\s*7$') THEN 'h24' END AS kind FROM t),
      rules AS (SELECT k, lon, trim(unnest(string_split(clean, ';'))) AS r, unnest(range(len(string_split(clean, ';')))) AS pos FROM t WHERE NOT regexp_matches(clean, '^24\s*/\s*7$')),
      cut AS (SELECT *, CASE WHEN regexp_matches(r, '{lead}') THEN lower(regexp_extract(r, '{lead}', 1)) END AS sel, CASE WHEN regexp_matches(r, '{lead}') THEN trim(regexp_extract(r, '{lead}', 2)) WHEN regexp_matches(r, '(?i)^(24/7|off|closed|sunrise|sunset|dawn|dusk|\d)') THEN r END AS times FROM rules WHERE r <> ''),
      known AS (SELECT *, lower(regexp_extract(times, '^(\S+)\s*-\s*(\S+)$', 1)) AS o, lower(regexp_extract(times, '^(\S+)\s*-\s*(\S+)$', 2)) AS c FROM cut WHERE sel IS NULL OR regexp_matches(sel, '^{days}(-{days})?(,{days}(-{days})?)*$')),
      ms AS (SELECT *, {sun("o")} AS os, {sun("c")} AS cs, {time("o")} AS om, {time("c")} AS cm FROM known),
      ok AS (SELECT k, pos, sel, CASE WHEN regexp_matches(times, '(?i)^(off|closed)$') THEN 'closed' WHEN times = '24/7' THEN 'h24' WHEN (os IS NOT NULL OR om BETWEEN 0 AND 1440) AND (cs IS NOT NULL OR cm BETWEEN 0 AND 1440) THEN 'window' END AS kind, os, om, cs, cm FROM ms),
      sels AS (SELECT *, unnest(string_split(coalesce(sel, 'mo-su'), ',')) AS part FROM ok WHERE kind IS NOT NULL),
      said AS (SELECT DISTINCT k, pos, day, kind, CASE WHEN kind = 'window' THEN coalesce(os, 'time') END AS ot, CASE WHEN kind = 'window' AND os IS NULL THEN om END AS om, CASE WHEN kind = 'window' THEN coalesce(cs, 'time') END AS ct, CASE WHEN kind = 'window' AND cs IS NULL THEN cm END AS cm
        FROM sels CROSS JOIN range(7) r(day) WHERE CASE WHEN {at("part[-2:]")} >= {at("part[:2]")} THEN day BETWEEN {at("part[:2]")} AND {at("part[-2:]")} ELSE day >= {at("part[:2]")} OR day <= {at("part[-2:]")} END)""" + WEEKS


@query(_notation_sql().format(**DUCK, pick="arg_max") + " SELECT * FROM weeks")
def p06_notation_week(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").withColumn("raw", F.expr(NOTATION.format(**SPARK))).withColumn("lon", F.expr(LON))
    return week_rows(c, CUST, schedules.notation_week(F.col("raw"), F.col("lon")))


# ---- what is asked of hours


@query(TEXT_WEEKS + """, fixed AS (SELECT k, day, CASE WHEN kind = 'h24' THEN '00:00' ELSE printf('%02d:%02d', open_m % 1441 // 60, open_m % 1441 % 60) END AS opens, CASE WHEN kind = 'h24' THEN '23:59' ELSE printf('%02d:%02d', close_m % 1441 // 60, close_m % 1441 % 60) END AS closes
          FROM weeks WHERE kind = 'h24' OR (open_t = 'time' AND close_t = 'time')) SELECT k, opens, closes, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS days FROM fixed GROUP BY k, opens, closes""")
def a20_specification(s: SparkSession, d: str) -> DataFrame:
    """Days that share a fixed window, as one row of the specification."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), schedules.text_week(F.expr(HOURS_TEXT.format(**SPARK))).alias("w"))
    return o.select("k", F.explode(schedules.specification(F.col("w"))).alias("g")).select("k", "g.opens", "g.closes", F.array_join("g.days", ",").alias("days"))


@query(f"""SELECT event_id, known AND (event_id % 2 > 0 OR (kind = 'h24' OR (kind = 'window' AND c > o AND m >= o AND m < c))) AND (t IS NULL OR (kind = 'h24' OR (kind = 'window' AND c > o AND o <= t AND c >= t))) OR (event_id % 2 > 0 AND t IS NULL) AS shown
          FROM (SELECT *, {KIND} AS kind FROM (SELECT event_id, user_id, user_id % 7 > 0 AS known, event_id % 7 AS d, user_id % 10 * 60 AS o, user_id % 10 * 60 + user_id % 13 * 60 - 60 AS c, hour(ts) * 60 + minute(ts) AS m, CASE WHEN event_id % 3 > 0 THEN event_id % 24 * 60 END AS t FROM events))""")
def f13_hours_filter(s: SparkSession, d: str) -> DataFrame:
    """Open now and open until, each on or off, on the weekday that was chosen."""
    i = F.col("event_id")
    week = F.when(F.col("user_id") % 7 > 0, _week(F.col("user_id")))
    until = F.when(i % 3 > 0, (i % 24 * 60).cast("int"))
    shown = schedules.matches(week, F.lit(50.0), F.lit(8.0), F.col("ts").cast("timestamp"), (i % 7).cast("int"), i % 2 == 0, until)
    return table(s, d, "events").select("event_id", F.coalesce(shown, F.lit(False)).alias("shown"))


LAST_SUNDAY = "last_day(make_date(year(o_orderdate), {m}, 1)) - CAST(isodow(last_day(make_date(year(o_orderdate), {m}, 1))) % 7 AS INTEGER)"
SUMMER = f"(CAST(o_orderdate AS DATE) >= {LAST_SUNDAY.format(m=3)} AND CAST(o_orderdate AS DATE) < CASE WHEN year(o_orderdate) <= 1995 THEN {LAST_SUNDAY.format(m=9)} ELSE {LAST_SUNDAY.format(m=10)} END)"


def _noon() -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 43200)


@query(f"""SELECT o_orderkey, CAST(o_orderkey % 600 + CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 4 > 0 AND {SUMMER} THEN 1000 ELSE 0 END AS INTEGER) AS opens FROM orders""")
def d10_seasonal(s: SparkSession, d: str) -> DataFrame:
    """Monday's opening of the week that holds at noon of a day; places without a summer week, and zones without summer time, keep the winter's."""
    k = F.col("o_orderkey")
    week = lambda m: F.array_repeat(schedules.day("window", hours.bound(m.cast("int")), hours.bound(F.lit(1439), "close")), 7)
    zone = F.when(k % 4 == 0, "UTC").otherwise("Europe/Berlin")
    own = schedules.seasonal(week(k % 600), F.when(k % 3 > 0, week(k % 600 + 1000)), zone, _noon())
    return table(s, d, "orders").select("o_orderkey", F.get(own, F.lit(0))["open"]["m"].alias("opens"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'UTC' ELSE 'Europe/Berlin' END AS z, o_orderkey % 4 > 0 AND {SUMMER} AS dst FROM orders""")
def d09_dst(s: SparkSession, d: str) -> DataFrame:
    zone = F.when(F.col("o_orderkey") % 4 == 0, "UTC").otherwise("Europe/Berlin")
    return table(s, d, "orders").select("o_orderkey", zone.alias("z"), dates.dst_active(zone, _noon()).alias("dst"))


CLOCKS = f"""CASE {K} % 6 WHEN 0 THEN ' ' ELSE '' END || lpad(CAST({P} % 27 AS STRING), CASE WHEN {K} % 13 = 0 THEN 1 ELSE 2 END, '0') || CASE WHEN {K} % 3 = 0 THEN '' ELSE ':' END || lpad(CAST({K} % 63 AS STRING), 2, '0') || CASE {K} % 7 WHEN 0 THEN ':59' ELSE '' END"""


def _clock_sql(colon: str) -> str:
    x = rf"regexp_extract(trim(raw), '^(\d\d){colon}(\d\d)', {{i}})"
    h, m = (f"CAST(nullif({x.format(i=i)}, '') AS INTEGER)" for i in (1, 2))
    return f"CASE WHEN {h} <= 24 AND {m} <= 59 THEN {h} * 60 + {m} END"


@query(f"SELECT k, {_clock_sql(':')} AS strict, {_clock_sql(':?')} AS loose, printf('%02d:%02d', m // 60, m % 60) AS told FROM (SELECT o_orderkey AS k, {CLOCKS} AS raw, ((({P} % 3000 - 700) % 1441) + 1441) % 1441 AS m FROM orders)")
def d16_clock(s: SparkSession, d: str) -> DataFrame:
    raw = F.expr(CLOCKS)
    told = dates.clock_of(F.expr(f"CAST({P} % 3000 - 700 AS INT)"))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), dates.clock_minutes(raw).alias("strict"), dates.clock_minutes(raw, colon=False).alias("loose"), told.alias("told"))


# ---- declared distances


def _value(x: str) -> str:
    return f"CASE WHEN ({x}) % 5 = 0 THEN 'NIL' ELSE CAST(({x}) % 4000 AS STRING) END || CASE WHEN ({x}) % 7 = 0 THEN ' T_DIST;VAL;' || CAST({x} AS STRING) || ' M' WHEN ({x}) % 31 = 0 THEN ' x' ELSE '' END"


def _runway_row(x: str, y: str) -> str:
    side = f"CASE ({x}) % 6 WHEN 0 THEN 'L' WHEN 1 THEN 'R' WHEN 2 THEN 'G' ELSE '' END"
    values = " || ' ' || ".join(_value(f"{y} {{div}} {n} + {n}") for n in (1, 3, 7, 20))
    return f"lpad(CAST(({x}) % 40 AS STRING), CASE WHEN ({x}) % 9 = 0 AND ({x}) % 40 < 10 THEN 1 ELSE 2 END, '0') || {side} || ' ' || {values} || CASE ({y}) % 4 WHEN 0 THEN ' NIL ' WHEN 1 THEN ' DTHR 50 M. ' WHEN 2 THEN ' 12 34 ' ELSE ' ' END"


DISTANCES = f"""CASE WHEN {K} % 17 > 0 THEN CASE {K} % 3 WHEN 0 THEN '01 1 2 3 4 RWY (M) Remarks 1 2  3 4 5 6 ' WHEN 1 THEN 'RWY Remarks none ' ELSE '' END
  || {_runway_row(K, P)} || {_runway_row(P, K)} || {_runway_row(f"{K} + 1", f"{K} + {P}")} || {_runway_row(K, f"{P} * 3")} || {_runway_row(f"{P} {{div}} 3", f"{P} + 5")} END"""


@query(
    rf"""WITH RECURSIVE src AS (SELECT o_orderkey AS k, {DISTANCES} AS raw FROM orders), bare AS (SELECT k, regexp_replace(regexp_replace(raw, '[A-Z][A-Z0-9_]*;[^\s;]+;\d+', ' ', 'g'), '\bM\b', ' ', 'g') AS t FROM src WHERE raw IS NOT NULL),
      body AS (SELECT k, CASE WHEN regexp_matches(t, '(?s)\bRemarks\b.*?\b1\s+2\s+3\s+4\s+5\s+6\b') THEN regexp_extract(t, '(?s)^.*?\bRemarks\b.*?\b1\s+2\s+3\s+4\s+5\s+6\b(.*)$', 1) ELSE t END AS t FROM bare),
      ws AS (SELECT k, regexp_extract_all(t, '\S+') AS w FROM body), tok AS (SELECT k, unnest(w) AS w, unnest(range(len(w))) AS i FROM ws),
      flags AS (SELECT k, i, w, regexp_matches(w, '^(0?[1-9]|[12][0-9]|3[0-6])[LRCG]?$') AS name, regexp_matches(w, '^(NIL|[0-9]+)$') AS num FROM tok),
      near AS (SELECT *, lead(num, 1, false) OVER o AND lead(num, 2, false) OVER o AND lead(num, 3, false) OVER o AND lead(num, 4, false) OVER o AS four, lead(w, 1) OVER o AS a, lead(w, 2) OVER o AS b, lead(w, 3) OVER o AS c, lead(w, 4) OVER o AS e FROM flags WINDOW o AS (PARTITION BY k ORDER BY i)),
      cand AS (SELECT * FROM near WHERE name AND four), nx AS (SELECT c.k, c.i, min(d.i) AS j FROM cand c JOIN cand d ON c.k = d.k AND c.i + 5 <= d.i GROUP BY c.k, c.i),
      f AS (SELECT k, min(i) AS i FROM cand GROUP BY k UNION ALL SELECT f.k, nx.j FROM f JOIN nx ON nx.k = f.k AND nx.i = f.i),
      rws AS (SELECT k, i, lpad(regexp_extract(w, '^[0-9]+'), 2, '0') || regexp_extract(w, '[LRCG]?$') AS runway, TRY_CAST(a AS BIGINT) AS tora, TRY_CAST(b AS BIGINT) AS toda, TRY_CAST(c AS BIGINT) AS asda, TRY_CAST(e AS BIGINT) AS lda FROM f JOIN cand USING (k, i))
      SELECT k, runway, tora, toda, asda, lda FROM rws WHERE coalesce(tora, toda, asda, lda) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, runway ORDER BY i) = 1""".replace("{div}", "//").replace("{{", "{").replace("}}", "}")
)
def p08_declared_distances(s: SparkSession, d: str) -> DataFrame:
    """Rows of a table among marks, units, remarks and numbers of its head; a row takes its five tokens away from the next."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.explode(distances.declared(F.expr(DISTANCES.format(**SPARK)))).alias("x"))  # of a column, Spark would filter on its size as well
    return o.select("k", "x.*")
