"""Queries that write tables as the files of others, some lines of them broken, and read them back; guarded commits; community items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import community
from fieldloom.operators import commits
from fieldloom.plans.registry import query
from fieldloom.session import new_path, table
from fieldloom.sources import files

CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

# ---- delimited files

_HEIGHT = "CASE WHEN c_custkey % 7 = 0 THEN 'x' || CAST(c_custkey AS STRING) WHEN c_custkey % 7 > 1 THEN CAST(c_custkey * 3 AS STRING) END"
_NAME = """CASE WHEN c_custkey % 5 > 0 THEN '"' || c_name || '", ' || c_mktsegment END"""
_HEIGHT_READ = "CASE WHEN c_custkey % 7 > 1 THEN c_custkey * 3 END"


@query(
    f"""SELECT c_custkey AS id, {_HEIGHT_READ} AS elevation_ft, {_NAME} AS name, CAST(NULL AS VARCHAR) AS home, false AS bad FROM customer
        UNION ALL SELECT c_custkey, {_HEIGHT_READ}, NULL, NULL, true FROM customer WHERE c_custkey % 10 = 0"""
)
def s02_csv_source(s: SparkSession, d: str) -> DataFrame:
    """Customers as delimited files with quotes, commas and junk; rows of files of an older layout, with a column less, are told apart."""
    landed = new_path(s, "csv")
    c = table(s, d, "customer")
    c.selectExpr("c_custkey AS id", f"{_HEIGHT} AS elevation_ft", f"{_NAME} AS name").write.options(**CSV).csv(landed)
    c.filter("c_custkey % 10 = 0").selectExpr("c_custkey AS id", f"{_HEIGHT} AS elevation_ft").write.mode("append").options(**CSV).csv(landed)
    columns = {"id": "bigint", "elevation_ft": "bigint", "name": "string", "home": "string"}
    rows = files.csv_rows(s, landed, columns, names=["id", "elevation_ft", "name"])
    return rows.select(*columns, F.col(files.BAD).isNotNull().alias("bad"))


_CODE = "'L' || chr(65 + CAST(c_custkey % 26 AS INT)) || chr(65 + CAST(c_custkey % 7 AS INT)) || 'S'"
_SCAN = {
    "id": "c_custkey",
    "icao_code": f"CASE c_custkey % 3 WHEN 0 THEN lower({_CODE}) || ' ' WHEN 1 THEN NULL ELSE {_CODE} || '9' END",
    "ident": f"CASE c_custkey % 4 WHEN 0 THEN 'CH-0001' ELSE {_CODE} END",
    "iso_country": "CASE c_custkey % 5 WHEN 0 THEN 'DE' WHEN 1 THEN ' ch ' ELSE 'CH' END",
    "type": "CASE c_custkey % 6 WHEN 0 THEN 'heliport' WHEN 1 THEN 'closed' WHEN 2 THEN 'small_airport ' WHEN 3 THEN 'medium_airport' ELSE 'large_airport' END",
    "name": "CASE WHEN c_custkey % 8 > 0 THEN c_name END",
}


@query(
    f"""SELECT 'CH' AS country, icao, ltrim(coalesce(arg_min(coalesce(name, ''), k), '') || ' ' || icao) AS title, 'https://example.org/aip' AS url, 'vfr' AS type FROM (SELECT c_custkey AS k, {_SCAN["name"]} AS name, {_CODE} AS icao
        FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 6 > 1 AND (c_custkey % 3 = 0 OR c_custkey % 4 > 0)) GROUP BY icao"""
)
def s03_filtered_scan(s: SparkSession, d: str) -> DataFrame:
    """Aerodromes of one country out of delimited files: class, valid code, first in the files wins."""
    landed = new_path(s, "aerodromes")
    table(s, d, "customer").orderBy("c_custkey").selectExpr(*[f"{e} AS {c}" for c, e in _SCAN.items()]).write.options(**CSV).csv(landed)
    rows = files.csv_rows(s, landed, {c: "string" for c in _SCAN})
    return files.aerodromes(rows, "CH", ("small_airport", "medium_airport", "large_airport"), "https://example.org/aip")


# ---- JSON lines

_OBSERVED = """'{"icaoId":"ED' || CAST(user_id AS STRING) || '","rawOb":' || CASE event_id % 6 WHEN 0 THEN '7' WHEN 1 THEN 'null' ELSE '"METAR ' || CAST(event_id AS STRING) || '"' END
  || ',"wdir":' || CASE event_id % 3 WHEN 0 THEN '"VRB"' WHEN 1 THEN CAST(event_id % 360 AS STRING) ELSE '{}' END || ',"wspd":' || CASE event_id % 4 WHEN 0 THEN '"5"' ELSE CAST(event_id % 40 AS STRING) END
  || ',"altim":' || CAST(event_id % 50 + 1000 AS STRING) || CASE event_id % 7 WHEN 0 THEN '.5' WHEN 1 THEN '.49' ELSE '' END
  || ',"clouds":' || CASE event_id % 5 WHEN 0 THEN '[{"cover":"FEW","base":' || CAST(event_id % 90 AS STRING) || '},{"cover":7,"base":"x"}]' WHEN 1 THEN '{}' ELSE 'null' END || CASE WHEN event_id % 11 > 0 THEN '}' ELSE '' END"""


@query(
    """SELECT 'ED' || CAST(user_id AS VARCHAR) AS icao, 'METAR ' || CAST(event_id AS VARCHAR) AS raw, CASE event_id % 3 WHEN 0 THEN 'VRB' WHEN 1 THEN CAST(event_id % 360 AS VARCHAR) END AS wdir,
        CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 40 AS DOUBLE) END AS wspd, event_id % 50 + 1000 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS altim,
        CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS n_clouds, CASE WHEN event_id % 5 = 0 THEN 'FEW ' || CAST(CAST(event_id % 90 AS DOUBLE) AS VARCHAR) || ' ? ?' ELSE '' END AS clouds
        FROM events WHERE event_id % 11 > 0 AND event_id % 6 > 1"""
)
def s11_observations(s: SparkSession, d: str) -> DataFrame:
    """Station observations as JSON lines, some cut off, with fields of wrong types, read back field by field."""
    landed = new_path(s, "observations")
    table(s, d, "events").selectExpr(f"{_OBSERVED} AS value").write.text(landed)
    o = files.observations(files.json_rows(s, landed))
    layer = lambda c: F.concat_ws(" ", F.coalesce(c["cover"], F.lit("?")), F.coalesce(c["base"].cast("string"), F.lit("?")))
    return o.select("icao", "raw", "wdir", "wspd", "altim", F.size("clouds").alias("n_clouds"), F.array_join(F.transform("clouds", layer), " ").alias("clouds"))


# ---- guarded commits


@query(
    """WITH one AS (SELECT c_mktsegment AS g, c_custkey AS k FROM customer WHERE c_mktsegment <> 'MACHINERY'), two AS (SELECT c_mktsegment AS g, c_custkey AS k FROM customer
         WHERE c_custkey % 10 >= CASE c_mktsegment WHEN 'BUILDING' THEN 8 WHEN 'AUTOMOBILE' THEN 3 ELSE 0 END AND c_mktsegment <> 'FURNITURE'),
       v AS (SELECT *, CASE WHEN last IS NULL THEN 'pass' WHEN n < last * 0.5 THEN 'block' WHEN n < last * 0.85 THEN 'warn' ELSE 'pass' END AS verdict
         FROM (SELECT g, count(*) AS n FROM two GROUP BY g) LEFT JOIN (SELECT g, count(*) AS last FROM one GROUP BY g) USING (g)),
       after AS (SELECT g, k FROM two WHERE g IN (SELECT g FROM v WHERE verdict <> 'block') UNION ALL SELECT g, k FROM one WHERE g NOT IN (SELECT g FROM v WHERE verdict <> 'block'))
       SELECT g, coalesce(verdict, 'absent') AS verdict, published, keys, published AS base FROM (SELECT g, count(*) AS published, CAST(sum(k) AS BIGINT) AS keys FROM after GROUP BY g) LEFT JOIN v USING (g)"""
)
def s15_guarded_commit(s: SparkSession, d: str) -> DataFrame:
    """Two batches by segment: the second one is cut short for some, lacks one and brings a new one."""
    published, state = new_path(s, "published"), new_path(s, "state")
    c = table(s, d, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("k"))
    commits.commit(c.filter("g <> 'MACHINERY'"), published, state, "g")
    verdicts = commits.commit(c.filter("g <> 'FURNITURE' and k % 10 >= CASE g WHEN 'BUILDING' THEN 8 WHEN 'AUTOMOBILE' THEN 3 ELSE 0 END"), published, state, "g")
    now = s.read.schema("k bigint, g string").parquet(published).groupBy("g").agg(F.count(F.lit(1)).alias("published"), F.sum("k").alias("keys"))
    base = commits.baseline(s, state, "g").withColumnRenamed("n", "base")
    return now.join(base, "g", "left").join(verdicts.select("g", "verdict"), "g", "left").select("g", F.coalesce("verdict", F.lit("absent")).alias("verdict"), "published", "keys", "base")


# ---- community items

K, P = "o_orderkey", "CAST(floor(o_totalprice) AS BIGINT)"
_TEXTS = f"""CASE {K} % 6 WHEN 0 THEN '{{"a":' || CAST({K} AS STRING) || '}}' WHEN 1 THEN '[{{"a":1}}]' WHEN 2 THEN CAST({K} AS STRING) WHEN 3 THEN '{{"a":' WHEN 4 THEN '{{"a":"' || CAST({K} AS STRING) || '"}}' END"""


@query(f"SELECT {K} AS k, coalesce({K} % 6 IN (0, 4), false) AS object, CASE WHEN {K} % 6 = 0 THEN CAST({K} AS DOUBLE) END AS a FROM orders")
def n03_json_object(s: SparkSession, d: str) -> DataFrame:
    """Objects alone are kept of JSON texts; lists, numbers and what breaks off are null."""
    o = table(s, d, "orders").select(F.col(K).alias("k"), community.json_object(F.expr(_TEXTS)).alias("v"))
    return o.select("k", F.col("v").isNotNull().alias("object"), community.json_number(F.col("v"), "$.a").alias("a"))


_LENGTH = f"""'{{"value":' || CASE {P} % 5 WHEN 0 THEN '"800"' WHEN 1 THEN CAST({P} % 4000 AS STRING) || '.5' ELSE CAST({P} % 4000 AS STRING) END || ',"unit":' || CAST({K} % 3 AS STRING) || '}}'"""
ITEMS = f"""CASE WHEN {K} % 19 > 0 THEN '{{"geometry":{{"coordinates":' || CASE {K} % 4 WHEN 0 THEN '"x"' WHEN 1 THEN '[' || CAST({P} % 180 AS STRING) || '.25,"5"]' ELSE '[' || CAST({P} % 180 AS STRING) || '.5,' || CAST({K} % 90 AS STRING) || ']' END
  || '}},"elevation":' || CASE {K} % 5 WHEN 0 THEN 'null' ELSE {_LENGTH} END || ',"ppr":' || CASE {P} % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '"true"' ELSE '1' END
  || CASE {K} % 3 WHEN 0 THEN ',"services":{{"fuelTypes":[' || CAST({P} % 9 AS STRING) || ',"1",3],"passengerFacilities":[' || CAST({K} % 7 AS STRING) || ',"5",2.5]}}' WHEN 1 THEN ',"services":{{"fuelTypes":null}},"fuelTypes":[1,' || CAST({K} % 8 AS STRING) || ']' ELSE ',"services":7,"fuelTypes":"1"' END
  || ',"type":' || CASE {P} % 3 WHEN 0 THEN '"3"' ELSE CAST({P} % 13 AS STRING) END
  || ',"runways":' || CASE {P} % 4 WHEN 0 THEN '{{}}' ELSE '[{{"designator":"' || lpad(CAST({K} % 36 AS STRING), 2, '0') || '","dimension":{{"length":' || {_LENGTH} || ',"width":7}},"surface":{{"mainComposite":' || CAST({P} % 24 AS STRING) || '}},"turnDirection":' || CAST({K} % 4 AS STRING)
    || '}},{{"designator":' || CASE {K} % 3 WHEN 0 THEN '""' WHEN 1 THEN '9' ELSE '"18","turnDirection":"0","surface":{{"mainComposite":1.5}}' END || '}},5]' END
  || ',"frequencies":' || CASE {K} % 4 WHEN 0 THEN 'null' ELSE '[{{"value":"118.' || CAST({P} % 1000 AS STRING) || '","type":' || CAST({P} % 28 AS STRING) || CASE {P} % 3 WHEN 0 THEN ',"name":"TWR"' ELSE '' END || '}},{{"value":' || CASE {P} % 2 WHEN 0 THEN '121.5' ELSE '""' END || '}},{{"value":"121.5","type":"14"}}]' END
  || CASE WHEN {K} % 23 > 0 THEN '}}' ELSE '' END END""".replace("{{", "{").replace("}}", "}")


def _items_sql() -> str:
    num = lambda j, p="$": f"(CASE WHEN json_type({j}, '{p}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract({j}, '{p}') AS DOUBLE) END)"
    txt = lambda j, p="$": f"(CASE WHEN json_type({j}, '{p}') = 'VARCHAR' THEN json_extract_string({j}, '{p}') END)"
    label = lambda x, t: f"(CASE {x} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in t.items()) + " END)"
    feet = lambda j, p: f"CAST(floor({num(j, p + '.value')} * CASE WHEN {num(j, p + '.unit')} = 1 THEN 1 ELSE 3.28084::DOUBLE END + 0.5) AS BIGINT)"
    told = lambda *xs: " || '/' || ".join(f"coalesce(CAST({x} AS VARCHAR), '-')" for x in xs)
    has = lambda n: f"CASE WHEN json_type(j, '$.services.passengerFacilities') = 'ARRAY' THEN len(list_filter(json_extract(j, '$.services.passengerFacilities[*]'), lambda x: {num('x')} = {n})) > 0 END"
    each = lambda p, f, keep: f"array_to_string(list_transform(list_filter(json_extract(j, '{p}[*]'), lambda x: {keep}), lambda x: {f}), ';')"
    fuel = f"CASE WHEN coalesce(json_type(j, '$.services.fuelTypes'), 'NULL') = 'NULL' THEN {each('$.fuelTypes', label(num('x'), community.FUEL), label(num('x'), community.FUEL) + ' IS NOT NULL')} ELSE {each('$.services.fuelTypes', label(num('x'), community.FUEL), label(num('x'), community.FUEL) + ' IS NOT NULL')} END"
    runway = told(txt("x", "$.designator"), feet("x", "$.dimension.length"), feet("x", "$.dimension.width"), label(num("x", "$.surface.mainComposite"), community.SURFACE), label(num("x", "$.turnDirection"), community.PATTERN))
    frequency = told(f"coalesce({txt('x', '$.name')}, {label(num('x', '$.type'), community.FREQUENCY)}, '')", txt("x", "$.name"), txt("x", "$.value"))
    return f"""WITH src AS (SELECT {K} AS k, {ITEMS} AS raw FROM orders), js AS (SELECT k, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM src)
      SELECT k, {num('j', '$.geometry.coordinates[1]')} AS lat, {num('j', '$.geometry.coordinates[0]')} AS lon, {feet('j', '$.elevation')} AS elevation_ft,
      CASE WHEN json_type(j, '$.ppr') = 'BOOLEAN' THEN CAST(json_extract(j, '$.ppr') AS BOOLEAN) END AS ppr, coalesce({fuel}, '') AS fuel, {has(5)} AS restaurant, {has(2)} AS customs, {num('j', '$.type')} AS aerodrome_type,
      coalesce({each('$.runways', runway, txt('x', '$.designator') + " <> ''")}, '') AS runways, coalesce({each('$.frequencies', frequency, txt('x', '$.value') + " <> ''")}, '') AS frequencies FROM js"""


@query(_items_sql())
def n04_community_facts(s: SparkSession, d: str) -> DataFrame:
    """Items with wrong types, absent lists and broken texts, normalised."""
    o = table(s, d, "orders").select(F.col(K).alias("k"), community.json_object(F.expr(ITEMS)).alias("doc"))
    told = lambda x, *names: F.concat_ws("/", *[F.coalesce(x[n].cast("string"), F.lit("-")) for n in names])
    runway = lambda x: told(x, "ident", "length_ft", "width_ft", "surface", "traffic_pattern")
    joined = {"fuel": F.col("fuel"), "runways": F.transform("runways", runway), "frequencies": F.transform("frequencies", lambda x: told(x, "type", "description", "mhz"))}
    return community.facts(o, "doc").withColumns({c: F.array_join(x, ";") for c, x in joined.items()})
