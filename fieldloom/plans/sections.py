"""Sections of aerodrome texts: documents with marks put among their words, and numbers under labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import sections
from fieldloom.functions.common import known, let
from fieldloom.plans.registry import query
from fieldloom.session import table

# every fortieth space of a text's words becomes a mark, a title or a number, by where it stands
_N = "(doc_id + i)"
_MARK = f"CASE {_N} % 6 WHEN 0 THEN 'AD 2.' WHEN 1 THEN 'ad 2 ' WHEN 2 THEN 'AD2' WHEN 3 THEN 'AD  2. ' WHEN 4 THEN 'XAD 2.' ELSE 'AD 2.' END || CAST({_N} * 7 % 26 AS STRING)"
_ECHO = f"CASE {_N} % 5 WHEN 0 THEN ' Operational  HOURS: ' WHEN 1 THEN ' Aerodrome geographical and administrative data. ' WHEN 2 THEN ' Flight procedures - ' ELSE ' ' END"
_ITEMS = f"CASE {_N} % 3 WHEN 0 THEN '1. Tel: 2.5 NM 2.1 Nacht 12.Ab 0.5 KM ' WHEN 1 THEN 'TELEFON: +49 (0) 89/1234-' || CAST({_N} % 1000 AS STRING) || ' TEL 12 ' ELSE 'TELEFAX 0891234567 TEL. 123456789 ' END"
SQL_MARK = r"(?i)\bAD\s*2\.?\s*([0-9]{1,2})\b"
TEXTS = f"""SELECT doc_id, string_agg(piece, ' ' ORDER BY i) AS t FROM (SELECT doc_id, i, array_to_string(ws[i * 40 + 1:i * 40 + 40], ' ') || ' ' || {_MARK} || {_ECHO} || {_ITEMS} AS piece
            FROM (SELECT doc_id, ws, unnest(range((len(ws) + 39) // 40)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9.]+') AS ws FROM documents WHERE text IS NOT NULL))) GROUP BY doc_id"""
_UNTITLED = r"trim(regexp_replace({body}, '(?i)^' || replace({title}, ' ', '\s+') || '[\s.,:;-]*', ''))"


def _texts(s: SparkSession, d: str) -> DataFrame:
    words = let(F.regexp_extract_all("text", F.lit("[A-Za-z0-9.]+"), F.lit(0)), lambda ws: F.when(F.size(ws) > 0, ws))
    pieces = "transform(IF(size(ws) > 0, sequence(0, cast(ceil(size(ws) / 40) as int) - 1), array()), i -> concat(array_join(slice(ws, i * 40 + 1, 40), ' '), ' ', " + f"{_MARK} || {_ECHO} || {_ITEMS}))"
    return table(s, d, "documents").filter("text is not null").select("doc_id", known(words).alias("ws")).select("doc_id", F.array_join(F.expr(pieces), " ").alias("t"))


@query(
    rf"""WITH texts AS ({TEXTS}), marks AS (SELECT doc_id, t, regexp_extract_all(t, '{SQL_MARK}', 1) AS codes, regexp_replace(t, '{SQL_MARK}', chr(1), 'g') AS cut FROM texts),
      parts AS (SELECT doc_id, codes, unnest(string_split(cut, chr(1))) AS raw, unnest(range(len(codes) + 1)) AS i FROM marks WHERE len(codes) > 0),
      named AS (SELECT doc_id, CAST(i AS INTEGER) AS nth, codes[i] AS c, trim(raw) AS body, len(codes) > i AS more,
        coalesce(CASE WHEN i > 0 AND codes[i][1] <> '0' THEN {list(sections.TITLES["en"])}[CAST(codes[i] AS INTEGER)] END, 'Further AIP information') AS title FROM parts)
      SELECT doc_id, nth, CASE WHEN nth > 0 THEN '2.' || c END AS code, title, CASE WHEN nth > 0 THEN {_UNTITLED.format(body="body", title="title")} ELSE body END AS body,
        coalesce(c IN ('1', '2', '3', '11', '12', '13', '18') AND more, false) AS redundant FROM named WHERE nth > 0 OR len(regexp_extract_all(body, '\b[a-zäöü]{{3,}}\b')) >= 2"""
)
def p12_sections(s: SparkSession, d: str) -> DataFrame:
    """Documents with marks among their words, cut into titled sections."""
    return sections.sections(_texts(s, d), "t")


@query(
    rf"""WITH texts AS ({TEXTS}), one AS (SELECT doc_id, regexp_replace(t, '(^|[^\d.])(\d{{1,2}}\.(?:\d{{1,2}})?\s+[A-ZÄÖÜ][a-zäöü])', '\1' || chr(1) || '\2', 'g') AS t FROM texts),
      two AS (SELECT doc_id, regexp_replace(t, '(^|[^\d.\x01])(\d{{1,2}}\.(?:\d{{1,2}})?\s+[A-ZÄÖÜ][a-zäöü])', '\1' || chr(1) || '\2', 'g') AS t FROM one),
      xs AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS item FROM two)
      SELECT doc_id, count(*) AS n, max(length(item)) AS longest, md5(string_agg(item, '|' ORDER BY item)) AS items FROM xs GROUP BY doc_id"""
)
def p13_items(s: SparkSession, d: str) -> DataFrame:
    """Numbered items of the same texts, told by their number and digest."""
    some = let(sections.items(F.col("t")), lambda x: F.when(F.size(x) > 0, x))
    x = _texts(s, d).select("doc_id", known(some).alias("x"))
    longest = F.array_max(F.transform("x", F.length)).cast("long")
    return x.select("doc_id", F.size("x").cast("long").alias("n"), longest.alias("longest"), F.md5(F.array_join(F.array_sort("x"), "|").cast("binary")).alias("items"))


@query(
    rf"""WITH texts AS ({TEXTS}), m AS (SELECT doc_id, regexp_extract_all(t, '{SQL_MARK}', 1) AS codes, string_split(regexp_replace(t, '{SQL_MARK}', chr(1), 'g'), chr(1)) AS bodies FROM texts),
      b AS (SELECT doc_id, CASE WHEN list_contains(codes, '2') THEN {_UNTITLED.format(body="trim(bodies[list_position(codes, '2') + 1])", title="'Aerodrome geographical and administrative data'")} END AS body FROM m),
      f AS (SELECT doc_id, trim(regexp_replace(regexp_extract(body, '(?i)\bTEL(?:EFON)?\s*[:.]?\s*(\+?\(?\d[\d\s()/.-]{{5,}}\d)', 1), '\s+', ' ', 'g')) AS p FROM b)
      SELECT doc_id, CASE WHEN len(regexp_extract_all(p, '\d')) BETWEEN 7 AND 15 THEN p END AS phone FROM f"""
)
def p14_phone(s: SparkSession, d: str) -> DataFrame:
    """Numbers behind a telephone's label, of section 2.2 alone."""
    return _texts(s, d).select("doc_id", sections.phone(F.col("t")).alias("phone"))
