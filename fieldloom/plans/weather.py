"""Weather reports: made from keys and prices of orders, decoded over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import weather
from fieldloom.plans.registry import query
from fieldloom.session import table

K, P = "o_orderkey", "CAST(floor(o_totalprice) AS BIGINT)"


def _one_of(x: str, *values: str) -> str:
    return "CASE (" + x + f") % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _digits(x: str, most: int, width: int) -> str:
    return f"lpad(CAST(({x}) % {most} AS STRING), {width}, '0')"


LANG = f"CASE {K} % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' END"
_UNIT = _one_of(P, "KT", "MPS", "MPH", "KN")
_WIND = (
    f"CASE {P} % 5 WHEN 0 THEN '00000KT' WHEN 1 THEN 'VRB' || {_digits(K, 40, 2)} || {_UNIT} "
    f"WHEN 2 THEN {_digits(K + ' * 10', 370, 3)} || {_digits(P, 70, 2)} || 'G' || {_digits(K + ' + ' + P, 110, 3)} || {_UNIT} "
    f"WHEN 3 THEN {_digits(K + ' * 10', 370, 3)} || {_digits(P, 120, 3)} || {_UNIT} ELSE {_digits(P, 360, 3)} || 'V' || {_digits(K, 360, 3)} END"
)
_PHENOMENA = [k for k in weather.EN if len(k) == 2 and k.isupper() and k not in ("VC", "MI", "PR", "BC", "DR", "BL", "SH", "TS", "FZ")]
REPORT = f"""CASE WHEN {K} % 29 > 0 THEN {_one_of(K, '', 'METAR ', 'SPECI ', 'TAF AMD ', 'METAR COR ')} || {_one_of(P, 'AUTO ', '', ' ')} || {_one_of(K + ' + ' + P, 'EDNY ', 'LFPG ', 'XY12 EDDF ', '')}
  || {_digits(P, 31, 2)} || {_digits(K, 24, 2)} || {_digits(P, 60, 2)} || {_one_of(K, 'Z ', 'Z ', 'Z  ', 'X ')}
  || {_one_of(P, '', f"'  || {_digits(K, 31, 2)} || {_digits(P, 24, 2)} || '/' || {_digits(P, 31, 2)} || {_digits(K, 24, 2)} || ' ")} || {_WIND} || ' '
  || {_one_of(K, '9999 ', 'CAVOK ', '0800 ', '10SM ', '4500 ', '1/2SM ')} || {_one_of(P, '-', '+', 'VC', '', '')} || {_one_of(K, '', 'SH', 'TS', 'FZ', 'MI', 'PR', 'BC', 'DR', 'BL', 'TSSH')} || {_one_of(P, *_PHENOMENA, 'NSW', '', 'RASN')} || ' '
  || {_one_of(P, 'FEW', 'SCT', 'BKN', 'OVC', 'VV')} || {_digits(K, 300, 3)} || {_one_of(K, '', 'CB', 'TCU')} || ' ' || {_one_of(K, '', 'NSC ', 'NCD ', 'CLR ', 'SKC ', 'EDDM ')}
  || {_one_of(P, '', 'M')} || {_digits(K, 40, 2)} || '/' || {_one_of(K, '', 'M')} || {_digits(P, 40, 2)} || ' ' || {_one_of(P, 'Q', 'A')} || {_digits(P, 3200, 4)}
  || {_one_of(K, ' NOSIG', ' TEMPO', ' BECMG', ' PROB30', '=', ' RMK QNH 1013 METAR', ' //////', f" FM' || {_digits(P, 31, 2)} || {_digits(K, 24, 2)} || '00 AUTO ")} END"""


def _sql() -> str:
    def w(key: str) -> str:
        return f"(CASE WHEN lang = 'de' THEN '{weather.DE[key]}' ELSE '{weather.EN[key]}' END)"

    def looked(x: str) -> str:
        return f"(CASE {x} " + " ".join(f"WHEN '{k}' THEN {w(k)}" for k in weather.EN if len(k) < 4 and (not k.isalpha() or k.isupper())) + f" ELSE {x} END)"

    g = lambda pattern, i: f"regexp_extract(token, '{pattern}', {i})"
    n = lambda pattern, i: f"CAST(TRY_CAST({g(pattern, i)} AS INTEGER) AS VARCHAR)"
    wind, clouds, temp = r"^(\d{3}|VRB)(\d{2,3})(?:G(\d{2,3}))?(KT|MPS|MPH)$", r"^(FEW|SCT|BKN|OVC)(\d{3})(CB|TCU)?$", r"^(M?\d\d)/(M?\d\d)$"
    day, valid, fm = r"^(\d\d)(\d\d)(\d\d)Z$", r"^(\d\d)(\d\d)/(\d\d)(\d\d)$", r"^FM(\d\d)(\d\d)(\d\d)$"
    unit = f"(CASE {g(wind, 4)} WHEN 'KT' THEN ' kt' WHEN 'MPS' THEN ' m/s' ELSE ' mph' END)"
    signed = lambda i: f"CAST(CAST(replace({g(temp, i)}, 'M', '-') AS INTEGER) AS VARCHAR)"
    pairs = lambda i: f"list_transform(regexp_extract_all({g(weather.WEATHER, i)}, '..?'), lambda x: {looked('x')})"
    named = " ".join(f"WHEN token = '{k}' THEN {w(v)}" for k, v in weather.NAMED.items())
    return f"""WITH src AS (SELECT {K} AS k, {LANG} AS lang, string_split_regex(trim(regexp_replace(trim({REPORT}), '=$', '')), '\\s+') AS ts FROM orders),
      cut AS (SELECT k, lang, CASE WHEN list_contains(ts, 'RMK') THEN ts[:list_position(ts, 'RMK') - 1] ELSE ts END AS ts FROM src),
      tok AS (SELECT k, lang, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM cut), st AS (SELECT k, min(pos) AS first FROM tok WHERE regexp_matches(token, '^[A-Z]{{4}}$') AND token <> 'AUTO' GROUP BY k)
      SELECT k, lang, CAST(pos AS INTEGER) AS pos, token, CASE {named} WHEN pos = first THEN {w('station')} || ': ' || token
      WHEN regexp_matches(token, '{day}') THEN {w('observed')} || ' ' || {n(day, 1)} || ', ' || {g(day, 2)} || ':' || {g(day, 3)} || ' UTC'
      WHEN regexp_matches(token, '{valid}') THEN {w('valid')} || ' ' || {n(valid, 1)} || '. ' || {g(valid, 2)} || ':00 ' || {w('to')} || ' ' || {n(valid, 3)} || '. ' || {g(valid, 4)} || ':00 UTC'
      WHEN regexp_matches(token, '{fm}') THEN {w('from')} || ' ' || {n(fm, 1)} || '. ' || {g(fm, 2)} || ':' || {g(fm, 3)} || ' UTC:'
      WHEN regexp_matches(token, '^PROB\\d\\d$') THEN {w('probability')} || ' ' || token[5:] || '%'
      WHEN regexp_matches(token, '^00000(KT|MPS|MPH)$') THEN {w('calm')}
      WHEN regexp_matches(token, '{wind}') THEN CASE WHEN starts_with(token, 'VRB') THEN {w('variableWind')} || ' ' ELSE {w('windFrom')} || ' ' || {n(wind, 1)} || '° ' || {w('at')} || ' ' END
        || {n(wind, 2)} || {unit} || CASE WHEN {g(wind, 3)} <> '' THEN ', ' || {w('gusting')} || ' ' || {n(wind, 3)} || {unit} ELSE '' END
      WHEN regexp_matches(token, '^\\d\\d\\dV\\d\\d\\d$') THEN {w('varyingBetween')} || ' ' || CAST(CAST(token[:3] AS INTEGER) AS VARCHAR) || '° ' || {w('and')} || ' ' || CAST(CAST(token[5:] AS INTEGER) AS VARCHAR) || '°'
      WHEN token = '9999' THEN {w('visibility')} || ': ' || {w('tenKmPlus')} WHEN regexp_matches(token, '^\\d{{4}}$') THEN {w('visibility')} || ': ' || CAST(CAST(token AS INTEGER) AS VARCHAR) || ' m'
      WHEN regexp_matches(token, '^\\d\\d?SM$') THEN {w('visibility')} || ': ' || replace(token, 'SM', ' SM')
      WHEN regexp_matches(token, '{clouds}') THEN {looked(g(clouds, 1))} || ' ' || {w('at')} || ' ' || CAST(CAST(token[4:6] AS INTEGER) * 100 AS VARCHAR) || ' ft' || CASE {g(clouds, 3)} WHEN 'CB' THEN ' (' || {w('cb')} || ')' WHEN 'TCU' THEN ' (' || {w('tcu')} || ')' ELSE '' END
      WHEN regexp_matches(token, '^VV\\d\\d\\d$') THEN {w('verticalVis')} || ' ' || CAST(CAST(token[3:] AS INTEGER) * 100 AS VARCHAR) || ' ft'
      WHEN regexp_matches(token, '{temp}') THEN {w('temperature')} || ' ' || {signed(1)} || ' °C, ' || {w('dewpoint')} || ' ' || {signed(2)} || ' °C'
      WHEN regexp_matches(token, '^Q\\d{{3,4}}$') THEN 'QNH ' || CAST(CAST(token[2:] AS INTEGER) AS VARCHAR) || ' hPa'
      WHEN regexp_matches(token, '^A\\d{{4}}$') THEN {w('altimeter')} || ' ' || printf('%d.%02d', CAST(token[2:] AS INTEGER) // 100, CAST(token[2:] AS INTEGER) % 100) || ' inHg'
      WHEN regexp_matches(token, '{weather.WEATHER}') AND token NOT IN ('-', '+', 'VC') THEN array_to_string(list_concat(list_concat(CASE WHEN {g(weather.WEATHER, 1)} = '' THEN [] ELSE [{looked(g(weather.WEATHER, 1))}] END, {pairs(2)}), {pairs(3)}), ' ')
      ELSE '' END AS text FROM tok LEFT JOIN st USING (k)"""


@query(_sql())
def p01_decoded_reports(s: SparkSession, d: str) -> DataFrame:
    """Every group of every report in words, in the language of the row or English."""
    o = table(s, d, "orders").select(F.col(K).alias("k"), F.expr(LANG).alias("lang"), F.expr(REPORT).alias("report"))
    return weather.decoded(o, "report", "lang")
