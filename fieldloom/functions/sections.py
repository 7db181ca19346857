"""Numbered sections of aerodrome texts: where each begins and ends, its title, and whether other data shows it already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.common import let

#: Titles of sections 2.1 to 2.24, of text without a known number, and the sections that are shown elsewhere.
TITLES = {
    "en": (
        "Aerodrome location indicator and name", "Aerodrome geographical and administrative data", "Operational hours", "Handling services and facilities",
        "Passenger facilities", "Rescue and fire fighting services", "Seasonal availability - clearing", "Aprons, taxiways and check locations data",
        "Surface movement guidance and control system and markings", "Aerodrome obstacles", "Meteorological information provided", "Runway physical characteristics",
        "Declared distances", "Approach and runway lighting", "Other lighting, secondary power supply", "Helicopter landing area", "ATS airspace",
        "ATS communication facilities", "Radio navigation and landing aids", "Local aerodrome regulations", "Noise abatement procedures", "Flight procedures",
        "Additional information", "Charts related to an aerodrome",
    ),
    "de": (
        "Flugplatzkennung und Name", "Geographische und verwaltungstechnische Flugplatzdaten", "Betriebszeiten", "Abfertigungsdienste und Einrichtungen",
        "Einrichtungen für Fluggäste", "Rettungs- und Feuerlöschdienste", "Verfügbarkeit nach Jahreszeit, Räumung", "Vorfeld, Rollbahnen und Kontrollpunkte",
        "Führung und Kontrolle der Bodenbewegungen, Markierungen", "Flugplatzhindernisse", "Bereitgestellte Wetterinformationen", "Pistenphysische Eigenschaften",
        "Erklärte Distanzen", "Anflug- und Pistenbefeuerung", "Sonstige Befeuerung, Ersatzstromversorgung", "Hubschrauberlandebereich", "ATS-Luftraum",
        "ATS-Kommunikationseinrichtungen", "Funknavigations- und Landehilfen", "Örtliche Flugbeschränkungen", "Lärmschutzverfahren", "Flugverfahren",
        "Zusätzliche Informationen", "Karten für den Flugplatz",
    ),
}
OTHER = {"en": "Further AIP information", "de": "Weitere AIP-Angaben"}
REDUNDANT = ("2.1", "2.2", "2.3", "2.11", "2.12", "2.13", "2.18")
#: A section's mark (scans lose its dot or space it), words of prose, a numbered item with a capitalised word, a labelled number.
MARK = r"(?i)(?<![A-Za-z0-9_])AD\s*2\.?\s*([0-9]{1,2})(?![A-Za-z0-9_])"
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
PROSE = f"{EDGE}[a-zäöü]{{3,}}{EDGE}"
ITEM = r"(?=(?<![\d.])\d{1,2}\.(?:\d{1,2})?\s+[A-ZÄÖÜ][a-zäöü])"
PHONE = r"(?i)(?<![A-Za-z0-9_])TEL(?:EFON)?\s*[:.]?\s*(\+?\(?\d[\d\s()/.-]{5,}\d)"


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def _untitled(body: Column, title: Column) -> Column:
    """body without the title that it repeats at its start, however that is spaced and cased, and the signs after it."""
    again = F.concat(F.lit("(?iu)^"), F.replace(title, F.lit(" "), F.lit("\\s+")), F.lit(r"[\s.,:;-]*"))
    return _trimmed(F.regexp_replace(body, again, F.lit("")))


def sections(df: DataFrame, text: str, lang: str = "en") -> DataFrame:
    """df's rows without the text, one for each section in order: nth (from 0), code, title, body, redundant.

    Text before the first mark is a section without code if it has two words of prose. A number without a title has the title of other text.
    Only a section with another one behind it can be redundant: where the last one ends isn't known. Null texts and those without marks give no rows.
    Marks are found once in a text: bodies are what lies between them.
    """
    rest = [c for c in df.columns if c != text]

    def parts(codes: Column) -> Column:
        part = lambda b, i: F.struct(F.get(codes, i - 1).alias("code"), _trimmed(b).alias("body"), i.alias("i"), (F.size(codes) > i).alias("more"))
        return F.when(F.size(codes) > 0, F.transform(F.split(text, MARK), part))

    marked = df.select(*rest, F.explode(let(F.regexp_extract_all(text, F.lit(MARK), F.lit(1)), parts)).alias("p"))
    rows = marked.filter((F.col("p.i") > 0) | (F.regexp_count("p.body", F.lit(PROSE)) >= 2))
    number = F.when(~F.col("p.code").startswith("0"), F.col("p.code").cast("int"))
    title = F.coalesce(F.get(F.array(*[F.lit(t) for t in TITLES[lang]]), number - 1), F.lit(OTHER[lang]))
    code = F.when(F.col("p.i") > 0, F.concat(F.lit("2."), F.col("p.code")))
    out = rows.select(*rest, F.col("p.i").alias("nth"), code.alias("code"), title.alias("title"), F.col("p.body").alias("body"), F.col("p.more").alias("_more"))
    body = F.when(F.col("nth") > 0, _untitled(F.col("body"), F.col("title"))).otherwise(F.col("body"))
    return out.select(*rest, "nth", "code", "title", body.alias("body"), F.coalesce(F.col("code").isin(*REDUNDANT) & F.col("_more"), F.lit(False)).alias("redundant"))


def items(body: Column) -> Column:
    """A body's numbered items (a number with a dot, then a capitalised word), in order; bodies without any stay whole, null and blank ones have none."""
    return F.coalesce(F.filter(F.transform(F.split(body, ITEM), _trimmed), lambda x: x != ""), F.array().cast("array<string>"))


def phone(text: Column) -> Column:
    """The number behind a telephone's label in the first section 2.2, if it has 7 to 15 digits; numbers of other sections don't count."""

    def admin(codes: Column) -> Column:
        body = F.get(F.split(text, MARK), F.array_position(codes, F.lit("2")).cast("int"))
        return F.when(F.array_contains(codes, "2"), _untitled(_trimmed(body), F.lit(TITLES["en"][1])))

    def read(found: Column) -> Column:
        return F.when(F.regexp_count(found, F.lit("[0-9]")).between(7, 15), found)

    return let(_trimmed(F.regexp_replace(F.regexp_extract(let(F.regexp_extract_all(text, F.lit(MARK), F.lit(1)), admin), PHONE, 1), r"\s+", " ")), read)
