"""Coded weather reports in words: a report's groups in order, each with the text of the first rule that reads it."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words of decoded reports in English and German. Other languages are a parameter of decoded().
EN = {
    "metar": "Routine observation", "speci": "Special observation", "taf": "Terminal aerodrome forecast", "amended": "(amended)", "corrected": "(corrected)",
    "auto": "Automated station", "station": "Station", "observed": "Observed day", "at": "at", "windFrom": "Wind from", "calm": "Wind calm",
    "variableWind": "Wind variable at", "gusting": "gusting", "varyingBetween": "Wind varying between", "and": "and", "visibility": "Visibility",
    "tenKmPlus": "10 km or more", "cavok": "CAVOK - ceiling and visibility OK (>= 10 km, no significant cloud or weather)", "temperature": "Temperature",
    "dewpoint": "dew point", "qnh": "QNH", "altimeter": "Altimeter", "verticalVis": "Vertical visibility", "cb": "cumulonimbus", "tcu": "towering cumulus",
    "noClouds": "No significant clouds", "valid": "Valid from", "to": "to", "from": "From", "tempo": "Temporarily:", "becoming": "Becoming:",
    "probability": "Probability", "noSignificant": "No significant change expected",
    "FEW": "Few clouds", "SCT": "Scattered clouds", "BKN": "Broken clouds", "OVC": "Overcast",
    "-": "Light", "+": "Heavy", "VC": "In the vicinity:",
    "MI": "shallow", "PR": "partial", "BC": "patches of", "DR": "low drifting", "BL": "blowing", "SH": "showers of", "TS": "thunderstorm", "FZ": "freezing",
    "DZ": "drizzle", "RA": "rain", "SN": "snow", "SG": "snow grains", "IC": "ice crystals", "PL": "ice pellets", "GR": "hail", "GS": "small hail",
    "UP": "unknown precipitation", "BR": "mist", "FG": "fog", "FU": "smoke", "VA": "volcanic ash", "DU": "widespread dust", "SA": "sand", "HZ": "haze",
    "PO": "dust/sand whirls", "SQ": "squalls", "FC": "funnel cloud", "SS": "sandstorm", "DS": "duststorm",
}
DE = {
    "metar": "Routinemeldung", "speci": "Sondermeldung", "taf": "Flugplatzvorhersage", "amended": "(korrigiert)", "corrected": "(berichtigt)",
    "auto": "Automatische Station", "station": "Station", "observed": "Beobachtet am Tag", "at": "um", "windFrom": "Wind aus", "calm": "Windstille",
    "variableWind": "Wind veränderlich mit", "gusting": "in Böen bis", "varyingBetween": "Wind schwankend zwischen", "and": "und", "visibility": "Sicht",
    "tenKmPlus": "10 km oder mehr", "cavok": "CAVOK - Sicht und Wolken in Ordnung (>= 10 km, keine nennenswerten Wolken/Wetter)", "temperature": "Temperatur",
    "dewpoint": "Taupunkt", "qnh": "QNH", "altimeter": "Höhenmesser", "verticalVis": "Vertikalsicht", "cb": "Cumulonimbus", "tcu": "aufquellender Cumulus",
    "noClouds": "Keine nennenswerten Wolken", "valid": "Gültig von", "to": "bis", "from": "Ab", "tempo": "Zeitweise:", "becoming": "Übergehend:",
    "probability": "Wahrscheinlichkeit", "noSignificant": "Keine wesentliche Änderung erwartet",
    "FEW": "Vereinzelte Wolken", "SCT": "Aufgelockerte Wolken", "BKN": "Durchbrochene Wolken", "OVC": "Bedeckt",
    "-": "Leichter", "+": "Starker", "VC": "In der Nähe:",
    "MI": "flach", "PR": "teilweise", "BC": "Schwaden", "DR": "fegend", "BL": "treibend", "SH": "Schauer", "TS": "Gewitter", "FZ": "gefrierend",
    "DZ": "Niesel", "RA": "Regen", "SN": "Schnee", "SG": "Schneegriesel", "IC": "Eisnadeln", "PL": "Eiskörner", "GR": "Hagel", "GS": "kleiner Hagel",
    "UP": "unbekannter Niederschlag", "BR": "feuchter Dunst", "FG": "Nebel", "FU": "Rauch", "VA": "Vulkanasche", "DU": "Staub", "SA": "Sand", "HZ": "trockener Dunst",
    "PO": "Staub-/Sandwirbel", "SQ": "Böen", "FC": "Trichterwolke", "SS": "Sandsturm", "DS": "Staubsturm",
}

#: Tokens that stand for a word, whatever is around them.
NAMED = {
    "METAR": "metar", "SPECI": "speci", "TAF": "taf", "AMD": "amended", "COR": "corrected", "AUTO": "auto", "TEMPO": "tempo", "BECMG": "becoming",
    "NOSIG": "noSignificant", "CAVOK": "cavok", "NSC": "noClouds", "NCD": "noClouds", "SKC": "noClouds", "CLR": "noClouds",
}
WEATHER = "^(-|[+]|VC)?((?:MI|PR|BC|DR|BL|SH|TS|FZ)*)((?:DZ|RA|SN|SG|IC|PL|GR|GS|UP|BR|FG|FU|VA|DU|SA|HZ|PO|SQ|FC|SS|DS|NSW)*)$"
WIND = "^([0-9]{3}|VRB)([0-9]{2,3})(?:G([0-9]{2,3}))?(KT|MPS|MPH)$"

Word = Callable[[str], Column]
Part = str | Column


def _glossary(lang: Column, more: Mapping[str, Mapping[str, str]] | None) -> tuple[Word, Callable[[Column], Column]]:
    """Word of a fixed key, and of a key in a column (which stays as it is if unknown); English where a language lacks it."""
    known = {"en": EN, "de": DE, **(more or {})}
    code = F.coalesce(lang, F.lit("en"))

    def word(key: str) -> Column:
        chain = F
        for name, words in known.items():
            if key in words and name != "en":
                chain = chain.when(code == name, F.lit(words[key]))
        return chain.otherwise(F.lit(known["en"][key])) if chain is not F else F.lit(known["en"][key])

    table = F.create_map(*[F.lit(x) for name, words in known.items() for k, v in words.items() for x in (f"{name} {k}", v)])
    looked_up = lambda k: F.coalesce(F.try_element_at(table, F.concat_ws(" ", code, k)), F.try_element_at(table, F.concat(F.lit("en "), k)), k)
    return word, looked_up


def _text(token: Column, is_station: Column, lang: Column, more: Mapping[str, Mapping[str, str]] | None) -> Column:
    w, looked_up = _glossary(lang, more)
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def group(pattern: str) -> tuple[Callable[[int], Column], Callable[[int], Column]]:
        raw = lambda i: F.regexp_extract(token, pattern, i)
        return raw, lambda i: raw(i).try_cast("int").cast("string")

    chain = F.when(is_station, said(w("station"), ": ", token))
    for name, key in NAMED.items():
        chain = chain.when(token == name, w(key))

    def rule(pattern: str, told: Callable[[Callable[[int], Column], Callable[[int], Column]], Column]) -> None:
        nonlocal chain
        chain = chain.when(token.rlike(pattern), told(*group(pattern)))

    two, four = "([0-9]{2})", "([0-9]{4})"
    signed = lambda t: F.when(t.startswith("M"), -F.substring(t, 2, 2).try_cast("int")).otherwise(t.try_cast("int")).cast("string")
    unit = lambda u: F.when(u == "KT", "kt").when(u == "MPS", "m/s").otherwise("mph")

    def wind(raw, n):
        calm = (raw(1) == "000") & (raw(2) == "00") & (raw(3) == "")
        speed = said(n(2), " ", unit(raw(4)))
        steady = F.when(raw(1) == "VRB", said(w("variableWind"), " ", speed)).otherwise(said(w("windFrom"), " ", F.coalesce(n(1), F.lit("")), "° ", w("at"), " ", speed))
        gusts = F.when(raw(3) != "", said(", ", w("gusting"), " ", n(3), " ", unit(raw(4)))).otherwise("")
        return F.when(calm, w("calm")).otherwise(said(steady, gusts))

    def clouds(raw, n):
        kind = F.when(raw(3) == "CB", said(" (", w("cb"), ")")).when(raw(3) == "TCU", said(" (", w("tcu"), ")")).otherwise("")
        return said(looked_up(raw(1)), " ", w("at"), " ", (n(2).cast("int") * 100).cast("string"), " ft", kind)

    def weather(raw, n):
        pairs = lambda i: F.transform(F.regexp_extract_all(raw(i), F.lit("..?"), F.lit(0)), looked_up)
        return F.array_join(F.concat(F.when(raw(1) == "", F.array().cast("array<string>")).otherwise(F.array(looked_up(raw(1)))), pairs(2), pairs(3)), " ")

    rule(f"^{two}{two}{two}Z$", lambda raw, n: said(w("observed"), " ", n(1), ", ", raw(2), ":", raw(3), " UTC"))
    rule(f"^{two}{two}/{two}{two}$", lambda raw, n: said(w("valid"), " ", n(1), ". ", raw(2), ":00 ", w("to"), " ", n(3), ". ", raw(4), ":00 UTC"))
    rule(f"^FM{two}{two}{two}$", lambda raw, n: said(w("from"), " ", n(1), ". ", raw(2), ":", raw(3), " UTC:"))
    rule(f"^PROB{two}$", lambda raw, n: said(w("probability"), " ", raw(1), "%"))
    rule(WIND, wind)
    rule("^([0-9]{3})V([0-9]{3})$", lambda raw, n: said(w("varyingBetween"), " ", n(1), "° ", w("and"), " ", n(2), "°"))
    rule(f"^{four}$", lambda raw, n: said(w("visibility"), ": ", F.when(raw(1) == "9999", w("tenKmPlus")).otherwise(said(n(1), " m"))))
    rule("^([0-9]{1,2})SM$", lambda raw, n: said(w("visibility"), ": ", raw(1), " SM"))
    rule("^(FEW|SCT|BKN|OVC)([0-9]{3})(CB|TCU)?$", clouds)
    rule("^VV([0-9]{3})$", lambda raw, n: said(w("verticalVis"), " ", (n(1).cast("int") * 100).cast("string"), " ft"))
    rule("^(M?[0-9]{2})/(M?[0-9]{2})$", lambda raw, n: said(w("temperature"), " ", signed(raw(1)), " °C, ", w("dewpoint"), " ", signed(raw(2)), " °C"))
    rule("^Q([0-9]{3,4})$", lambda raw, n: said(w("qnh"), " ", n(1), " hPa"))
    rule(f"^A{two}{two}$", lambda raw, n: said(w("altimeter"), " ", n(1), ".", raw(2), " inHg"))
    chain = chain.when(token.rlike(WEATHER) & ~token.isin("-", "+", "VC"), weather(*group(WEATHER)))
    return chain.otherwise("")


def decoded(df: DataFrame, report: str, lang: str, more: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """df's rows without the report, one for each of its groups up to the remarks: pos (from 0), token, text.

    The first group of four letters is the station; a group that no rule reads has an empty text. more: language -> key of EN -> word;
    languages that lack a word have the English one, null is English. Weather is read in pairs of letters, so NSW stays `NS W`.
    Null reports and those without groups give no rows. Each row is its own work: nothing is shuffled.
    """
    tokens = F.filter(F.split(F.regexp_replace(F.regexp_replace(report, r"(?U)^\s+|\s+$", ""), "=$", ""), r"(?U)\s+"), lambda t: t != "")
    rest = [c for c in df.columns if c != report]
    end = F.array_position("_tokens", F.lit("RMK"))
    cut = df.withColumn("_tokens", tokens).withColumn("_tokens", F.when(end > 0, F.slice("_tokens", F.lit(1), (end - 1).cast("int"))).otherwise(F.col("_tokens")))
    station = F.get(F.filter("_tokens", lambda t: t.rlike("^[A-Z]{4}$") & (t != "AUTO")), F.lit(0))
    rows = cut.withColumn("_station", F.array_position("_tokens", station) - 1).select(*rest, "_station", F.posexplode("_tokens").alias("pos", "token"))
    return rows.select(*rest, "pos", "token", _text(F.col("token"), F.coalesce(F.col("pos") == F.col("_station"), F.lit(False)), F.col(lang), more).alias("text"))
