"""Opening hours out of texts and documents: seven days of hours.HOURS, as column expressions.

Nothing is guessed: what can't be read is unknown, days that aren't named are unknown, and a text that says nothing is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.common import let
from fieldloom.functions.dates import clock_minutes, clock_of, dst_active, utc_weekday
from fieldloom.functions.hours import BOUND, open_status, open_until
from fieldloom.functions.text import json_number, json_text

#: Names of days, in texts and in community notation.
NAMES, SHORT = "MON|TUE|WED|THU|FRI|SAT|SUN", "mo|tu|we|th|fr|sa|su"
DAYS = rf"\b({NAMES})(?:\s*[-–—]\s*({NAMES}))?\b"
WINDOW = r"\b(\d{3,4}|SR|SS)\s*[-–—]\s*(\d{3,4}|SR|SS)\b"
#: What can't be asserted, and labels of the rows of services that follow the operator's own.
ON_REQUEST = r"\b(O/?R|PPR|ON REQUEST|AS REQUIRED|HX|HO)\b"
SERVICES = ("customs", "health and san", "ais briefing", "ats reporting office", "met briefing")
SECTION = r"(?is)AD\s*2\.3\b(.*?)(?:\bAD\s*2\.(?:4|\d\d)\b)"


def day(kind: str, open_: Column | None = None, close: Column | None = None) -> Column:
    bound = lambda b: (F.lit(None) if b is None else b).cast(BOUND)
    return F.struct(F.lit(kind).alias("kind"), bound(open_).alias("open"), bound(close).alias("close"))


def _window(open_: Column, close: Column) -> Column:
    """A window whose bounds are both known, else unknown."""
    return let(open_, lambda a: let(close, lambda b: F.when(a.isNotNull() & b.isNotNull(), day("window", a, b)).otherwise(day("unknown"))))


def _bound(solar: Column, minutes: Column) -> Column:
    """A solar bound (sr, ss) if there is one, else a time, else null."""
    return let(solar, lambda sun: let(minutes, lambda m: _bound_of(sun, m)))


def _bound_of(solar: Column, minutes: Column) -> Column:
    own = F.struct(F.coalesce(solar, F.lit("time")).alias("t"), F.when(solar.isNull(), minutes).cast("int").alias("m"))
    return F.when(solar.isNotNull() | minutes.isNotNull(), own)


def _week(stated: Column, last: bool = False) -> Column:
    """Seven days from statements (days, day): the first one that names a day counts, or the last one; null without any."""

    def week(said: Column) -> Column:
        def of(i: Column) -> Column:
            own = F.filter(said, lambda s: F.array_contains(s["days"], i))
            return F.coalesce((F.try_element_at(own, F.lit(-1)) if last else F.get(own, F.lit(0)))["day"], day("unknown"))

        return F.when(F.size(said) > 0, F.transform(F.sequence(F.lit(0), F.lit(6)), of))

    return let(stated, week)


def _span(a: Column, b: Column) -> Column:
    """Days a to b, over the end of the week if need be."""
    return F.when(b >= a, F.sequence(a, F.greatest(a, b))).otherwise(F.concat(F.sequence(a, F.lit(6)), F.sequence(F.lit(0), b)))


# ---- section 2.3 of a page: free text


def _day_index(name: Column) -> Column:
    return ((F.instr(F.lit(NAMES.replace("|", "")), name) - 1) / 3).cast("int")


def _statement(segment: Column) -> Column:
    """struct(days, day) of a segment; day is null if it says nothing."""

    def named(a: Column, b: Column) -> Column:
        spans = let(_day_index(a), lambda first: let(F.when(b == "", first).otherwise(_day_index(b)), lambda last: _span(first, last)))
        return F.when(segment.rlike("DAILY|DLY") | (a == ""), F.sequence(F.lit(0), F.lit(6))).otherwise(spans)

    days = let(F.regexp_extract(segment, DAYS, 1), lambda a: let(F.regexp_extract(segment, DAYS, 2), lambda b: named(a, b)))

    def side(i: int) -> Column:
        return let(F.regexp_extract(segment, WINDOW, i), lambda token: _bound(F.when(token.isin("SR", "SS"), F.lower(token)), clock_minutes(token, colon=False)))

    own = F.when(segment.rlike(r"\bH24\b"), day("h24")).when(segment.rlike(WINDOW), let(side(1), lambda a: let(side(2), lambda b: _window(a, b))))
    return F.struct(days.alias("days"), own.when(segment.rlike(r"\bCLSD\b|\bCLOSED\b"), day("closed")).when(segment.rlike(ON_REQUEST), day("unknown")).alias("day"))


def text_week(text: Column) -> Column:
    """Hours of free text: segments between semicolons, each for its days, DAILY or all; the first statement for a day wins.

    A notice without a window and H24 without days speak for the whole week.
    """
    whole = lambda kind: F.array_repeat(day(kind), 7)

    def week(up: Column) -> Column:
        stated = F.filter(F.transform(F.split(up, ";"), lambda s: let(F.trim(s), _statement)), lambda s: s["day"].isNotNull())
        notice = up.contains("NOTAM") & ~up.rlike(WINDOW)
        return F.when(notice, whole("notam")).when(up.rlike(r"\bH24\b") & ~up.rlike(DAYS), whole("h24")).otherwise(_week(stated))

    return let(F.trim(F.regexp_replace(F.upper(text), r"\s+", " ")), week)


def operator_row(section: Column) -> Column:
    """The first row of the table in a section: up to the second row's number or the first service's label; null if neither is found."""
    low = F.lower(section)
    at = [F.nullif(F.instr(low, F.lit(label)), F.lit(0)) for label in SERVICES]
    number = F.regexp_instr(section, F.lit(r"\s2\s"))
    cut = F.least(*[F.when(p > 1, p) for p in (number, F.least(*at))])
    return F.substring(section, F.lit(1), cut - 1)


def page_week(page: Column) -> Column:
    """Hours of the operator's row in the first section 2.3 of a page that has any."""
    weeks = F.transform(F.regexp_extract_all(page, F.lit(SECTION), F.lit(1)), lambda s: text_week(operator_row(s)))
    return F.get(F.filter(weeks, lambda w: w.isNotNull()), F.lit(0))


# ---- documents of a community, and its short notation


def _is_true(doc: Column, path: str) -> Column:
    return let(F.try_variant_get(doc, path, "variant"), lambda v: F.coalesce((F.schema_of_variant(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean"), F.lit(False)))


def document_week(json: Column, colon: bool = True) -> Column:
    """Hours of {operatingHours: [{dayOfWeek, startTime, endTime, sunrise, sunset, byNotam}]}: the first entry of a day counts.

    Entries that aren't objects or have no whole day from 0 to 6 are passed over, wrong types count as absent. Times need their
    colon, or may go without.
    """
    entries = F.try_variant_get(F.try_parse_json(json), "$.operatingHours", "array<variant>")

    def statement(e: Column) -> Column:
        side = lambda sun, flag, time: _bound(F.when(_is_true(e, flag), sun), let(json_text(e, time), lambda t: clock_minutes(t, colon)))
        own = _window(side("sr", "$.sunrise", "$.startTime"), side("ss", "$.sunset", "$.endTime"))
        days = let(json_number(e, "$.dayOfWeek"), lambda n: F.when((n == F.floor(n)) & n.between(0, 6), F.array(n.cast("int"))))
        return let(days, lambda d: F.struct(d.alias("days"), F.when(d.isNotNull(), F.when(_is_true(e, "$.byNotam"), day("notam")).otherwise(own)).alias("day")))

    return _week(F.filter(F.transform(entries, statement), lambda s: s["days"].isNotNull()))


def _selected(selector: Column) -> Column:
    """Days of Mo-Fr,Su; null if a part isn't a day or a range of days."""
    index = lambda name: (F.instr(F.lit(SHORT.replace("|", "")), name) - 1) / 2
    span = lambda p: let(index(F.substring(p, 1, 2)).cast("int"), lambda a: let(index(F.substring(p, -2, 2)).cast("int"), lambda b: _span(a, b)))
    known = lambda ps: F.when(F.forall(ps, lambda p: p.rlike(f"^({SHORT})(-({SHORT}))?$")) & (F.size(ps) > 0), ps)
    parts = F.filter(F.transform(F.split(F.lower(selector), ","), lambda x: F.trim(x)), lambda p: p != "")
    return F.flatten(F.transform(let(parts, known), span))


def notation_week(text: Column, lon: Column) -> Column:
    """Hours in the notation `Mo-Fr 08:00-18:00; Sa off`, local times shifted to UTC by longitude (15 degrees an hour).

    A later rule overrides an earlier one for its days. A rule that can't be read, names days that aren't known, lies beyond the
    UTC day or has times without a longitude is passed over, so its days keep what an earlier one said.
    """
    clean = F.trim(F.regexp_replace(F.trim(text), '"[^"]*"', " "))
    shift = F.floor(lon / 15 + 0.5) * 60
    lead = r"^([A-Za-z]{2}(?:\s*[-,]\s*[A-Za-z]{2})*)\s+(.+)$"

    def side(token: Column) -> Column:
        return let(token, bound)

    def bound(token: Column) -> Column:
        return let(F.lower(token), lambda low: let(minutes(token), lambda m: _bound(F.when(low.isin("sunrise", "dawn"), "sr").when(low.isin("sunset", "dusk"), "ss"), F.when(m.between(0, 1440), m))))

    def minutes(token: Column) -> Column:
        return F.when(token.rlike(r"^\d{1,2}:\d{2}$"), clock_minutes(F.lpad(token, 5, "0"))) - shift

    def statement(rule: Column) -> Column:
        named = rule.rlike(lead)
        times = F.when(named, F.trim(F.regexp_extract(rule, lead, 2))).when(rule.rlike(r"(?i)^(24/7|off|closed|sunrise|sunset|dawn|dusk|\d)"), rule)
        days = F.when(named, _selected(F.regexp_extract(rule, lead, 1))).otherwise(F.sequence(F.lit(0), F.lit(6)))
        return F.struct(days.alias("days"), let(times, said).alias("day"))

    def said(times: Column) -> Column:
        open_, close = (side(F.regexp_extract(times, r"^(\S+)\s*-\s*(\S+)$", i)) for i in (1, 2))
        window = let(open_, lambda a: let(close, lambda b: F.when(a.isNotNull() & b.isNotNull(), day("window", a, b))))
        return F.when(times.rlike("(?i)^(off|closed)$"), day("closed")).when(times.rlike("^24/7$"), day("h24")).otherwise(window)

    def week(text: Column) -> Column:
        rules = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda r: r != "")
        stated = F.filter(F.transform(rules, statement), lambda s: s["days"].isNotNull() & s["day"].isNotNull())
        return F.when(text.rlike(r"^24\s*/\s*7$"), F.array_repeat(day("h24"), 7)).otherwise(_week(stated, last=True))

    return let(clean, week)


# ---- what is done with a week


def specification(week: Column) -> Column:
    """array<struct<days array<int>, opens, closes>>: days that share a fixed window, in order of their first day; others are left out; null without seven days."""
    fixed = lambda d: (d["kind"] == "h24") | ((d["kind"] == "window") & (d["open"]["t"] == "time") & (d["close"]["t"] == "time"))
    text = lambda d, name, whole: F.when(d["kind"] == "h24", whole).otherwise(clock_of(d[name]["m"]))
    seven = let(week, lambda w: F.when(F.size(w) == 7, w))
    windows = F.transform(seven, lambda d: F.when(fixed(d), F.struct(text(d, "open", "00:00").alias("opens"), text(d, "close", "23:59").alias("closes"))))

    def groups(ws: Column) -> Column:
        alike = lambda w: F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: F.get(ws, i) == w)
        each = F.array_distinct(F.filter(ws, lambda w: w.isNotNull()))
        return F.transform(each, lambda w: F.struct(alike(w).alias("days"), w["opens"].alias("opens"), w["closes"].alias("closes")))

    return let(windows, groups)


def matches(week: Column, lat: Column, lon: Column, now: Column, weekday: Column, open_now: Column, until: Column) -> Column:
    """Whether a place passes the filters open now and open until (null: off), both on the next such weekday at this time of day.

    Places whose hours aren't known pass only if both are off.
    """
    day = F.timestamp_seconds(F.unix_timestamp(now) + F.pmod(weekday - utc_weekday(now), F.lit(7)) * 86400)
    return let(F.struct(day.alias("then"), week.alias("week")), lambda x: _passes(x["week"], lat, lon, x["then"], open_now, until))


def _passes(week: Column, lat: Column, lon: Column, then: Column, open_now: Column, until: Column) -> Column:
    return (~open_now | (open_status(week, lat, lon, then)["state"] == "open")) & (until.isNull() | open_until(week, lat, lon, until, then))


def seasonal(winter: Column, summer: Column, zone: Column, when: Column) -> Column:
    """The summer week where one is kept and daylight saving is on, else the winter week."""
    return F.when(summer.isNotNull() & dst_active(zone, when), summer).otherwise(winter)
