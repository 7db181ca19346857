"""Dates, cycles and clock minutes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.common import let

#: Fixed value: the first day of a publication cycle, and its length.
CYCLE_ANCHOR, CYCLE_DAYS = "2026-07-09", 28


def _days(d: Column) -> Column:
    return F.datediff(d, F.lit(CYCLE_ANCHOR).cast("date"))


def current_cycle(d: Column) -> Column:
    """Day on which the cycle that holds d began (also before the anchor)."""
    return F.date_add(F.lit(CYCLE_ANCHOR).cast("date"), (F.floor(_days(d) / CYCLE_DAYS) * CYCLE_DAYS).cast("int"))


def next_cycle(d: Column) -> Column:
    """First cycle day after d."""
    return F.date_add(current_cycle(d), CYCLE_DAYS)


def in_change_window(d: Column) -> Column:
    """The cycle day and the two after it."""
    return F.pmod(_days(d), F.lit(CYCLE_DAYS)) <= 2


def crawl_day(d: Column) -> Column:
    """struct(due, reason): the change window first, then Sundays."""
    window, sunday = in_change_window(d), F.weekday(d) == 6
    reason = F.when(window, F.lit("window")).when(sunday, F.lit("weekly")).otherwise(F.lit("skip"))
    return F.struct((window | sunday).alias("due"), reason.alias("reason"))


def recent_cycles(d: Column, n: int) -> Column:
    """The n latest cycle days up to d, newest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_add(current_cycle(d), (i * -CYCLE_DAYS).cast("int")))


def utc_weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def utc_minute(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def dst_active(zone: Column, ts: Column) -> Column:
    """Whether the zone's offset at ts is above its offset on 1 January of that year (so never in southern zones)."""

    def offset(t: Column) -> Column:
        return F.unix_timestamp(F.from_utc_timestamp(t, zone)) - F.unix_timestamp(t)

    return offset(ts) > offset(F.make_timestamp(F.year(ts), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def clock_minutes(text: Column, colon: bool = True) -> Column:
    """Minutes of the HH:MM that text begins with (hours up to 24), null without one; without colon HHMM is read as well."""
    p = r"^(\d{2})" + (":" if colon else ":?") + r"(\d{2})"
    part = lambda t, i: F.nullif(F.regexp_extract(t, p, i), F.lit("")).cast("int")
    whole = lambda h, m: F.when((h <= 24) & (m <= 59), h * 60 + m)
    return let(F.trim(text), lambda t: let(part(t, 1), lambda h: let(part(t, 2), lambda m: whole(h, m))))


def clock_of(minutes: Column) -> Column:
    """HH:MM of rounded minutes, which come round after 24:00."""
    m = F.pmod(F.floor(minutes + 0.5).cast("int"), F.lit(1441))
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), F.pmod(m, F.lit(60)))


def clock_text(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), F.pmod(minutes, F.lit(60)).cast("int"))


def age_text(seconds: Column) -> Column:
    """Coarse age, never below 0; - if it isn't known."""
    s = F.greatest(F.lit(0), seconds)
    whole = lambda n, unit: F.concat(F.lit("vor "), F.floor(s / n), F.lit(f" {unit}"))
    return F.when(seconds.isNull(), "-").when(s < 60, "gerade eben").when(s < 3600, whole(60, "min")).when(s < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))


def axis_clock(ts: Column, with_date: Column) -> Column:
    """HH:MM in UTC, or MM-DD HH:MM where a span crosses days."""
    return F.when(with_date, F.date_format(ts, "MM-dd HH:mm")).otherwise(F.date_format(ts, "HH:mm"))


def first_date(text: Column) -> Column:
    """First valid date in text, YYYY-MM-DD before DD/MM/YYYY; impossible dates are passed over."""
    iso = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{4}-\d{2}-\d{2})"), 1), lambda x: F.try_to_date(x, "yyyy-MM-dd"))
    other = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{2}/\d{2}/\d{4})"), 1), lambda x: F.try_to_date(x, "dd/MM/yyyy"))
    valid = F.filter(F.concat(iso, other), lambda x: x.isNotNull())
    return F.get(valid, F.lit(0))


def edition_day(day: Column, month: Column, year: Column) -> Column:
    """A date of its parts; two-digit years are of this century; null if there is no such day."""
    y = F.when(year < 100, year + 2000).otherwise(year)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd")
