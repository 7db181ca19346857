"""Opening hours: seven days of struct(kind, open, close), bounds struct(t, m); Monday first, minutes of the UTC day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.common import let
from fieldloom.functions.dates import clock_text, utc_minute, utc_weekday
from fieldloom.functions.measures import round_up_half

BOUND = "struct<t:string,m:int>"
HOURS = f"array<struct<kind:string,open:{BOUND},close:{BOUND}>>"
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
OFFICIAL, CIVIL = -0.833, -6.0


def bound(minute: Column, name: str = "open") -> Column:
    """A bound at a fixed minute of the day."""
    return F.struct(F.lit("time").alias("t"), minute.alias("m")).alias(name)


def _sun(ts: Column, lat: Column, lon: Column, altitude: float) -> tuple[Column, Column]:
    """Julian dates of the sun's passage through altitude, null where it doesn't happen."""
    julian = F.unix_timestamp(ts) / 86400.0 + 2440587.5
    star = round_up_half(julian - 2451545.0 + 0.0008) - lon / 360
    anomaly = (star * 0.98560028 + 357.5291) % 360
    m = F.radians(anomaly)
    centre = F.sin(m) * 1.9148 + F.sin(m * 2) * 0.02 + F.sin(m * 3) * 0.0003
    ecliptic = F.radians((anomaly + centre + 180 + 102.9372) % 360)
    transit = star + 2451545.0 + F.sin(m) * 0.0053 - F.sin(ecliptic * 2) * 0.0069
    sin_decl = F.sin(ecliptic) * F.sin(F.radians(F.lit(23.44)))
    cos_hour = (F.sin(F.radians(F.lit(altitude))) - F.sin(F.radians(lat)) * sin_decl) / (F.cos(F.radians(lat)) * F.cos(F.asin(sin_decl)))
    hour = F.degrees(F.acos(F.when(F.abs(cos_hour) <= 1, cos_hour))) / 360
    return transit - hour, transit + hour


def sun_minutes(ts: Column, lat: Column, lon: Column, altitude: float = OFFICIAL) -> Column:
    """struct(rise, set): minutes of the UTC day, null in polar day or night."""
    rise, down = (F.pmod(F.floor((j - 2440587.5) * 1440), F.lit(1440)).cast("int") for j in _sun(ts, lat, lon, altitude))
    return F.struct(rise.alias("rise"), down.alias("set"))


def _window(day: Column, ts: Column, lat: Column, lon: Column) -> Column:
    """struct(a, z): minutes from which and to which a day is open, null where they aren't known or don't fit."""

    def of(sun: Column) -> Column:
        minute = lambda b: F.when(b["t"] == "time", b["m"]).when(b["t"] == "sr", sun["rise"]).when(b["t"] == "ss", sun["set"])
        open_ = F.when(day["kind"] == "h24", 0).when(day["kind"] == "window", minute(day["open"]))
        close = F.when(day["kind"] == "h24", 1440).when(day["kind"] == "window", minute(day["close"]))
        return let(F.struct(open_.alias("a"), close.alias("z")), lambda w: F.when(w["z"] > w["a"], w))

    return let(sun_minutes(ts, lat, lon), of)


def open_status(hours: Column, lat: Column, lon: Column, ts: Column) -> Column:
    """struct(state, closes_at, opens_at); a day is open from its opening up to, not at, its close."""
    now = utc_minute(ts)

    def of(day: Column, w: Column) -> Column:
        kind = day["kind"]
        state = F.when(kind == "closed", "closed").when(w.isNull(), "unknown").when((now >= w["a"]) & (now < w["z"]), "open").otherwise("closed")
        closes = lambda s: F.when((s == "open") & (kind == "window"), w["z"])
        opens = lambda s: F.when((s == "closed") & (now < w["a"]), w["a"])
        return let(state, lambda s: F.struct(s.alias("state"), closes(s).alias("closes_at"), opens(s).alias("opens_at")))

    return let(_today(hours, ts), lambda day: let(_window(day, ts, lat, lon), lambda w: of(day, w)))


def open_until(hours: Column, lat: Column, lon: Column, target: Column, ts: Column) -> Column:
    """Whether the day's window holds target, its close included; never for days that aren't known."""
    holds = lambda w: F.coalesce((target >= w["a"]) & (target <= w["z"]), F.lit(False))
    return let(let(_today(hours, ts), lambda day: _window(day, ts, lat, lon)), holds)


def _today(hours: Column, ts: Column) -> Column:
    return F.when(F.size(hours) == 7, F.get(hours, utc_weekday(ts)))


def _day_text(d: Column) -> Column:
    side = lambda b: F.when(b["t"] == "time", clock_text(b["m"])).otherwise(F.upper(b["t"]))
    return F.when(d["kind"] == "h24", "H24").when(d["kind"] == "window", F.concat(side(d["open"]), F.lit("-"), side(d["close"]))).when(d["kind"] == "notam", "by NOTAM")


def hours_text(hours: Column) -> Column:
    """Runs of equal neighbouring days: Mon-Fri 08:00-20:00; Sat SR-SS. Closed and unknown days are left out; null if none is left."""
    names = F.array(*[F.lit(d) for d in DAYS])

    def shown(texts: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: (i == 0) | ~F.get(texts, i).eqNullSafe(F.get(texts, (i - 1).cast("int"))))
        return let(begins, lambda own: F.transform(F.filter(own, lambda i: F.get(texts, i).isNotNull()), lambda i: run(texts, own, i)))

    def run(texts: Column, begins: Column, i: Column) -> Column:
        def named(end: Column) -> Column:
            days = F.when(end == i, F.get(names, i)).otherwise(F.concat(F.get(names, i), F.lit("-"), F.get(names, end)))
            return F.concat(days, F.lit(" "), F.get(texts, i))

        return let((F.coalesce(F.array_min(F.filter(begins, lambda j: j > i)), F.lit(7)) - 1).cast("int"), named)

    return F.nullif(F.array_join(let(F.transform(hours, _day_text), shown), "; "), F.lit(""))


def plausible(hours: Column) -> Column:
    """Fixed windows of 30 minutes to 20 hours stay, others become unknown; null if no day is left."""
    unknown = F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast(BOUND).alias("open"), F.lit(None).cast(BOUND).alias("close"))
    length = lambda d: d["close"]["m"] - d["open"]["m"]
    odd = lambda d: (d["kind"] == "window") & (d["open"]["t"] == "time") & (d["close"]["t"] == "time") & ~length(d).between(30, 1200)
    checked = F.transform(hours, lambda d: F.when(odd(d), unknown).otherwise(d))
    return F.when(F.exists(checked, lambda d: d["kind"] != "unknown"), checked)
