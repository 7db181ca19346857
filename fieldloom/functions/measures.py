"""Numbers: the three roundings, thresholds, coordinates, wind and runways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Rank of a source of opening hours.
SOURCE_RANK = {"eaip": 4, "dfs-ocr-hours": 3, "pdf-ocr-hours": 3, "openaip": 2, "osm": 1}


def round_up_half(x: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero: -2.5 is -2."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def ladder(value: Column, warn: float, crit: float) -> Column:
    """ok, warn or crit; higher is worse and bounds belong to the worse level."""
    return F.when(value >= crit, "crit").when(value >= warn, "warn").otherwise("ok")


def percent(x: Column) -> Column:
    """0..1 is a share (so 1 is 100 %), up to 100 a percentage, anything else unknown; one digit, halves to even."""
    return F.when((x >= 0) & (x <= 1), F.bround(x * 100, 1)).when((x > 1) & (x <= 100), F.bround(x, 1))


def source_rank(source: Column) -> Column:
    out = F.lit(0)
    for name, rank in SOURCE_RANK.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_KM)


def box_half_widths(lat: Column, km: float = 100.0) -> tuple[Column, Column]:
    """Degrees of latitude and longitude that hold a circle of km; longitude stops growing near the poles."""
    return F.lit(km / 111.0), F.lit(km / 111.0) / F.greatest(F.cos(F.radians(lat)), F.lit(0.2))


def wind_components(heading: Column, wind_from: Column, speed: Column) -> Column:
    """struct(head, cross, side): whole knots; tail wind is negative; side is where the wind comes from."""
    angle = F.radians(wind_from - heading)
    return F.struct(round_up_half(F.cos(angle) * speed).cast("int").alias("head"), round_up_half(F.abs(F.sin(angle) * speed)).cast("int").alias("cross"), F.when(F.sin(angle) >= 0, "right").otherwise("left").alias("side"))


def runway_heading(end: Column) -> Column:
    """Degrees of a runway end by its one or two leading digits, whatever follows (06, 24L, 18W); null unless 1 to 36."""
    n = F.regexp_extract(F.trim(end), r"^([0-9]{1,2})", 1).try_cast("int")
    return F.when(n.between(1, 36), n * 10)


def compass_point(heading: Column) -> Column:
    """One of eight points."""
    return F.element_at(F.array(*[F.lit(p) for p in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")]), (F.pmod(F.floor(heading / 45 + 0.5), F.lit(8)) + 1).cast("int"))


def feet(metres: Column, half_even: bool = False) -> Column:
    x = metres / 0.3048
    return (round_half_even(x) if half_even else round_up_half(x)).cast("int")


#: What free text says of a surface; the first class that fits counts.
SURFACE_WORDS = (
    ("paved", "asp|asph|concrete|conc|pav|bitum|seal|tar|paved|pem"),
    ("grass", "gras|turf|grn|lawn"),
    ("loose", "grav|gvl|dirt|earth|sand|clay|coral|later|murram|soil"),
    ("water", "water"),
    ("snow", "snow|ice"),
)
#: The other reading of paved, for the map's filter (they differ on purpose).
HARD_SURFACE = "(?i)asp|con|pem|bit|tarmac|paved|seal|macadam"


def surface_class(surface: Column) -> Column:
    """First class that fits; other if none does, or without text."""
    s = F.coalesce(F.lower(surface), F.lit(""))
    return F.coalesce(*[F.when(s.rlike(words), F.lit(name)) for name, words in SURFACE_WORDS], F.lit("other"))


def general(value: Column, most: int = 6) -> Column:
    """Six (or `most`) significant digits without trailing zeros."""
    digits = F.greatest(F.lit(0), F.lit(most - 1) - F.floor(F.log10(F.greatest(F.abs(value), F.lit(1e-4)))).cast("int"))
    text = F.format_string("%.12f", F.expr("0.0") + F.when(digits >= 0, F.round(value * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)))
    return F.regexp_replace(text, r"\.?0+$", "")


def formatted(value: Column, unit: Column, largest: str = "TB", digits: int = 6) -> Column:
    """Bytes in steps of 1024 up to TB (or `largest`) with one digit; percentages, seconds and other numbers in general form with their unit; - for none."""
    steps, names = F.lit(None).cast("string"), ("B", "KB", "MB", "GB", "TB")
    for i, name in reversed(list(enumerate(names[: names.index(largest) + 1]))):
        text = F.format_string(f"%.1f {name}", F.bround(value / float(1024**i), 1))  # ties to even digits
        steps = text if name == largest else F.when(value < float(1024 ** (i + 1)), text).otherwise(steps)
    number = general(value, digits)
    other = F.when(unit == "pct", F.concat(number, F.lit(" %"))).when(F.coalesce(unit, F.lit("")) == "", number).otherwise(F.concat(number, F.lit(" "), unit))
    return F.when(value.isNull(), "-").when(unit == "bytes", steps).otherwise(other)


def runway_ends(ident: Column) -> Column:
    """Headings of a runway's ends (06/24L), each once, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(ident, "/"), runway_heading), lambda h: h.isNotNull())))
