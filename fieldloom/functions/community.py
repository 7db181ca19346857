"""Community items (parsed JSON) as normalised facts. A field of another type than the schema's is null or left out, never read as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.measures import round_up_half
from fieldloom.functions.text import json_number, json_text

#: What the numbers of an item stand for; metres to feet.
SURFACE = {
    0: "Asphalt", 1: "Concrete", 2: "Grass", 3: "Sand", 4: "Water", 5: "Bituminous", 6: "Brick", 7: "Macadam", 8: "Stone", 9: "Coral", 10: "Clay",
    11: "Laterite", 12: "Gravel", 13: "Earth", 14: "Ice", 15: "Snow", 17: "Metal", 20: "Wood", 22: "Unknown",
}
FREQUENCY = {
    0: "Approach", 1: "Apron", 2: "Arrival", 3: "Center", 4: "CTAF", 5: "Delivery", 6: "Departure", 7: "FIS", 8: "Gliding", 9: "Ground", 10: "Information",
    11: "Multicom", 12: "Unicom", 13: "Radar", 14: "Tower", 15: "ATIS", 16: "Radio", 17: "Other", 19: "AWOS", 22: "AFIS", 25: "Emergency", 26: "Clearance Delivery",
}
FUEL = {0: "Super PLUS", 1: "AVGAS", 2: "Jet A", 3: "Jet A-1", 4: "Jet B", 5: "Diesel", 6: "AVGAS UL91"}
PATTERN = {0: "right", 1: "left"}
FEET = 3.28084
RESTAURANT, CUSTOMS = 5, 2


def json_object(text: Column) -> Column:
    """Parsed JSON if it is an object; arrays, other values and what isn't JSON are null."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def _list(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "array<variant>")


def _label(number: Column, table: dict[int, str]) -> Column:
    """What a number stands for; null for one that isn't in the table, fractions among them."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (float(k), v)]), number)


def _feet(doc: Column, path: str) -> Column:
    value = json_number(doc, f"{path}.value")
    return round_up_half(F.when(json_number(doc, f"{path}.unit") == 1, value).otherwise(value * FEET)).cast("long")


def facts(df: DataFrame, doc: str) -> DataFrame:
    """df's rows with the facts of their item instead of it; a null item has no facts: nulls, and empty lists.

    Coordinates stand longitude first in an item. A list that is absent says nothing (null), one that lacks a code says no. Runways
    without a designator and frequencies without a text value are left out; circuits that go both ways are null.
    """
    v = F.col(doc)
    own = F.struct(
        json_number(v, "$.geometry.coordinates[1]").alias("lat"), json_number(v, "$.geometry.coordinates[0]").alias("lon"), _feet(v, "$.elevation").alias("elevation_ft"),
        F.when(F.schema_of_variant(F.try_variant_get(v, "$.ppr", "variant")) == "BOOLEAN", F.try_variant_get(v, "$.ppr", "boolean")).alias("ppr"),
    )
    given = F.schema_of_variant(F.try_variant_get(v, "$.services.fuelTypes", "variant"))
    fuels = F.when(given.isNull() | (given == "VOID"), _list(v, "$.fuelTypes")).otherwise(_list(v, "$.services.fuelTypes"))
    named = F.array_compact(F.transform(fuels, lambda x: _label(json_number(x, "$"), FUEL)))
    offered = F.transform(_list(v, "$.services.passengerFacilities"), lambda x: F.coalesce(json_number(x, "$"), F.lit(-1.0)))
    runways = F.transform(
        _list(v, "$.runways"),
        lambda r: F.struct(
            F.nullif(json_text(r, "$.designator"), F.lit("")).alias("ident"), _feet(r, "$.dimension.length").alias("length_ft"), _feet(r, "$.dimension.width").alias("width_ft"),
            _label(json_number(r, "$.surface.mainComposite"), SURFACE).alias("surface"), _label(json_number(r, "$.turnDirection"), PATTERN).alias("traffic_pattern"),
        ),
    )
    name = lambda f: json_text(f, "$.name")
    frequencies = F.transform(
        _list(v, "$.frequencies"),
        lambda f: F.struct(F.coalesce(name(f), _label(json_number(f, "$.type"), FREQUENCY), F.lit("")).alias("type"), name(f).alias("description"), F.nullif(json_text(f, "$.value"), F.lit("")).alias("mhz")),
    )
    some = lambda rows, key: F.coalesce(F.filter(rows, lambda x: x[key].isNotNull()), F.array())
    return df.select(
        *[c for c in df.columns if c != doc], own.alias("_own"), F.coalesce(named, F.array().cast("array<string>")).alias("fuel"),
        F.array_contains(offered, float(RESTAURANT)).alias("restaurant"), F.array_contains(offered, float(CUSTOMS)).alias("customs"),
        json_number(v, "$.type").alias("aerodrome_type"), some(runways, "ident").alias("runways"), some(frequencies, "mhz").alias("frequencies"),
    ).select(*[c for c in df.columns if c != doc], "_own.*", "fuel", "restaurant", "customs", "aerodrome_type", "runways", "frequencies")
