"""Delimited files with a header, and JSON lines: every field is text or guarded by its type, so a bad row costs only itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.measures import round_up_half
from fieldloom.functions.text import json_number, json_text

BAD = "_bad"


def csv_rows(spark: SparkSession, path: str, columns: dict[str, str], names: list[str] | None = None, multiline: bool = False) -> DataFrame:
    """Rows of delimited files with a header, by its names: the declared columns cast to their types, then _bad.

    A value that its type can't hold is null, and so is a column that the files don't have; a line with too few or too many values is
    kept whole in _bad (else null). Quoted line breaks need multiline, which reads a file as one task. names is the header that all files
    share, read from one of them if it isn't given. `_order` (file, split, row) is the order in which the rows stand in the files.
    """
    names = names or spark.read.option("header", True).csv(path).columns
    declared = ", ".join(f"`{c}` string" for c in [*names, BAD])
    raw = spark.read.schema(declared).options(header=True, columnNameOfCorruptRecord=BAD, multiLine=multiline, escape='"').csv(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    typed = [(F.col(f"`{c}`") if c in names else F.lit(None)).try_cast(t).alias(c) for c, t in columns.items()]
    return raw.select(*typed, BAD, at.alias("_order"))


def _code(column: str) -> Column:
    code = F.upper(F.trim(F.coalesce(column, F.lit(""))))
    return F.when(code.rlike("^[A-Z]{4}$"), code)


def aerodromes(rows: DataFrame, country: str, kinds: tuple[str, ...], url: str, kind: str = "vfr") -> DataFrame:
    """country, icao, title, url, type of a country's aerodromes: of the same code the row that stands first in the files.

    The code is icao_code, else ident, if that is four letters; rows without one drop out. One call serves every country.
    """
    code = F.coalesce(_code("icao_code"), _code("ident"))
    known = rows.filter((F.upper(F.trim("iso_country")) == country) & F.trim("type").isin(*kinds)).withColumn("icao", code).filter("icao is not null")
    first = known.groupBy("icao").agg(F.min_by(F.struct(F.trim(F.coalesce("name", F.lit(""))).alias("name")), "_order").alias("r"))
    title = F.when(F.col("r.name") != "", F.concat_ws(" ", "r.name", "icao")).otherwise(F.col("icao"))
    return first.select(F.lit(country).alias("country"), "icao", title.alias("title"), F.lit(url).alias("url"), F.lit(kind).alias("type"))


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """doc (variant) and _bad of JSON lines: a line that isn't JSON has a null doc and stands in _bad; blank lines drop out."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    doc = F.try_parse_json("value")
    return lines.select(doc.alias("doc"), F.when(doc.isNull(), F.col("value")).alias(BAD))


def observations(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Station observations, typed field by field: a field of another type is null, never its text. Rows without a report drop out.

    Wind direction and visibility come as text or number and are text here; pressure is rounded, halves up; clouds that aren't a list are none.
    """
    v = F.col(doc)
    either = lambda path: F.coalesce(json_text(v, path), F.when(json_number(v, path).isNotNull(), F.try_variant_get(v, path, "string")))
    layers = F.coalesce(F.try_variant_get(v, "$.clouds", "array<variant>"), F.array().cast("array<variant>"))
    clouds = F.transform(layers, lambda c: F.struct(json_text(c, "$.cover").alias("cover"), json_number(c, "$.base").alias("base")))
    numbers = [json_number(v, f"$.{c}").alias(c) for c in ("wspd", "wgst", "temp", "dewp", "lat", "lon", "elev")]
    out = docs.select(
        *[c for c in docs.columns if c not in (doc, BAD)], json_text(v, "$.icaoId").alias("icao"), json_text(v, "$.rawOb").alias("raw"), json_text(v, "$.reportTime").alias("obs_time"), json_text(v, "$.fltCat").alias("flt_cat"),
        either("$.wdir").alias("wdir"), either("$.visib").alias("visib"), round_up_half(json_number(v, "$.altim")).cast("long").alias("altim"), *numbers, clouds.alias("clouds"),
    )
    return out.filter("raw is not null")
