"""Joins by distance. A grid turns the box into an equi-join; without one Spark would compare everything with everything.

Rows at the same place are compared once: distances are those of places, and rows are joined to them by place. So nearest and k_nearest
carry as many pairs as places have neighbours, not as rows have; within_box returns each pair of rows, which can be as many as the product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.measures import box_half_widths, haversine_km

PLACE = ["lat", "lon"]


def _placed(df: DataFrame, id_: str) -> DataFrame:
    return df.filter("lat is not null and lon is not null").select(id_, *PLACE)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to all cores by keys: what follows makes far more rows of it than its size tells."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def _places(probe: DataFrame, sites: DataFrame, km: float) -> DataFrame:
    """Pairs (lat, lon, slat, slon, km) of places of probes and sites inside the probe's box, each once.

    Cells are as high as the box; a probe looks into as many cells east and west as its box spans at its
    latitude. Boxes don't wrap at 180 degrees.
    """
    cell = km / 111.0
    half_lat, half_lon = box_half_widths(F.col("lat"), km)
    at = lambda c: F.floor(c / F.lit(cell)).cast("int")
    span = lambda c, half: F.explode(F.sequence(at(F.col(c) - F.col(half)), at(F.col(c) + F.col(half))))
    p = probe.select(*PLACE).distinct().select(*PLACE, half_lat.alias("hy"), half_lon.alias("hx")).withColumn("cy", span("lat", "hy")).withColumn("cx", span("lon", "hx"))
    s = sites.select(F.col("lat").alias("slat"), F.col("lon").alias("slon")).distinct().select("slat", "slon", at(F.col("slat")).alias("cy"), at(F.col("slon")).alias("cx"))
    inside = F.col("slat").between(F.col("lat") - F.col("hy"), F.col("lat") + F.col("hy")) & F.col("slon").between(F.col("lon") - F.col("hx"), F.col("lon") + F.col("hx"))
    distance: Column = haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    return _spread(p, "cy", "cx").join(s, ["cy", "cx"]).filter(inside).select(*PLACE, "slat", "slon", distance.alias("km"))


def _at_site(df: DataFrame, site_id: str) -> DataFrame:
    return df.select(site_id, F.col("lat").alias("slat"), F.col("lon").alias("slon"))


def within_box(probe: DataFrame, sites: DataFrame, id_: str, site_id: str, km: float = 100.0) -> DataFrame:
    """Pairs (id, site_id, km) of probes and sites (both with lat, lon) inside the probe's box, with their distance."""
    p, s = _placed(probe, id_), _placed(sites, site_id)
    pairs = _spread(_places(p, s, km).join(p, PLACE).select(id_, "slat", "slon", "km"), "slat", "slon", id_)
    return pairs.join(_at_site(s, site_id).hint("shuffle_hash"), ["slat", "slon"]).select(id_, site_id, "km")


def nearest(probe: DataFrame, sites: DataFrame, id_: str, site_id: str, km: float = 100.0) -> DataFrame:
    """The nearest site in the box; equal distances go to the smaller site_id."""
    return _nearest(probe, sites, id_, site_id, 1, km, F.lit(True)).drop("rank")


def k_nearest(probe: DataFrame, sites: DataFrame, id_: str, site_id: str, k: int = 4, km: float = 100.0) -> DataFrame:
    """The k nearest other sites within km, each once."""
    return _nearest(probe, sites, id_, site_id, k, km, (F.col("km") <= km) & (F.col(site_id) != F.col(id_)))


def _nearest(probe: DataFrame, sites: DataFrame, id_: str, site_id: str, k: int, km: float, counts: Column) -> DataFrame:
    """(id, site_id, km, rank): the k nearest sites of those that count, ties to the smaller site_id.

    A site's own probe may not count, so k + 1 are kept of each site's place (the smallest ids) and for each probe's place. A site
    that stands in several places counts where it is nearest: whichever it loses to at a place precedes it everywhere after.
    """
    p, s = _placed(probe, id_), _placed(sites, site_id)
    first = F.row_number().over(Window.partitionBy("slat", "slon").orderBy(F.asc_nulls_last(site_id)))
    few = _at_site(s, site_id).distinct().withColumn("_n", first).filter(F.col("_n") <= k + 1).drop("_n")
    pairs = _places(p, s, km).filter(F.col("km").isNotNull()).join(few, ["slat", "slon"]).groupBy(*PLACE, site_id).agg(F.min("km").alias("km"))
    by_place = F.row_number().over(Window.partitionBy(*PLACE).orderBy("km", F.asc_nulls_last(site_id)))
    found = pairs.withColumn("_n", by_place).filter(F.col("_n") <= k + 1).drop("_n").join(p, PLACE).filter(counts)
    once = found.groupBy(id_, site_id).agg(F.min("km").alias("km"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(id_).orderBy("km", F.asc_nulls_last(site_id)))).filter(F.col("rank") <= k)
