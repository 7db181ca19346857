"""Walks over links, all starts at once: pointers followed to their end, and a bounded search for a page of a kind.

Each hop is a shuffled join of the walks' present pages with the links, so nothing grows with the number of hops but the plan;
what a walk has seen is a table, and its next candidates are an anti join against it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import materialise


def follow(starts: DataFrame, pointers: DataFrame, hops: int) -> DataFrame:
    """(start, page, hops) of starts (start): pointers (page, target) followed until a page has none, hops times at most.

    Of several pointers of a page the smallest target counts. A circle ends where the hops do.
    """
    one = pointers.filter("target is not null").groupBy("page").agg(F.min("target").alias("target"))
    walk = starts.select("start", F.col("start").alias("page"), F.lit(0).alias("hops"))
    for _ in range(hops):
        onward = F.col("target").isNotNull().cast("int")
        walk = walk.join(one, "page", "left").select("start", F.coalesce("target", "page").alias("page"), (F.col("hops") + onward).alias("hops"))
    return walk


def hunt(starts: DataFrame, links: DataFrame, pages: DataFrame, hops: int = 3, most: int = 8) -> DataFrame:
    """(start, page, found, hops): from each start to the first page that is wanted.

    links (page, seq, target), pages (page, wanted), of which those that can't be read are absent. Each hop tries the first `most`
    targets, in order of seq (ties: the target), that this walk hasn't tried; the first one wanted ends the walk, else the first readable one is gone
    on from. A walk without readable targets, or whose hops are used up, ends where it is. Starts that can't be read are not found.
    """
    known = pages.select("page", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    walk = starts.select("start", F.col("start").alias("page")).join(known, "page", "left")
    walk = materialise(walk.select("start", "page", F.coalesce("wanted", F.lit(False)).alias("found"), F.lit(0).alias("hops"), (~F.coalesce("wanted", F.lit(False))).alias("open")), "walk")
    seen = walk.select("start", "page")
    for _ in range(hops):
        targets = walk.filter("open").select("start", "page").join(links, "page").groupBy("start", F.col("target").alias("page")).agg(F.min("seq").alias("seq"))
        order = Window.partitionBy("start").orderBy("seq", "page")
        tried = targets.join(seen, ["start", "page"], "left_anti").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
        tried = materialise(tried.join(known, "page", "left"), "tried")
        hit = F.min(F.when(F.col("wanted"), F.struct("nth", "page")))
        readable = F.min(F.when(F.col("wanted").isNotNull(), F.struct("nth", "page")))
        best = tried.groupBy("start").agg(hit.alias("hit"), readable.alias("readable"))
        step = walk.join(best, "start", "left")
        moved = F.col("open") & F.col("readable").isNotNull()
        found = F.col("open") & F.col("hit").isNotNull()
        target = F.when(found, F.col("hit.page")).when(moved, F.col("readable.page")).otherwise(F.col("page"))
        step = step.select("start", target.alias("page"), (F.col("found") | found).alias("found"), (F.col("hops") + moved.cast("int")).alias("hops"), (moved & ~found).alias("open"))
        walk, seen = materialise(step, "walk"), materialise(seen.unionByName(tried.select("start", "page")), "seen")
    return walk.drop("open")
