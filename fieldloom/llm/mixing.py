"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents stand in a seeded order and their words form blocks of `block_words`. All
blocks of the mix are seats: source i's s-th seat has the quotient target_i / (2s + 1), and the
highest quotients win. The method is house monotone, so the seats that shard h adds to those of
the shards before it are its quotas: integers, for every source and shard. Documents stand in the order of a seeded hash, so
their blocks do; from a seeded start, going round, each shard takes as many blocks as its quota says, one shard after the other. A
document gets the words of the blocks that it shares with each shard's run.

Everything is DataFrame work without Python. Texts never move: only (id, source, size) is shuffled.
Sizes inside a source are summed in two steps, within hashed buckets and over buckets, so that a
source with a third of all rows never meets in one task. Quotas need a few rows for each source and shard.

Defined cases: a null text has size 0; the null source is a source of its own, last in order; documents
without words are never taken (0); repeated rows count each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import WORD, bounded_broadcast
from fieldloom.session import materialise

#: Weights by the source's place in code-point order, repeating.
WEIGHTS = (3, 1, 2)
BUCKETS = 2048
SOURCES_BROADCAST = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size) -> with place, weight and target.

    Targets share `share` of all sizes by weight; none is above `most` times its source's size. The excess is
    reshared by weight: in order of size over weight, a source is full if the level that
    all sources from it on would get is not below its own; one pass over prefix sums finds the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sources.withColumn("place", F.row_number().over(order) - 1)
    ws = F.array(*[F.lit(float(w)) for w in weights])
    placed = placed.withColumn("weight", F.element_at(ws, (F.col("place") % len(weights) + 1).cast("int")))
    cap = F.col("source_size").cast("double") * most
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    since = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = (
        placed.withColumn("cap", cap)
        .withColumn("budget", F.sum(F.col("source_size").cast("double")).over(everything) * share)
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(since))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("rest", F.min(F.when(~F.col("full"), F.col("level"))).over(everything))
    )
    # the level of the first source that isn't full holds for all of these: later levels are no lower
    first = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level").alias("level")))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(first["level"] * F.col("weight"), F.col("cap")))
    return filled.select("source", "source_size", "place", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, houses: Column) -> DataFrame:
    """Seats by highest quotients vote / (2s + 1): (party, vote) -> (house, party, won).

    houses is an array of struct(house, seats), one for each house that is to be filled; it may refer to `all_votes`.
    Exact, without going through all quotients: the divisor method's seats lie within a narrow band
    around the party's share, so those below the band are won for sure and only the band (together about three quotients
    for each party) is ranked. Ties go to the smaller party.
    """
    everything = Window.partitionBy()
    summed = parties.filter("vote > 0").withColumn("all_votes", F.sum("vote").over(everything)).withColumn("n", F.count(F.lit(1)).over(everything))
    sized = summed.select("party", "vote", "all_votes", "n", F.inline(houses))
    share = F.col("vote") / F.col("all_votes")
    low = F.greatest(F.lit(0), F.floor(share * (F.col("seats") - F.col("n") / 2) - 1.5)).cast("long")
    high = F.ceil(share * (F.col("seats") + F.col("n") / 2) + 1.5).cast("long")
    sized = sized.withColumn("low", low).withColumn("high", high).withColumn("sure", F.sum("low").over(Window.partitionBy("house")))
    band = sized.withColumn("s", F.explode(F.sequence("low", "high"))).withColumn("q", F.col("vote") / (F.col("s") * 2 + 1))
    rank = F.row_number().over(Window.partitionBy("house").orderBy(F.col("q").desc(), "party", "s"))
    taken = F.col("rank") <= F.col("seats") - F.col("sure")
    return band.withColumn("rank", rank).groupBy("house", "party").agg((F.min("low") + F.count_if(taken)).alias("won"))


def quotas(sources: DataFrame, block_words: int, shards: int) -> DataFrame:
    """(place, target) -> one row per source and shard: place, shard, quota, upto (quotas until this shard)."""
    seats = F.round(F.col("all_votes") / block_words).cast("long")
    houses = F.transform(F.sequence(F.lit(0), F.lit(shards)), lambda h: F.struct(h.alias("house"), F.floor(seats * h / shards).cast("long").alias("seats")))
    won = sainte_lague(sources.select(F.col("place").alias("party"), F.col("target").alias("vote")), houses)
    steps = Window.partitionBy("party").orderBy("house")
    return won.select(F.col("party").alias("place"), (F.col("house") - 1).alias("shard"), (F.col("won") - F.lag("won").over(steps)).alias("quota"), F.col("won").alias("upto")).filter("shard >= 0")


def mix(docs: DataFrame, seed: int = 17, block_words: int = 64, shards: int = 16, key: str = "doc_id", extra: list[str] | None = None) -> DataFrame:
    """One row per document: key, size, source, source_size, target, taken, parts and its place in the source's order.

    `parts` are the runs of words that the mix takes: struct(shard, a, b) for words [a, b) taken for a shard, by place in the
    mix; a document that is taken twice has its words in two of them, at least.
    """
    text = F.col("text")
    slim = materialise(docs.select(key, "source", n_words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(key), F.col("source"), F.length(text), *(extra or [])).alias("h"), *(extra or [])), "mix-sizes")
    targets = materialise(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    won = quotas(targets, block_words, shards).groupBy("place").agg(F.array_sort(F.collect_list(F.struct("shard", "quota", "upto"))).alias("seats"))  # one for each shard
    ring = F.ceil(F.col("source_size") / block_words).cast("long") * block_words
    plan = targets.join(won, "place", "left").select("source", "source_size", "target", "seats", ring.alias("ring"))
    plan = plan.withColumn("begin", F.pmod(F.xxhash64(F.lit(seed), "source"), F.greatest(F.col("ring") / block_words, F.lit(1)).cast("long")) * block_words)
    edge = lambda blocks: F.col("begin") + F.least(blocks * block_words, F.col("ring") * 2)
    runs = F.transform("seats", lambda x: F.struct(x["shard"].cast("int").alias("shard"), edge(x["upto"] - x["quota"]).alias("lo"), edge(x["upto"]).alias("hi")))
    plan = plan.select(F.col("source").alias("plan_source"), "source_size", "target", "ring", runs.alias("runs"))
    plan = bounded_broadcast(plan, SOURCES_BROADCAST)

    bucket = F.pmod(F.col("h"), F.lit(BUCKETS)).cast("int")
    slim = slim.withColumn("bucket", bucket)
    sums = slim.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("s").over(over), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", F.col(key).asc_nulls_first(), "size", *(extra or [])).rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))).withColumn("at", F.col("offset") + F.col("inside"))
    out = placed.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    # the runs go round the ring of blocks up to twice from `begin`: the document lies in their way at most three times
    at, size = F.col("at"), F.col("size")

    def met(turn: int) -> Column:
        start = at + F.col("ring") * turn
        cut = lambda r, end: F.greatest(F.lit(0), F.least(size, r[end] - start)).cast("long")
        return F.filter(F.transform("runs", lambda r: F.struct(r["shard"].alias("shard"), cut(r, "lo").alias("a"), cut(r, "hi").alias("b"))), lambda x: x["b"] > x["a"])

    parts = F.coalesce(F.concat(*[met(turn) for turn in range(3)]), F.array().cast("array<struct<shard:int,a:bigint,b:bigint>>"))
    out = out.withColumn("parts", parts)
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda total, x: total + x["b"] - x["a"])
    return out.select(key, "size", "source", "source_size", "target", taken.alias("taken"), "parts", "at", *(extra or []))


def mixed_documents(docs: DataFrame, seed: int = 17, block_words: int = 64, shards: int = 16, shard: str | None = None) -> DataFrame:
    """The mix itself, with the columns of docs (and a column `shard`, if it is named): each document as often as the mix takes it.

    A document of which the ends of a shard's blocks take a part is cut to the words taken (each with the white space after it). Cut
    texts are a few for each source and shard; all others stay as they are. `n_chars` is counted anew if docs has it. Texts are joined
    with their shares by doc_id, source and a hash of the text; rows that are alike in these share alike.
    """
    columns = docs.columns
    own = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash"))
    told = mix(own, seed, block_words, shards, extra=["text_hash"])
    # rows that are alike in key, source and text are gathered on both sides; most aren't repeated
    told = materialise(told.filter("taken > 0").select("doc_id", "source", "text_hash", "size", "at", "parts"), "mix-shares")
    same = ["doc_id", "source", "text_hash"]
    repeated = told.groupBy(*same).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").limit(1).count()
    one = docs.dropDuplicates(["doc_id", "source", "text"]) if repeated else docs
    s = told.select(F.struct("doc_id", "source", "text_hash").alias("s"), "size", F.explode("parts").alias("part"))
    row = F.col("row")
    rows = one.select(F.struct(*columns).alias("row"), F.xxhash64("text").alias("row_hash"))
    on = row["doc_id"].eqNullSafe(F.col("s")["doc_id"]) & row["source"].eqNullSafe(F.col("s")["source"]) & (F.col("row_hash") == F.col("s")["text_hash"])
    j = rows.join(s, on)
    pieces = F.split(F.regexp_replace(row["text"], r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, (F.col("part.a") + 1).cast("int"), (F.col("part.b") - F.col("part.a")).cast("int")), "")
    new = F.when((F.col("part.a") == 0) & (F.col("part.b") == F.col("size")), row["text"]).otherwise(cut)
    out = j.select("row", new.alias("new"), "part")
    kinds = {c: docs.schema[c].dataType for c in columns}
    made = {"text": F.col("new"), "n_chars": F.length("new")}
    return out.select(*[(made[c].cast(kinds[c]) if c in made else row[c]).alias(c) for c in columns], *([F.col("part.shard").alias(shard)] if shard else []))
