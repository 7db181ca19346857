"""Filters, joins, aggregations and set operations. Column names are parameters, so they run on any schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conjunction(preds: list[Column | None]) -> Column:
    """All given conditions; absent ones don't count."""
    return reduce(lambda a, b: a & b, [p for p in preds if p is not None], F.lit(True))


def search(df: DataFrame, term: str, columns: list[str], limit: int, order: str, where: Column | None = None) -> DataFrame:
    """Rows that have term in one of the columns, without regard to case; % and _ are wild cards, as in SQL."""
    hit = reduce(lambda a, b: a | b, [F.expr(f"`{c}` ILIKE {_quoted('%' + term + '%')} ESCAPE '\x01'") for c in columns])
    return df.filter(conjunction([hit, where])).orderBy(order).limit(limit)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def box(df: DataFrame, lat: str, lon: str, south: float, north: float, west: float, east: float) -> DataFrame:
    """Inclusive on all sides; rows without coordinates drop out."""
    return df.filter(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def known_true(df: DataFrame, flags: list[str]) -> DataFrame:
    """Rows whose flags are all known to be true: unknown isn't true."""
    return df.filter(conjunction([F.coalesce(F.col(f), F.lit(False)) for f in flags]))


def clamped_limit(limit: int | None, default: int = 5000, most: int = 20000) -> int:
    return min(default if limit is None else limit, most)


def missing(left: DataFrame, right: DataFrame, key: str, first: list[str], order: str) -> DataFrame:
    """Keys of left without a row in right; of each key's rows the first in order speaks."""
    return left.join(right, key, "left_anti").groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in first])


def without_value(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of left for which right has no known value: no row, or an unknown one."""
    return left.join(right.filter(F.col(value).isNotNull()), key, "left_anti")


def symmetric_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that were added or removed, with which."""
    return new.join(old, key, "left_anti").select(key, F.lit("added").alias("change")).unionByName(old.join(new, key, "left_anti").select(key, F.lit("removed").alias("change")))


def as_of(df: DataFrame, by: list[str], when: str, value: str, today: Column) -> DataFrame:
    """The latest value up to today, else the earliest."""
    past = F.max_by(value, F.when(F.col(when) <= today, F.col(when)))
    return df.groupBy(*by).agg(F.coalesce(past, F.min_by(value, when)).alias(value), F.coalesce(F.max(F.when(F.col(when) <= today, F.col(when))), F.min(when)).alias(when))


def newest(df: DataFrame, by: list[str], when: str, value: str) -> DataFrame:
    """The latest value, whether or not it is in force yet."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(when, value)).alias(value))


def labelled_or_first(df: DataFrame, by: list[str], label: Column, value: str, order: str) -> DataFrame:
    """The first value whose row fits label, else the first of all."""
    return df.groupBy(*by).agg(F.coalesce(F.min_by(value, F.when(label, F.col(order))), F.min_by(value, order)).alias(value))


def override(base: DataFrame, over: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of over where it has them, else those of base."""
    o = over.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(o, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def precedence_merge(sources: list[tuple[str, DataFrame]], key: str, columns: list[str]) -> DataFrame:
    """One row per key of any source; each column from the first source that knows it; `source` names those that have a row."""
    tagged = [df.select(key, F.lit(i).alias("_i"), F.lit(name).alias("_n"), *columns) for i, (name, df) in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    return rows.groupBy(key).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_i"))).alias(c) for c in columns],
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("_i", "_n"))), lambda x: x["_n"]), "+").alias("source"),
    )


def add_if_absent(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of first, and rows of second whose key first doesn't have; rows without key are always added."""
    return first.unionByName(second.filter(F.col(key).isNotNull()).join(first, key, "left_anti").select(*first.columns)).unionByName(second.filter(F.col(key).isNull()).select(*first.columns))


def gather(df: DataFrame, by: list[str], fields: list[str], order: str, name: str) -> DataFrame:
    """Children of each key as an array of structs in order."""
    items = F.array_sort(F.collect_list(F.struct(order, *fields)))
    return df.groupBy(*by).agg(F.transform(items, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def mode_first(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent known value; ties go to the one seen first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("seen"))).alias(value), F.max("n").alias("n"))


def roll_up(df: DataFrame, status: str, label: str, by: list[str]) -> DataFrame:
    """Counts of crit, warn and ok, the worst level and the labels at crit; other levels aren't counted."""
    n = {s: F.count_if(F.col(status) == s) for s in ("crit", "warn", "ok")}
    worst = F.when(n["crit"] > 0, "crit").when(n["warn"] > 0, "warn").when(n["ok"] > 0, "ok")
    return df.groupBy(*by).agg(*[c.alias(f"n_{s}") for s, c in n.items()], worst.alias("worst"), F.array_join(F.array_sort(F.collect_set(F.when(F.col(status) == "crit", F.col(label)))), ",").alias("crit_labels"))


def coverage(df: DataFrame, by: list[str], has: Column, gated: Column) -> DataFrame:
    """with, total and bucket; a gated group has none."""
    n = df.groupBy(*by).agg(F.count_if(has).alias("raw"), F.count(F.lit(1)).alias("total"), F.max(gated).alias("gated"))
    with_ = F.when(F.col("gated"), 0).otherwise(F.col("raw"))
    return n.select(*by, with_.cast("long").alias("with"), "total", F.when(with_ == 0, "none").when(with_ == F.col("total"), "full").otherwise("partial").alias("bucket"))


def count_guard(now: DataFrame, last: DataFrame, by: list[str], block: float = 0.5, warn: float = 0.85) -> DataFrame:
    """Compare counts with the last published ones: below block of them stops, below warn is told, without last ones all passes."""
    j = now.join(last.withColumnRenamed("n", "last"), by, "left")
    verdict = F.when(F.col("last").isNull() | (F.col("last") == 0), "pass").when(F.col("n") < F.col("last") * block, "block").when(F.col("n") < F.col("last") * warn, "warn").otherwise("pass")
    return j.select(*by, "n", "last", verdict.alias("verdict"))


def by_category(df: DataFrame, category: Column, order: list[str], name: str) -> DataFrame:
    """Rows by category in a fixed order; empty categories don't appear."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("category"))
    return df.withColumn("category", category).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias(f"first_{name}")).withColumn("place", place.cast("int")).filter("place > 0")


def priority_pick(df: DataFrame, by: list[str], ranks: list[Column], value: str, order: str) -> DataFrame:
    """The first row of the first rank that any row fits; rows that fit none come last."""
    rank = F.coalesce(*[F.when(c, i) for i, c in enumerate(ranks)], F.lit(len(ranks)))
    return df.withColumn("_r", rank).groupBy(*by).agg(F.min_by(value, F.struct("_r", order)).alias(value), F.min("_r").alias("rank"))


def first_that_yields(df: DataFrame, by: list[str], candidate: str) -> DataFrame:
    """The rows of the first candidate that has any."""
    best = df.groupBy(*by).agg(F.min(candidate).alias("_m"))  # combined before it is shuffled, so a source with many rows isn't one task
    return df.join(best, by).filter(F.col(candidate) == F.col("_m")).drop("_m")


def word_subset(small: Column, large: Column) -> Column:
    """Whether all words of small are in large."""
    words = lambda c: F.array_distinct(F.split(F.lower(F.trim(c)), r"\s+"))
    return F.size(F.array_except(words(small), words(large))) == 0


def sanitized(df: DataFrame, code: str, title: str, order: str) -> DataFrame:
    """Rows with `verdict`: duplicate (a code's later rows), bad_icao, bad_title (doesn't end with its code) or ok; rows without code are kept as they are (null)."""
    c, t = F.upper(F.trim(F.coalesce(F.col(code), F.lit("")))), F.trim(F.coalesce(F.col(title), F.lit("")))
    again = F.when(c != "", F.row_number().over(Window.partitionBy(c, F.when(c == "", F.xxhash64(order))).orderBy(order)) > 1)
    verdict = F.when(again, "duplicate").when(~c.rlike("^[A-Z]{4}$"), "bad_icao").when(~F.upper(t).endswith(c), "bad_title").otherwise("ok")
    return df.withColumn("verdict", F.when(c != "", verdict))


def quality_report(df: DataFrame, by: list[str], code: str, title: str, order: str, samples: int = 5) -> DataFrame:
    """sanitized() counted by group, with the first few samples of each fault and the share of bad titles among rows with a code."""
    v, n = F.col("verdict"), F.coalesce(F.col("verdict") != "duplicate", F.lit(True))
    bearing = F.count_if(v.isNotNull() & n)
    first = lambda kind: F.slice(F.transform(F.array_sort(F.collect_list(F.when((v == kind) & (F.col("_nth") <= samples), F.struct(order, title)))), lambda x: x[title]), 1, samples)
    nth = F.row_number().over(Window.partitionBy(*by, "verdict").orderBy(order))
    return sanitized(df, code, title, order).withColumn("_nth", nth).groupBy(*by).agg(
        F.count_if(n).alias("kept"), bearing.alias("icao_bearing"), F.count_if(v == "duplicate").alias("dropped_duplicates"), first("duplicate").alias("duplicate_samples"),
        F.count_if(v == "bad_icao").alias("bad_icao"), first("bad_icao").alias("bad_icao_samples"), F.count_if(v == "bad_title").alias("bad_title"), first("bad_title").alias("bad_title_samples"),
        F.coalesce(F.try_divide(F.count_if(v == "bad_title"), bearing), F.lit(0.0)).alias("bad_title_ratio"),
    )


def coverage_guard(now: DataFrame, last: DataFrame, by: list[str], drop: float = 0.3) -> DataFrame:
    """now, last(by, n, has): collapsed (none left where there were some), dropped (the share fell by more than drop) or ok."""
    j = now.join(last.select(*by, F.col("n").alias("last_n"), F.col("has").alias("last_has")), by, "left")
    before = F.coalesce(F.try_divide("last_has", "last_n"), F.lit(0.0))
    verdict = F.when((F.col("last_has") > 0) & (F.col("has") == 0), "collapsed").when((F.col("last_has") > 0) & (before > 0) & (F.try_divide("has", "n") < before * (1 - drop)), "dropped").otherwise("ok")
    return j.select(*by, "n", "has", "last_has", verdict.alias("verdict"))


def changed_details(old: DataFrame, new: DataFrame, key: str, snapshot_ok: bool, edition_changed: bool) -> DataFrame:
    """Keys to tell of: none if the snapshot failed, all new ones if the edition changed, else those added or removed."""
    if not snapshot_ok:
        return new.select(key, F.lit("").alias("change")).limit(0)
    return new.select(key, F.lit("edition").alias("change")) if edition_changed else symmetric_difference(old, new, key)


def facts_merge(stored: DataFrame, others: list[tuple[str, DataFrame]], over: DataFrame, key: str, scalars: list[str], arrays: list[str], own: list[str]) -> DataFrame:
    """Facts of a key from several sources in order of precedence.

    scalars: the first known value; arrays: the first that isn't empty; own: of the stored row only. Columns that `over` knows win over
    all. `source` names the sources that have a row (the stored row's own source first), keys of which nothing is known drop out.
    """
    sources = [("", stored), *others]
    tagged = []
    for i, (name, df) in enumerate(sources):
        has = [F.col(c) if c in df.columns else F.lit(None).cast(stored.schema[c].dataType) for c in [*scalars, *arrays, *own]]
        named = F.col("source") if name == "" else F.lit(name)
        tagged.append(df.select(key, F.lit(i).alias("_i"), named.alias("_n"), *[h.alias(c) for h, c in zip(has, [*scalars, *arrays, *own], strict=True)]))
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    first = lambda c, ok: F.min_by(c, F.when(ok, F.col("_i")))
    merged = rows.groupBy(key).agg(
        *[first(c, F.col(c).isNotNull()).alias(c) for c in scalars], *[first(c, F.size(c) > 0).alias(c) for c in arrays], *[first(c, F.col("_i") == 0).alias(c) for c in own],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_n"))), lambda x: F.nullif(x["_n"], F.lit(""))), "+").alias("source"),
    )
    known = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in [*scalars, *arrays, *own]])
    wins = [c for c in over.columns if c != key]
    return override(merged, over, key, wins).filter(known)


def union_by_key(groups: list[DataFrame], key: str, identity: list[str], seq: str, items: str, name: str, most: int = 50) -> DataFrame:
    """Lists merged by key: identity of the first group's first row, items of all in order, each name once, at most `most`; rows without key are left out."""
    rows = reduce(lambda a, b: a.unionByName(b), [g.withColumn("_g", F.lit(i)) for i, g in enumerate(groups)]).filter(F.coalesce(F.col(key), F.lit("")) != "")
    each = rows.select(key, F.struct("_g", seq).alias("_at"), F.posexplode(items).alias("_p", "_x"))
    w = Window.partitionBy(key, F.col("_x")[name]).orderBy("_at", "_p")
    once = each.withColumn("_r", F.row_number().over(w)).filter("_r = 1").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_at", "_p"))).filter(F.col("_n") <= most)
    lists = once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_x"))), lambda x: x["_x"]).alias(items))
    first = rows.groupBy(key).agg(*[F.min_by(c, F.struct("_g", seq)).alias(c) for c in identity])
    return first.join(lists, key, "left")


def named(df: DataFrame, names: list[DataFrame], key: str, name: str) -> DataFrame:
    """Names joined on from several lists(key, name, seq); the first list that knows one counts, in it the first row."""
    rows = reduce(lambda a, b: a.unionByName(b), [n.filter(F.col(name).isNotNull()).select(key, F.col(name).alias("_name"), F.struct(F.lit(i), F.col("seq")).alias("_o")) for i, n in enumerate(names)])
    return df.join(rows.groupBy(key).agg(F.min_by("_name", "_o").alias(name)), key, "left")


def coverage_of(required: DataFrame, lists: DataFrame, code: str, label: str) -> DataFrame:
    """(label, code) of required codes that a list doesn't have: pairs of the two small sides without those that are there."""
    wanted = lists.select(label).distinct().crossJoin(F.broadcast(required.select(code).distinct()))
    return wanted.join(lists.select(label, code).distinct(), [label, code], "left_anti")


def dated_or_first(df: DataFrame, by: list[str], when: str, seq: str, value: str, today: Column) -> DataFrame:
    """The latest dated value up to today, else the earliest dated one, else the first undated one."""
    past = F.max_by(value, F.when(F.col(when) <= today, F.struct(when, -F.col(seq))))
    soon = F.min_by(value, F.when(F.col(when).isNotNull(), F.struct(when, seq)))
    return df.groupBy(*by).agg(F.coalesce(past, soon, F.min_by(value, F.when(F.col(when).isNull(), F.col(seq)))).alias(value))


def page_of_links(df: DataFrame, by: list[str], seq: str, skip: int) -> DataFrame:
    """Rows without the first `skip` of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(seq))).filter(F.col("_r") > skip).drop("_r")

#: Kinds of facilities.
KINDS = ("vfr", "ifr", "heliport", "mil", "aeroport")


def valid_search(term: str, country: str | None = None, kind: str | None = None) -> bool:
    """Whether a search may run: 1 to 50 characters, a country of two, a known kind."""
    return 1 <= len(term) <= 50 and (country is None or len(country) == 2) and (kind is None or kind in KINDS)
