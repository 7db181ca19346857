"""Quality rules with adaptive thresholds.

Two passes. The first measures every document and builds, for each language and source and for each measure, a
mergeable quantile sketch: values fall into bins whose width grows with the value (relative error
`SKETCH_ERROR`), and a sketch is the count of each bin. Merging sketches adds counts, so Spark's partial aggregation
merges them on the map side, the result doesn't depend on the order of merges, and a sketch has at most a few hundred bins
whatever it has seen. The second pass joins each document with the thresholds of its language and source.

A threshold is the third quartile plus `REACH` times the distance between quartiles (at least the measure's own
`least` spread, for measures that are constant in clean text). A group's sketch is shrunk towards its language's: the shares of the
language's bins are added with the weight of `SHRINK` documents, and the language's sketch is shrunk towards that of all documents in
the same way. A group of n documents thus counts n / (n + SHRINK), without a size at which the rule changes.

Defined cases: null texts have no words and fail the base rule; null language or source are groups of their own; texts of any
length are measured whole; repeated rows are measured each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import LOWER, bounded_broadcast, fresh, mix, shingles, span_hashes, text_groups, words
from fieldloom.session import materialise

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
CONTINUED = (np.arange(256) & 0xC0) == 0x80
UPPER = LOWER != np.arange(256)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bang")

SKETCH_ERROR = 0.02
REACH = 4.0
SHRINK = 200
GROUPS_BROADCAST = 200_000
#: measure -> (numerator, denominator, least spread between quartiles)
MEASURES = {
    "symbols_per_word": ("n_symbols", "n_words", 0.02),
    "dup_lines_per_word": ("n_dup_lines", "n_words", 0.01),
    "repeated_words": ("n_repeat_words", "n_words", 0.1),
    "upper_share": ("n_upper", "word_chars", 0.03),
    "bangs_per_word": ("n_bang", "n_words", 0.02),
    "word_length": ("word_chars", "n_words", 0.5),
}


def _duplicates(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each entry: -1 if its (doc, hash) occurs once, else 0 for the first and 1 for later ones."""
    with np.errstate(over="ignore"):
        key = h ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.full(len(h), -1, np.int8)
    later = order[1:][same]
    out[order[:-1][same]] = 0
    out[later] = 1
    return out


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of the column, over whole texts."""
    out = {c: np.zeros(len(column), np.int64) for c in COUNTS}
    for g in text_groups(column):
        at = slice(g.first, g.first + g.n)
        w = words(g)
        out["n_words"][at] = np.bincount(w.doc, minlength=g.n)

        def per_doc(flags: np.ndarray, g=g) -> np.ndarray:
            sums = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=sums[1:])
            return sums[g.bounds[1:]] - sums[g.bounds[:-1]]

        ink = np.zeros(len(g.data) + 1, np.int8)
        ink[w.start] += 1
        ink[w.end] -= 1  # a word that begins where another ends leaves 0: both stay inside
        ink = np.cumsum(ink[:-1], dtype=np.int8).astype(bool) if len(g.data) else ink[:0].astype(bool)
        out["word_chars"][at] = per_doc(ink & ~CONTINUED[g.data])
        out["n_symbols"][at] = per_doc(SYMBOLS[g.data])
        out["n_upper"][at] = per_doc(UPPER[g.data])
        out["n_bang"][at] = per_doc(g.data == 33)
        # lines: cut at \n and at the ends of texts
        cut = np.flatnonzero(g.data == 10)
        start = np.concatenate([g.bounds[:-1], cut + 1])
        end = np.concatenate([cut, g.bounds[1:]])
        doc_of = np.concatenate([np.arange(g.n), np.searchsorted(g.bounds, cut, "right") - 1])
        # starts sorted by text and place; ends alike
        order = np.lexsort((start, doc_of))
        start, line_doc = start[order], doc_of[order]
        ends_doc = np.concatenate([np.searchsorted(g.bounds, cut, "right") - 1, np.arange(g.n)])
        end = end[np.lexsort((end, ends_doc))]
        has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        start, end, line_doc = start[has_word], end[has_word], line_doc[has_word]
        dup = _duplicates(line_doc, span_hashes(g.data, start, end)) == 1
        out["n_dup_lines"][at] = np.bincount(line_doc[dup], minlength=g.n)
        # 3-word windows that occur again in their text cover their words
        grams, gram_doc = shingles(w, 3)
        if len(grams):
            inside = np.flatnonzero(w.doc[2:] == w.doc[:-2])
            again = inside[_duplicates(gram_doc, grams) >= 0]
            covered = np.zeros(len(w.hash), bool)
            for i in range(3):
                covered[again + i] = True
            out["n_repeat_words"][at] = np.bincount(w.doc[covered], minlength=g.n)
    return out


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and COUNTS of every document; the counts' names yield to clashing ones in keep.

    `text` may name a field of a struct in keep (row.text), so that a text goes to the workers once.
    """
    names = [fresh(c, keep) for c in COUNTS]
    holder, _, part = text.partition(".")
    base = docs.select(*keep) if part else docs.select(*keep, F.col(text).alias(fresh("_text", keep)))
    n = len(keep)
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:n]], *[f"`{c}` bigint" for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = measure(b.column(holder).field(part) if part else b.column(n))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *[pa.array(counts[c]) for c in COUNTS]], [*b.schema.names[:n], *names])

    return base.mapInArrow(run, ddl)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _value(name: str) -> Column:
    top, below, _ = MEASURES[name]
    return F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(0.0)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): the sketches of documents that pass the base rule."""
    width = math.log1p(SKETCH_ERROR)
    # bin 0 holds values below 0.001, the others grow by SKETCH_ERROR
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.greatest(F.lit(0), F.ceil(F.log(F.greatest(_value(m), F.lit(1e-9)) / 0.001) / width)).cast("int").alias("bin")) for m in MEASURES])
    return counted.filter(~base_failed()).select("lang", "source", F.inline(each)).groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def _bin_value(b: Column) -> Column:
    return F.when(b <= 0, 0.0).otherwise(0.001 * F.pow(F.lit(1 + SKETCH_ERROR), b))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per language and source: the upper bound of each measure, from its shrunk sketch."""

    def shares(w: DataFrame, by: list[str]) -> DataFrame:
        return w.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(*by, "measure")))

    def shrunk(by: list[str], toward: DataFrame, on: list[str]) -> DataFrame:
        """Bin weights of groups: their own counts and those of SHRINK documents of the wider sketch (columns `on` and shares)."""
        own = sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").cast("double").alias("w"))
        groups = own.select(*by, "measure").distinct()
        wide = toward.select(*[F.col(c).alias(f"w_{c}") for c in on], F.col("measure").alias("w_measure"), "bin", (F.col("w") * SHRINK).alias("w"))
        fits = F.col("measure") == F.col("w_measure")
        for c in on:
            fits = fits & F.col(c).eqNullSafe(F.col(f"w_{c}"))
        prior = groups.join(wide, fits).select(*by, "measure", "bin", "w")
        return own.unionByName(prior).groupBy(*by, "measure", "bin").agg(F.sum("w").alias("w"))

    whole = shares(sketch.groupBy("measure", "bin").agg(F.sum("n").cast("double").alias("w")), [])
    lang = shares(shrunk(["lang"], whole, []), ["lang"])
    by = ["lang", "source"]
    merged = shrunk(by, lang, ["lang"])
    key = Window.partitionBy(*by, "measure")
    q = merged.withColumn("upto", F.sum("w").over(key.orderBy("bin"))).withColumn("all", F.sum("w").over(key))
    at = lambda p: F.min(F.when(F.col("upto") >= F.col("all") * (p - 1e-9), F.col("bin")))
    rows = q.groupBy(*by, "measure").agg(_bin_value(at(0.25)).alias("q1"), _bin_value(at(0.75)).alias("q3"))
    least = F.create_map(*[F.lit(x) for m, (_, _, s) in MEASURES.items() for x in (m, s)])
    rows = rows.withColumn("upper", F.col("q3") + F.greatest(F.col("q3") - F.col("q1"), F.element_at(least, F.col("measure"))) * REACH)
    rows = rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("measure", "upper"))).alias("upper"))
    return rows.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), "upper")


def _judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """counted with base_failed, broken (names of the broken rules) and kept."""
    limits = bounded_broadcast(materialise(limits, "quality-thresholds"), GROUPS_BROADCAST)
    on = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    j = counted.join(limits, on, "left")
    broken = F.filter(F.array(*[F.when(_value(m) > F.element_at("upper", m), F.lit(m)) for m in MEASURES]), lambda x: x.isNotNull())
    j = j.withColumn("base_failed", base_failed()).withColumn("broken", broken)
    return j.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("t_lang", "t_source", "upper")


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept, broken."""
    counted = materialise(measured(docs, ["doc_id", "lang", "source"]), "quality-counts")
    out = _judged(counted, thresholds(materialise(sketches(counted), "quality-sketches")))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", F.array_join("broken", ",").alias("broken"), "lang", "source")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that judge() keeps, with their own columns; texts aren't shuffled."""
    counted = materialise(measured(docs, ["lang", "source"]), "quality-counts")
    again = docs.select(F.struct(*docs.columns).alias("row"), "lang", "source")
    both = measured(again, ["row", "lang", "source"], "row.text")
    return _judged(both, thresholds(materialise(sketches(counted), "quality-sketches"))).filter("kept").select("row.*")
