"""Phrases of words that stand together more often than their parts let expect, for each language.

1. Words have 64-bit codes, salted hashes of language and word, and the dictionary holds (code, language, f) of the words that are frequent enough
   to stand in a candidate. Beside each code's count stand the smallest and largest of another hash of its words: if they differ for
   a code that could matter, all codes are drawn anew with the next salt, so a code means one word (but for 2**-64 a pair of words that
   agree in both). Words are spelled at the end, for the phrases that are returned.
2. Pieces of texts are broken at words that are not in the dictionary. Neighbouring codes are packed into keys of fixed width, sorted and run-length
   counted in each task, range-partitioned by a digest of the key (ranges are equal parts of the digests' space, so no sample is needed),
   radix-sorted by it and run-length counted again. First only the digests of pairs, then those of triples are counted, so that keys of
   rare phrases are never shuffled; the last pass counts whole keys of 2 to `WORDS` words in which no word, pair or triple is rare.
   Tasks know frequent words, pairs and triples by bitmaps of `FILTER` bits, whatever the size of the input: a rare one that slips through
   only makes keys that are counted and dropped, so counts never depend on the bitmaps.
3. Phrases of at least `LEAST` occurrences are candidates. They are cut in every place; parts are looked up by shuffled joins,
   and products are decimals of 38 digits. Phrases inside longer ones are found by exploding the (at most nine) shorter ones inside each.

Defined cases: null texts are empty; null and `und` languages are one; white space between words is a blank or a tab, all other control
characters but line ends belong to words; repeated rows count each; ties are those of the contract; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import LOWER, TextGroup, bounded_broadcast, mix, span_hashes, text_groups
from fieldloom.session import bounded_batches, materialise

WORDS = 5
LEAST = 100
INSIDE = 100  # percent of a candidate's occurrences that a longer one has to reach
FIRST = 2000
FILTER = 1 << 26
RANGES = 4096
LANGS_BROADCAST = 100_000
SPLITS = 8
_PIECE = 1 << 20
_CHUNK = 4 * _PIECE  # bytes of text that are counted at once
_HELD = 1 << 20  # rows that a task holds back to combine them
_ROWS = 1 << 16  # rows of a batch that a task passes on
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True


def _cuts(data: np.ndarray) -> list[int]:
    """Bounds of pieces of about _PIECE bytes that cut no word."""
    cuts, at = [0], 0
    while at < len(data):
        to = min(len(data), at + _PIECE)
        while to < len(data) and not _GAP[data[to]]:
            more = np.flatnonzero(_GAP[data[to : to + _PIECE]])
            to = to + int(more[0]) if len(more) else min(len(data), to + _PIECE)
        cuts.append(to)
        at = to
    return cuts


def tokens(g: TextGroup, salts: np.ndarray, salt: int = 0, code_bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a group: codes (never 0), whether a new piece begins with the word, and byte bounds. salts: one for each text."""
    codes, fresh, starts, ends, breaks, values = [], [], [], [], 0, _bytes_of(salt)[LOWER]
    for a, b in zip(cuts := _cuts(g.data), cuts[1:], strict=False):
        data = g.data[a:b]
        bounds = g.bounds[(g.bounds >= a) & (g.bounds < b)] - a
        ink = np.zeros(len(data) + 2, bool)
        ink[1:-1] = ~_GAP[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        start = np.flatnonzero(ink[1:-1] & (~ink[:-2] | edge[:-1]))
        end = np.flatnonzero(ink[1:-1] & (~ink[2:] | edge[1:])) + 1
        doc = np.searchsorted(g.bounds, start + a, "right") - 1
        place = np.cumsum(_BREAK[data])[start] + breaks + doc
        breaks += int(_BREAK[data].sum())
        code = mix(span_hashes(values[data], start, end) ^ salts[doc]) >> np.uint64(64 - code_bits)
        code[code == 0] = 1
        codes.append(code)
        fresh.append(place)
        starts.append(start + a)
        ends.append(end + a)
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.concatenate(fresh)
    return np.concatenate(codes), np.concatenate([[True], place[1:] != place[:-1]])[: len(place)], np.concatenate(starts), np.concatenate(ends)


def _salted(codes: pa.Array, salt: int) -> np.ndarray:
    """What language and salt add to the hashes of a text's words."""
    return mix(codes.to_numpy().view(np.uint64) + np.uint64(salt))


def _bytes_of(salt: int) -> np.ndarray:
    """A permutation of byte values, another one for each salt."""
    return np.random.default_rng(salt).permutation(256).astype(np.uint8)


def _sorted_runs(order: np.ndarray, differs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run in sorted order, and lengths of runs."""
    first = np.flatnonzero(np.concatenate([[True], differs])) if len(order) else np.zeros(0, np.int64)
    return order[first], np.diff(first, append=len(order))


def code_counts(docs: DataFrame, salt: int, code_bits: int = 64) -> DataFrame:
    """(code, lang_code, n, low, high): occurrences of each code, the smallest and largest other hash of its words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, salts = b.column("lang_code").to_numpy(), _salted(b.column("lang_code"), salt)
            for g in text_groups(b.column("text"), _CHUNK):
                code, _, start, end = tokens(g, salts[g.first : g.first + g.n], salt, code_bits)
                text = g.first + np.searchsorted(g.bounds, start, "right") - 1
                other = _other(g.data, start, end, salt) ^ salts[text]
                order = np.argsort(code, kind="stable")
                code, text, other = code[order], text[order], other[order]
                at, n = _sorted_runs(np.arange(len(code)), (code[1:] != code[:-1]) | (other[1:] != other[:-1]))
                yield from _slices(
                    pa.RecordBatch.from_arrays(
                        [pa.array(code[at].view(np.int64)), pa.array(langs[text[at]]), pa.array(n, pa.int64()), pa.array(other[at].view(np.int64))], ["code", "lang_code", "n", "other"]
                    )
                )

    rows = docs.mapInArrow(counted, "code bigint, lang_code bigint, n bigint, other bigint")
    return rows.groupBy("code").agg(F.min("lang_code").alias("lang_code"), F.sum("n").alias("n"), F.min("other").alias("low"), F.max("other").alias("high"))


def _other(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of words that have nothing to do with their codes."""
    values, cuts = _bytes_of(salt + (1 << 32))[LOWER], _cuts(data)
    first = np.searchsorted(start, cuts)
    parts = [span_hashes(values[data[a:b]], start[i:j] - a, end[i:j] - a) for a, b, i, j in zip(cuts, cuts[1:], first, first[1:], strict=False)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def spellings(docs: DataFrame, salt: int, words: Broadcast, code_bits: int = 64) -> DataFrame:
    """(code, word) of the words whose codes are known."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for b in batches:
            salts = _salted(b.column("lang_code"), salt)
            for g in text_groups(b.column("text"), _CHUNK):
                code, _, start, end = tokens(g, salts[g.first : g.first + g.n], salt, code_bits)
                some = np.flatnonzero(_known(words.value, code))
                code, at = np.unique(code[some], return_index=True)
                at = some[at][fresh := ~np.isin(code, seen)]
                raw = LOWER[g.data].tobytes()
                seen = np.union1d(seen, code)[-_HELD:]  # a word may be told twice
                found = [raw[s:e].decode() for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(code[fresh].view(np.int64)), pa.array(found, pa.string())], ["code", "word"])

    return _larger(docs).mapInArrow(spelled, "code bigint, word string").distinct()


def bitmap(spark: SparkSession, digests: DataFrame) -> Broadcast:
    """FILTER bits, set at the digests (column `digest`): at most FILTER / 64 rows of 64 bits reach the driver."""
    place = F.pmod("digest", F.lit(FILTER))
    parts = digests.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(digest, {FILTER}) & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(FILTER // 64, np.int64)
    words[parts["at"].to_numpy()] = parts["bits"].to_numpy()
    return spark.sparkContext.broadcast(np.packbits(np.unpackbits(words.view(np.uint8), bitorder="little"), bitorder="little"))


def _known(bits: np.ndarray, digest: np.ndarray) -> np.ndarray:
    place = digest & np.uint64(FILTER - 1)  # FILTER is a power of two, so this is the non-negative remainder
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def digest_of(keys: np.ndarray) -> np.ndarray:
    """One 64-bit digest for each row of codes."""
    with np.errstate(over="ignore"):
        h = np.full(len(keys), 0x9E3779B97F4A7C15, np.uint64)
        for i in range(keys.shape[1]):
            h = mix(h + keys[:, i]) * np.uint64(0xA24BAED4963EE407 | 1)
    return mix(h)


def _binary(keys: np.ndarray) -> pa.Array:
    keys = np.ascontiguousarray(keys)
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * np.int32(keys.shape[1] * 8)
    return pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(keys)])


def _windows(code: np.ndarray, begins: np.ndarray, filters: list[Broadcast], longest: int) -> Iterator[np.ndarray]:
    """Rows of n codes for n = 2 to longest: windows inside pieces with no word, pair or triple that a filter doesn't know."""
    known = _known(filters[0].value, code)
    good = known[:-1] & known[1:] & ~begins[1:]
    for n in range(2, longest + 1):
        at = np.flatnonzero(good)
        keys = np.stack([code[at + i] for i in range(n)], 1)
        if n <= len(filters):
            keep = _known(filters[n - 1].value, digest_of(keys))
            at, keys = at[keep], keys[keep]
        yield keys
        whole = np.zeros(len(good), bool)
        whole[at] = True
        good = whole[:-1] & whole[1:]


def _larger(docs: DataFrame) -> DataFrame:
    """Tasks of several splits, where each task tells what is frequent once however much it reads: fewer tasks, fewer rows to shuffle."""
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // SPLITS))


def _in_order(rows: DataFrame) -> DataFrame:
    """Range-partitioned by digest and radix-sorted by it."""
    return rows.withColumn("range", F.shiftrightunsigned("digest", 64 - (RANGES - 1).bit_length())).repartition("range").sortWithinPartitions("digest").drop("range")


def frequent_digests(docs: DataFrame, salt: int, filters: list[Broadcast], least: int, code_bits: int = 64) -> DataFrame:
    """(digest) of phrases one word longer than the last filter's that may occur least times: keys that share a digest are counted as one."""
    n = len(filters) + 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            salts = _salted(b.column("lang_code"), salt)
            for g in text_groups(b.column("text"), _CHUNK):
                code, begins, _, _ = tokens(g, salts[g.first : g.first + g.n], salt, code_bits)
                *_, keys = _windows(code, begins, filters, n)
                digest = np.sort(digest_of(keys).view(np.int64))
                at, count = _sorted_runs(digest, digest[1:] != digest[:-1])
                yield from _slices(pa.RecordBatch.from_arrays([pa.array(at), pa.array(count.astype(np.int32))], ["digest", "n"]))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            digest, count = (np.concatenate(x) for x in zip(held, (b.column("digest").to_numpy(), b.column("n").to_numpy()), strict=True))
            first, _ = _sorted_runs(np.arange(len(digest)), digest[1:] != digest[:-1])
            digest, count = digest[first], np.add.reduceat(count, first) if len(first) else count
            held = digest[-1:], count[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(digest[:-1][count[:-1] >= least])], ["digest"])
        yield pa.RecordBatch.from_arrays([pa.array(held[0][held[1] >= least])], ["digest"])

    return _in_order(docs.mapInArrow(packed, "digest bigint, n int")).mapInArrow(summed, "digest bigint")


def phrase_counts(docs: DataFrame, salt: int, filters: list[Broadcast], longest: int, least: int, code_bits: int = 64) -> DataFrame:
    """(codes, n) of the phrases of 2 to longest words that occur least times."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            salts = _salted(b.column("lang_code"), salt)
            for g in text_groups(b.column("text"), _CHUNK // 2):
                code, begins, _, _ = tokens(g, salts[g.first : g.first + g.n], salt, code_bits)
                for keys in _windows(code, begins, filters, longest):
                    wide = np.zeros((len(keys), longest), np.uint64)
                    wide[:, : keys.shape[1]] = keys
                    held.append(_combined(digest_of(wide), wide, np.ones(len(wide), np.int64)))
                    rows += len(held[-1][0])
                if rows > _HELD:
                    held = [_combined(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    rows = len(held[0][0])
                    if rows > _HELD // 2:
                        yield from _slices(_rows(*held[0]))
                        held, rows = [], 0
        if held:
            yield from _slices(_rows(*_combined(*(np.concatenate(x) for x in zip(*held, strict=True)))))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64), np.zeros((0, longest), np.uint64), np.zeros(0, np.int64)
        for b in batches:
            column = b.column("key")
            keys = np.frombuffer(column.buffers()[2] or b"", np.uint64, len(column) * longest, _first_byte(column)).reshape(-1, longest)
            digest, keys, n = (np.concatenate(x) for x in zip(held, (b.column("digest").to_numpy().view(np.uint64), keys, b.column("n").to_numpy()), strict=True))
            last = int(np.flatnonzero(digest != digest[-1])[-1]) + 1 if len(digest) and digest[0] != digest[-1] else 0
            held = digest[last:], keys[last:], n[last:]
            yield _frequent(digest[:last], keys[:last], n[:last], least)
        yield _frequent(*held, least)

    return _in_order(_larger(docs).mapInArrow(packed, "digest bigint, key binary, n bigint")).mapInArrow(summed, "codes array<bigint>, n bigint")


def _rows(digest: np.ndarray, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), _binary(keys), pa.array(n)], ["digest", "key", "n"])


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts: the JVM holds one of them at a time."""
    for i in range(0, b.num_rows, _ROWS):
        yield b.slice(i, _ROWS)


def _first_byte(column: pa.Array) -> int:
    return int(np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0]) if len(column) else 0


def _combined(digest: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of equal keys. Rows are put in order of digest; keys that share one are put in order as well."""
    if not len(digest):
        return digest, keys, n
    order = np.argsort(digest, kind="stable")
    digest, keys, n = digest[order], keys[order], n[order]
    differs = (keys[1:] != keys[:-1]).any(1)
    if ((digest[1:] == digest[:-1]) & differs).any():
        order = np.lexsort((*keys.T, digest))
        digest, keys, n = digest[order], keys[order], n[order]
        differs = (keys[1:] != keys[:-1]).any(1)
    first = np.flatnonzero(np.concatenate([[True], differs]))
    return digest[first], keys[first], np.add.reduceat(n, first)


def _frequent(digest: np.ndarray, keys: np.ndarray, n: np.ndarray, least: int) -> pa.RecordBatch:
    _, keys, n = _combined(digest, keys, n)
    keys, n = keys[n >= least], n[n >= least]
    size = (keys != 0).sum(1)
    flat = keys[np.arange(keys.shape[1]) < size[:, None]].view(np.int64)
    codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
    return pa.RecordBatch.from_arrays([codes, pa.array(n, pa.int64())], ["codes", "n"])


def score_of(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (left right)) of four columns; counts may have 16 digits, products 36."""
    over = f"1000 * cast({a} as decimal(16,0)) * cast({n} as decimal(16,0))"
    return F.expr(f"({over}) div (cast({left} as decimal(16,0)) * cast({right} as decimal(16,0)))").cast("long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = WORDS, first: int = FIRST, code_bits: int = 64) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    salt = 0
    while True:
        docs = known.withColumn("lang_code", F.xxhash64(F.lit(salt), "lang"))
        langs = materialise(docs.select("lang", "lang_code").distinct(), "langs")
        codes = materialise(code_counts(docs, salt, code_bits), "codes")
        shared = langs.groupBy("lang_code").count().filter(F.col("count") > 1).select("lang_code")
        if not codes.filter((F.col("low") != F.col("high")) & (F.col("n") >= least)).select("lang_code").unionByName(shared).limit(1).count():
            break
        salt += 1
    dictionary = codes.filter(F.col("n") >= least)
    filters = [bitmap(spark, dictionary.select(F.col("code").alias("digest")))]
    totals = codes.groupBy("lang_code").agg(F.sum("n").alias("total"))
    for _ in range(2):
        filters.append(bitmap(spark, frequent_digests(docs, salt, filters, least, code_bits)))
    candidates = materialise(phrase_counts(docs, salt, filters, longest, least, code_bits).withColumnRenamed("n", "a"), "candidates")

    parts = candidates.select("codes", F.col("a").alias("f")).unionByName(dictionary.select(F.array("code").alias("codes"), F.col("n").alias("f")))
    parts = materialise(parts, "parts")
    lang_of = dictionary.select(F.col("code").alias("head"), "lang_code").join(bounded_broadcast(totals, LANGS_BROADCAST), "lang_code")
    lang_of = lang_of.join(bounded_broadcast(langs, LANGS_BROADCAST), "lang_code").drop("lang_code")
    size = F.size("codes")
    counted = materialise(candidates.withColumn("head", F.element_at("codes", 1)).join(lang_of, "head").drop("head"), "counted")
    cut = counted.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "*", F.slice("codes", F.lit(1), F.col("k")).alias("left"), F.slice("codes", F.col("k") + 1, size - F.col("k")).alias("right")
    )
    cut = cut.join(parts.select(F.col("codes").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("codes").alias("right"), F.col("f").alias("r")), "right")
    cut = cut.select("codes", "lang", "a", F.col("total").alias("n"), F.struct(score_of("a", "total", "l", "r").alias("score"), "k", "l", "r").alias("cut"))
    scored = cut.groupBy("codes", "lang", "a", "n").agg(F.min("cut").alias("cut"))

    whole = counted.filter(size > 2).select("codes", "a")
    inner = whole.select("codes", F.col("a").alias("f"), F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = inner.select("f", "codes", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("i")).select(F.slice("codes", F.col("i"), F.col("m")).alias("codes"), "f")
    inside = inner.groupBy("codes").agg(F.max("f").alias("f"))
    free = scored.join(inside, "codes", "left").filter((F.col("f").isNull()) | (100 * F.col("f") < INSIDE * F.col("a")))

    flat = free.select("codes", "lang", "a", "cut.l", "cut.r", "n", "cut.score")
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = materialise(flat.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= first).drop("place"), "first")
    parts_of = near.select("codes", F.posexplode("codes").alias("i", "code"))
    spelled = parts_of.join(spellings(docs, salt, bitmap(spark, parts_of.select(F.col("code").alias("digest"))), code_bits), "code")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase")
    told = near.join(spelled.groupBy("codes").agg(phrase), "codes")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))).cast("long")
    return told.withColumn("rank", rank).filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

