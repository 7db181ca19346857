"""Fingerprints of documents from their improbable byte windows, and how alike two of them are.

1. Each window of `WINDOW` bytes has an entropy in `LEVELS` steps. A first pass counts levels over all windows of all texts; a level's
   precedence is its place by count, rarest first. Windows below `LEAST` (runs of a few bytes) can't be features.
2. Every run of `RUN` windows gives a vote to its leftmost window of the rarest level (runs are clipped at the text's ends); windows with
   `VOTES` votes are features. Both steps look at some bytes around a window only, so texts that share a passage share its features.
   A text with fewer than `FEW` of them (short, or nothing but runs and periods) has its distinct windows of `SHORT` bytes as well.
3. Features enter Bloom filters of `BITS` bits in order of place, `PROBES` bits each; after `FULL` features the next filter begins.
   A fingerprint is `count:base64` of each filter, comma-joined.
4. Two filters agree by the bits they share beyond those that chance gives, over the most they could share beyond chance
   (`CHANCE` of that range counts as noise). Likeness is the mean over the filters of the fingerprint with fewer features, by count, of
   the best agreement with a filter of the other. Equal fingerprints have likeness 1.

Entropies are sums of a table of integers, so they are exact and equal texts have equal fingerprints wherever they lie in a batch.

`edited_fingerprints` pairs each document with the next one in order of id: texts are range-partitioned once and stream by in order;
only the first and last document of each partition are set aside and paired afterwards.

Defined cases: null texts are empty; a text shorter than `SHORT` bytes has itself as its only feature, the empty text none; null ids come first; rows of equal id are ordered by a hash of their text, so the order of rows that tie
doesn't matter; a document that is alone follows itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import span_hashes, text_groups
from fieldloom.session import materialise

WINDOW = 32
RUN = 64
VOTES = 16
LEVELS = 1000
LEAST = 100
BITS = 2048
PROBES = 5
FULL = 160
CHANCE = 0.1
FEW = 8
SHORT = 8
_SHIFTS = np.arange(PROBES, dtype=np.uint64) * np.uint64(BITS.bit_length() - 1)  # each probe takes its own bits of the hash
_PIECE = 1 << 17  # arrays of a piece stay in a core's cache
_BLOCK = 1 << 14
_STEP = np.zeros(WINDOW + 1, np.int32)  # what a byte value's c-th occurrence adds to the sum of c log2 c, in 2**-20
_STEP[1:] = np.diff(np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * (1 << 20)).astype(np.int32))
_FULL_SUM = WINDOW * np.log2(WINDOW) * (1 << 20)


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of the window at each place of data."""
    n = len(data) - WINDOW + 1
    out = np.zeros(max(n, 0), np.int16)
    for at in range(0, len(out), _BLOCK):
        out[at : at + _BLOCK] = _levels(data[at : at + _BLOCK + WINDOW - 1])
    return out


def _levels(data: np.ndarray) -> np.ndarray:
    n = len(data) - WINDOW + 1
    ahead, behind, same = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8), np.empty(len(data), bool)
    for lag in range(1, WINDOW):
        s = np.equal(data[:-lag], data[lag:], out=same[: len(data) - lag]).view(np.uint8)
        np.add(ahead[: len(data) - lag], s, out=ahead[: len(data) - lag])
        np.add(behind[lag:], s, out=behind[lag:])
    sums = np.empty(n, np.int32)
    sums[0] = _STEP[behind[:WINDOW]].sum()  # nothing stands before the first window, so these are its own counts
    np.subtract(_STEP[behind[WINDOW:]], _STEP[ahead[: n - 1]], out=sums[1:])
    np.cumsum(sums, out=sums)
    return ((_FULL_SUM - sums) * (LEVELS / _FULL_SUM) + 1e-6).astype(np.int16)


def pieces(data: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, lo, hi): windows from..to are judged with those of lo..hi around them; long texts are judged in overlapping pieces."""
    n = len(data) - WINDOW + 1
    for at in range(0, max(n, 0), _PIECE):
        to = min(n, at + _PIECE)
        yield at, to, max(0, at - 2 * RUN), min(n, to + 2 * RUN)


def level_counts(column: pa.Array) -> np.ndarray:
    counts = np.zeros(LEVELS + 1, np.int64)
    for g in text_groups(column, _PIECE):
        for data, bounds in [(g.data, g.bounds)] if len(g.data) <= 2 * _PIECE else [(g.data[a : b + WINDOW - 1], None) for a, b, _, _ in pieces(g.data)]:
            lv = levels(data)
            counts += np.bincount(lv if bounds is None else lv[_inside(bounds, len(data))], minlength=LEVELS + 1)
    return counts


def _inside(bounds: np.ndarray, size: int) -> np.ndarray:
    """Windows that no text's end cuts."""
    cut = np.zeros(size + 1, np.int32)
    np.add.at(cut, np.maximum(bounds[1:] - WINDOW + 1, bounds[:-1]), 1)
    np.add.at(cut, bounds[1:], -1)
    return (np.cumsum(cut[:-1]) == 0)[: max(0, size - WINDOW + 1)]


def precedence(counts: dict[int, int]) -> np.ndarray:
    """Rank of each level, rarest first; levels never seen are the rarest; those below LEAST are last and no features."""
    order = sorted(range(LEAST, LEVELS + 1), key=lambda v: (counts.get(v, 0), v))
    rank = np.full(LEVELS + 1, LEVELS + 1, np.int32)
    rank[order] = np.arange(len(order))
    return rank


def _elected(rank: np.ndarray) -> np.ndarray:
    """Places with enough votes among ranks; ranks above LEVELS are no candidates."""
    low = np.full(len(rank) + 2 * (RUN - 1), LEVELS + 1, np.int32)
    low[RUN - 1 : len(rank) + RUN - 1] = rank
    low = (low << 20) | np.arange(len(low), dtype=np.int32)  # ranks take 10 bits, places of a piece and its gaps 20
    width = 1
    while width < RUN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    first = np.flatnonzero(low[1:] != low[:-1]) + 1
    first = np.concatenate([[0], first])
    votes = np.diff(first, append=len(low))
    chosen = low[first[votes >= VOTES]]
    return (chosen[(chosen >> 20) <= LEVELS] & 0xFFFFF).astype(np.int64) - (RUN - 1)


def _elected_apart(ranks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places with enough votes, with no run reaching from one text into another: each text's windows stand RUN places apart."""
    length = np.maximum(np.diff(bounds) - WINDOW + 1, 0)
    some = np.flatnonzero(length)
    if not len(some):
        return np.zeros(0, np.int64)
    length, start = length[some], bounds[some]
    apart = np.concatenate([[0], np.cumsum(length[:-1] + RUN)])
    inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    spread = np.full(apart[-1] + length[-1], LEVELS + 1, np.int32)
    spread[inner + np.repeat(apart, length)] = ranks[inner + np.repeat(start, length)]
    at = _elected(spread)
    text = np.searchsorted(apart, at, "right") - 1
    return at - apart[text] + start[text]


def features(data: np.ndarray, bounds: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Hashes of the features of each text of data, in order of place."""
    if len(data) <= 2 * _PIECE:
        at = _elected_apart(rank[levels(data)], bounds)
        hashes = span_hashes(data, at, at + WINDOW) if len(at) else np.zeros(0, np.uint64)
    else:  # one long text
        parts = []
        for a, b, lo, hi in pieces(data):
            here = data[lo : hi + WINDOW - 1]
            at = _elected(rank[levels(here)])
            at = at[(at >= a - lo) & (at < b - lo)]
            parts.append((at + lo, span_hashes(here, at, at + WINDOW)))
        at, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    cut = np.searchsorted(at, bounds)
    out = []
    for i in range(len(bounds) - 1):
        own = hashes[cut[i] : cut[i + 1]]
        out.append(own if len(own) >= FEW else np.concatenate([own, _short(data[bounds[i] : bounds[i + 1]])]))
    return out


def _short(text: np.ndarray) -> np.ndarray:
    """The distinct windows of SHORT bytes (the whole text, if it's shorter) in order of place."""
    start = np.arange(max(len(text) - SHORT + 1, min(len(text), 1)))
    parts = []
    for at in range(0, len(start), _PIECE):
        own = start[at : at + _PIECE]
        here = text[own[0] : own[-1] + SHORT]
        parts.append(span_hashes(here, own - own[0], np.minimum(own - own[0] + SHORT, len(here))))
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return hashes[np.sort(np.unique(hashes, return_index=True)[1])]


def filters(hashes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(count, bits) of chained Bloom filters."""
    places = (hashes[:, None] >> _SHIFTS & np.uint64(BITS - 1)).astype(np.int64)
    out = []
    for i in range(0, len(hashes), FULL):
        bits = np.zeros(BITS, np.uint8)
        bits[places[i : i + FULL].ravel()] = 1
        out.append((min(FULL, len(hashes) - i), bits))
    return out


def written(chain: list[tuple[int, np.ndarray]]) -> str:
    return ",".join(f"{n}:{base64.b64encode(np.packbits(bits).tobytes()).decode()}" for n, bits in chain)


def read(fingerprint: str) -> list[tuple[int, np.ndarray]]:
    parts = [p.split(":") for p in fingerprint.split(",") if p]
    return [(int(n), np.unpackbits(np.frombuffer(base64.b64decode(b), np.uint8))) for n, b in parts]


def _set_share(n: np.ndarray) -> np.ndarray:
    """Share of bits that n features leave unset."""
    return (1 - 1 / BITS) ** (PROBES * n)


def likeness(a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]]) -> float:
    """0 to 1; 1 for equal fingerprints, 0 if just one is empty."""
    if len(a) == len(b) and all(m == n and np.array_equal(x, y) for (m, x), (n, y) in zip(a, b, strict=True)):
        return 1.0
    if not a or not b:
        return 0.0
    total_a, total_b = sum(n for n, _ in a), sum(n for n, _ in b)
    if (total_b, len(b)) < (total_a, len(a)):
        a, b = b, a
    nb = np.array([n for n, _ in b])
    bits_b = np.stack([x for _, x in b]).astype(np.float32)
    got = 0.0
    for at in range(0, len(a), 256):  # long chains meet in blocks
        na = np.array([n for n, _ in a[at : at + 256]])
        bits_a = np.stack([x for _, x in a[at : at + 256]]).astype(np.float32)
        shared = bits_a @ bits_b.T
        most = np.minimum(bits_a.sum(1)[:, None], bits_b.sum(1)[None, :])
        chance = BITS * (1 - _set_share(na)[:, None] - _set_share(nb)[None, :] + _set_share(na[:, None] + nb[None, :]))
        least = chance + CHANCE * (most - chance)
        agreed = np.clip((shared - least) / np.maximum(most - least, 1e-9), 0, 1)
        got += float((agreed.max(1) * na).sum())
    return min(1.0, got / sum(n for n, _ in a))


def _texts(column: pa.Array, rank: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
    out = []
    for g in text_groups(column, _PIECE):
        out += [filters(h) for h in features(g.data, g.bounds, rank)]
    return out


def entropy_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Precedence of levels from all windows of all texts; what reaches the driver is a count for each level."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for b in batches:
            total += level_counts(b.column(0))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"level": pa.array(seen, pa.int64()), "n": pa.array(total[seen])})

    rows = docs.select(text).mapInArrow(counted, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n"))
    return precedence({r.level: r.n for r in rows.collect()})


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every document."""
    rank = entropy_ranks(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([written(c) for c in _texts(b.column(1), rank)], pa.string())], [key, "fingerprint"])

    kept = docs.select(key, text)
    return kept.mapInArrow(run, f"`{key}` {kept.schema[0].dataType.simpleString()}, fingerprint string")


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ASIDE = "part bigint, doc_id bigint, text string, is_first boolean, is_last boolean"


def _paired(ids: list, texts: list[str], following: list[str], rank: np.ndarray, chains: list, following_chains: list) -> dict[str, list]:
    edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following, strict=True)]
    own = _texts(pa.array(edited, pa.large_string()), rank)
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
        "fingerprint": [written(c) for c in chains],
        "edited_fingerprint": [written(c) for c in own],
        "near_edited": [likeness(a, b) for a, b in zip(chains, own, strict=True)],
        "near_next": [likeness(a, b) for a, b in zip(chains, following_chains, strict=True)],
    }


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of the text whose last quarter is the start of the next document's, and how alike they are."""
    rank = entropy_ranks(docs)
    ddl = f"{RESULT}, {ASIDE.replace('doc_id', 'aside_id')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True
        for b in batches:
            at = 0
            while at < b.num_rows:  # some texts at a time
                some = min(b.num_rows - at, 256)
                ids, texts = b.column("doc_id").slice(at, some).to_pylist(), b.column("text").slice(at, some).to_pylist()
                chains = _texts(pa.array(texts, pa.large_string()), rank)
                at += some
                if first:
                    yield aside(part, ids[0], texts[0], True, False)
                    first = False
                if held is not None:
                    ids, texts, chains = [held[0], *ids], [held[1], *texts], [held[2], *chains]
                held = ids[-1], texts[-1], chains[-1]
                if len(ids) > 1:
                    yield result(_paired(ids[:-1], texts[:-1], texts[1:], rank, chains[:-1], chains[1:]))
        if held is not None:
            yield aside(part, held[0], held[1], False, True)

    names = [c.split()[0] for c in ddl.split(", ")]
    types = [{"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]] for c in ddl.split(", ")]

    def filled(values: dict[str, list]) -> pa.RecordBatch:
        n = len(next(iter(values.values())))
        return pa.RecordBatch.from_arrays([pa.array(values.get(c, [None] * n), t) for c, t in zip(names, types, strict=True)], names)

    def result(values: dict[str, list]) -> pa.RecordBatch:
        return filled(values)

    def aside(part: int, doc_id: int | None, text: str, is_first: bool, is_last: bool) -> pa.RecordBatch:
        return filled({"part": [part], "aside_id": [doc_id], "text": [text], "is_first": [is_first], "is_last": [is_last]})

    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("copy"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("copy")]
    both = materialise(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, ddl), "fingerprints")
    inner = both.filter("part is null").select(*names[:7])

    # the last document of each partition and the first of the next
    ends = both.filter("part is not null").select("part", F.col("aside_id").alias("doc_id"), "text", "is_first")
    parts = sorted(r.part for r in ends.filter("is_first").select("part").collect())
    nexts = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part bigint, next_part bigint")
    firsts = ends.filter("is_first").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    pairs = ends.filter(~F.col("is_first")).join(nexts, "part").join(firsts, "next_part").select("doc_id", "text", "next_text")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, texts, following = (b.column(c).slice(i, 1).to_pylist() for c in ("doc_id", "text", "next_text"))
                chains = _texts(pa.array(texts + following, pa.large_string()), rank)
                values = _paired(ids, texts, following, rank, chains[:1], chains[1:])
                yield pa.RecordBatch.from_arrays([pa.array(values[c], t) for c, t in zip(names[:7], types[:7], strict=True)], names[:7])

    return inner.unionByName(pairs.mapInArrow(edges, RESULT))
