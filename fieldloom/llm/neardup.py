"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence number. The similarity of two texts is
m / (n1 + n2 - m), m being the longest common subsequence of their shingle sequences: like Jaccard's, but sensitive to order. Pairs of 0.8
or more are links, and classes are the components of links.

1. Equal texts are one node, named by their smallest doc_id.
2. Order MinHash: each of `SKETCHES` hash functions picks the `PICKS` smallest labelled shingles of a text and keeps them in the order
   in which they stand there; equal picks in equal order collide. At similarity 0.8 two texts miss each other in
   all sketches with a probability of about 5e-6; texts that share a passage of a third of their length hardly ever collide.
   Texts of up to `SHORT` shingles also have `SHORT_SKETCHES` sketches of two picks.
3. In a bucket, everything is compared with a pivot: as many pairs as members. The pivot is the member with the most company in
   all its buckets, the middle of a group of near copies. Components of these links need no comparison inside. Members of a pivot in
   different components meet in new buckets if their differences from the pivot do where any link has to
   (see meetings()): texts that share but a passage never meet, near copies only if they share edits. These buckets, and those of members
   whose shingles stand in another order than the pivot's, get new pivots in rounds until each holds one class (see settled()).
4. A comparison first bounds the similarity by the shared multiset of shingles, then aligns within the band that
   0.8 leaves (bit-parallel over the band).

Texts are read twice and never broadcast; only those of candidates are shuffled.

Defined cases: null texts are in no class but their own; texts below five words are one shingle of all their words; texts
without words are equal only to the same text; repeated rows share their class, and so do rows that share a doc_id; rows without doc_id get the class of their text's
copies (null if there is none with an id); an empty table gives an empty result; further columns are ignored by classes() and kept by one_of_each().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import TextGroup, WordGroup, bounded_broadcast, mix, shingles, text_groups, words
from fieldloom.llm.components import components
from fieldloom.session import materialise

WORDS = 5
SIMILAR = 0.8
PICKS, SKETCHES = 6, 40
SHORT, SHORT_SKETCHES = 64, 16
#: Members of a bucket that are compared with all others in a round.
PIVOTS = 8
#: Shingles with more places in a text than this have one bit mask for all of them.
OFTEN = 64
IDS_BROADCAST = 1_000_000
_SEEDS = mix(np.arange(1, SKETCHES + SHORT_SKETCHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_FACTORS = mix(_SEEDS) | np.uint64(1)


def sequences(g: TextGroup, w: WordGroup) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the group's texts one after the other, and the bounds of each text's."""
    h, doc = shingles(w, WORDS)
    count = np.bincount(w.doc, minlength=g.n)
    few = np.flatnonzero((count > 0) & (count < WORDS))
    if len(few):
        at = np.searchsorted(w.doc, few)
        own = np.array([int(np.bitwise_xor.reduce(mix(w.hash[a : a + count[d]] + np.arange(count[d], dtype=np.uint64)))) for a, d in zip(at, few, strict=True)], np.uint64)
        h, doc = np.concatenate([h, own]), np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, np.searchsorted(doc, np.arange(g.n + 1))


def labelled(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashes with their occurrence number in the text mixed in."""
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    with np.errstate(over="ignore"):
        key = h ^ mix(doc + np.uint64(1))
        order = np.argsort(key, kind="stable")
        first = np.ones(len(h), bool)
        first[1:] = key[order][1:] != key[order][:-1]
        run = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        times = np.zeros(len(h), np.uint64)
        times[order] = (np.arange(len(h)) - run).astype(np.uint64)
        return np.where(times > 0, mix(h + times * np.uint64(0x9FB21C651E98DF25)), h)


def sketch(x: np.ndarray) -> np.ndarray:
    """Bucket values of one text (labelled shingles in text order)."""

    def picked(first: int, count: int, picks: int) -> list[np.ndarray]:
        out = []
        step = max(1, 2_000_000 // len(x))
        for j in range(first, first + count, step):
            s = slice(j, min(j + step, first + count))
            with np.errstate(over="ignore"):
                v = (x[None, :] ^ _SEEDS[s, None]) * _FACTORS[s, None]
            at = np.sort(np.argpartition(v, picks - 1, axis=1)[:, :picks], axis=1)
            out.append(_joined(x[at], np.arange(s.start, s.stop, dtype=np.uint64)))
        return out

    if not len(x):
        return np.zeros(0, np.uint64)
    parts = picked(0, SKETCHES, PICKS) if len(x) > PICKS else [_joined(x[None, :], np.array([1000], np.uint64))]
    if 2 < len(x) <= SHORT:
        parts += picked(SKETCHES, SHORT_SKETCHES, 2)
    return np.concatenate(parts)


def _joined(picks: np.ndarray, name: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(name + np.uint64(77))
        for i in range(picks.shape[1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + picks[:, i])
    return h


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> tuple[float, float]:
    """(shared, similar): the multiset similarity, and the aligned one if that reaches `least`, else 0."""
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0, 0.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    both, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum()) if len(both) else 0
    shared = common / (total - common)
    if shared < least:
        return shared, 0.0
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    # as many shingles may stay unmatched as the threshold leaves: the band
    band = int(total * (1 - least) / (1 + least)) + 1
    m = head + tail + _banded_lcs(a.tolist(), b.tolist(), band)
    return shared, m / (total - m)


def _banded_lcs(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence over matches no further than `band` from the diagonal, a bit for each place of a."""
    if not a or not b:
        return 0
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    masks: dict[int, int] = {}
    wide = (1 << (2 * band + 1)) - 1
    full = (1 << len(a)) - 1
    v = full
    for j, y in enumerate(b):
        places, match = where.get(y, ()), 0
        if len(places) <= OFTEN:
            for i in places:
                if -band <= i - j <= band:
                    match |= 1 << i
        else:
            if y not in masks:
                bits = np.zeros(len(a), np.uint8)
                bits[places] = 1
                masks[y] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            match = masks[y] & (wide << (j - band) if j >= band else wide >> (band - j))
        if match:
            u = v & match
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _digest() -> F.Column:  # ty: ignore
    return F.unhex(F.substring(F.sha2(F.col("text"), 256), 1, 32))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, digest (null for null texts), n (shingles), picks (bucket values)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, picks = [], []
            for g in text_groups(b["text"]):
                h, bounds = sequences(g, words(g))
                x = labelled(h, bounds)
                for i in range(g.n):
                    own = x[bounds[i] : bounds[i + 1]]
                    ns.append(len(own))
                    picks.append(sketch(own).view(np.int64))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["digest"], pa.array(ns, pa.int64()), pa.array(picks, pa.list_(pa.int64()))], ["doc_id", "digest", "n", "picks"])

    return base.mapInArrow(run, "doc_id bigint, digest binary, n bigint, picks array<bigint>")


def _sequences_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, seq) of the documents in ids: the shingle hashes as bytes."""
    base = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter(F.col("text").isNotNull())
    base = base.join(bounded_broadcast(ids, IDS_BROADCAST), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs: list[bytes] = []
            for g in text_groups(b["text"]):
                h, bounds = sequences(g, words(g))
                seqs += [h[bounds[i] : bounds[i + 1]].tobytes() for i in range(g.n)]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(seqs, pa.binary())], ["id", "seq"])

    return base.mapInArrow(run, "id bigint, seq binary").dropDuplicates(["id"])


def difference(z: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What x adds to its pivot z and what it lacks of it, as labelled shingles (lacks are hashed again, so both can stand in one list)."""
    bounds = [np.array([0, len(s)]) for s in (z, x)]
    z, x = labelled(z, bounds[0]), labelled(x, bounds[1])
    with np.errstate(over="ignore"):
        return np.setdiff1d(x, z), mix(np.setdiff1d(z, x) + np.uint64(5))


def compared(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """pairs(a, b, many) with shared, similar and (if many) the difference of b from its pivot a and the size of a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared, similar, parts = [], [], []
            for x, y, many in zip(b["x"], b["y"], b["many"].to_pylist(), strict=True):
                z, own = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                got = aligned(z, own)
                shared.append(got[0])
                similar.append(got[1])
                parts.append((*(p.view(np.int64) for p in difference(z, own)), len(z)) if many else (None, None, None))
            lists = [pa.array([p[i] for p in parts], t) for i, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(shared, pa.float64()), pa.array(similar, pa.float64()), *lists], ["a", "b", "shared", "similar", "adds", "lacks", "pivot_n"])

    both = pairs.join(seqs.select(F.col("id").alias("b"), F.col("seq").alias("y")), "b").join(seqs.select(F.col("id").alias("a"), F.col("seq").alias("x")), "a")
    return both.select("a", "b", "x", "y", "many").mapInArrow(run, "a bigint, b bigint, shared double, similar double, adds array<bigint>, lacks array<bigint>, pivot_n bigint")


def _held(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """seqs of the pairs alone, so that the others aren't shuffled."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "dup-ids")
    return seqs.join(bounded_broadcast(ids, IDS_BROADCAST), "id", "left_semi")


def meetings(known: DataFrame) -> DataFrame:
    """(kind, a, item, id, left): members of a pivot z that share a difference from z where any link has to.

    Let a, l be how many shingles a member adds to z and lacks of it, n the size of z. Then x and y have
    n - |lacks of either| + |shared adds| shingles in common, and 0.8 asks for (|x| + |y|) / 2.25 of them. So they share
    (5 (lx + ly) + 4 (ax + ay) - n) / 9 adds and lacks at least, and (4 (ax - lx + ay - ly) - n) / 9 + max(lx, ly) adds.
    One of them doesn't link to z, which makes the first bound positive, and the second as well unless a member is loose (lacks
    more than it adds). Kind 0 are adds of members that aren't loose, kind 1 adds and lacks where one of both is.

    What no other class shares, nearly all of the items, ends at sums that are combined before the shuffle. The others stand in one order,
    rarest first. A member has at least `needed` of them in common with any member
    that it may link to (the bound, with the least that others of the pivot can have), so the first one that both share has as many from
    it on (`left`): members with fewer leave, and the others only keep the items up to there.
    """
    firm = ~F.col("loose")
    out = F.col("class") != F.col("pivot_class")
    grows, weight = F.col("n_adds") - F.col("n_lacks"), F.col("n_adds") * 4 + F.col("n_lacks") * 5
    least = known.groupBy("a").agg(
        F.max("loose").alias("any_loose"), F.min(F.when(firm, grows)).alias("g_all"), F.min(F.when(firm & out, grows)).alias("g_out"), F.min(F.when(firm & out, F.col("n_lacks"))).alias("l_out"), F.min(weight).alias("w_all")
    )
    k = known.join(bounded_broadcast(materialise(least, "dup-least"), IDS_BROADCAST), "a")
    inside = lambda x, y: F.when(out, x).otherwise(y)  # noqa: E731  members of the pivot's class only meet those of others
    others = F.greatest(inside(F.col("g_all"), F.col("g_out")), grows * 0.8 - F.col("pivot_n") * 0.2)
    adds_needed = ((grows + others) * 4 - F.col("pivot_n")) / 9 + inside(F.col("n_lacks"), F.greatest("n_lacks", "l_out"))
    all_needed = (weight + F.col("w_all") - F.col("pivot_n")) / 9

    def listed(rows: DataFrame, kind: int, items: F.Column, needed: F.Column) -> DataFrame:  # ty: ignore
        needed = F.greatest(F.lit(1), F.ceil(needed - 1e-6)).cast("int")
        return rows.select(F.lit(kind).alias("kind"), "a", "id", "class", "loose", needed.alias("needed"), items.alias("items")).filter(F.size("items") >= F.col("needed"))

    # members of the pivot's class have no one to meet if no other is firm
    rows = listed(k.filter(firm & F.col("g_out").isNotNull()), 0, F.col("adds"), adds_needed)
    rows = rows.unionByName(listed(k.filter("any_loose"), 1, F.concat("adds", "lacks"), all_needed))
    room = rows.groupBy("kind", "a").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("kind", "a")
    rows = rows.join(bounded_broadcast(materialise(room, "dup-room"), IDS_BROADCAST), ["kind", "a"])
    some = materialise(rows.select("kind", "a", "id", "class", "loose", "needed", F.explode("items").alias("item")), "dup-items")
    often = some.groupBy("kind", "a", "item").agg(F.count(F.lit(1)).alias("often"), F.min("class").alias("x"), F.max("class").alias("y"), F.max("loose").alias("some_loose"))
    often = often.filter("x <> y and (kind = 0 or some_loose)").drop("x", "y", "some_loose")
    left = F.row_number().over(Window.partitionBy("kind", "a", "id").orderBy(F.desc("often"), "item"))  # one member's items
    return some.join(often, ["kind", "a", "item"]).withColumn("left", left).filter("left >= needed").select("kind", "a", "item", "id", "left")


def settled(rows: DataFrame, seqs: DataFrame) -> DataFrame | None:
    """Links (a, b) between classes: rows(bucket, kind, id, class, n_adds, n_lacks, pivot_n, left, lead) are members of buckets.

    In a round, each bucket has up to `PIVOTS` leading members compared with all others of other classes that can link to them (see
    meetings()); so pairs are no more than PIVOTS times the members. These pivots are then through with everybody and leave. Classes that turn out
    to be one are merged before the next round; a bucket is left when it holds one class, or no more leaders.
    """
    found: DataFrame | None = None
    second = ("id", "class", "n_adds", "n_lacks", "left")
    grows = F.col("n_adds") - F.col("n_lacks") + F.col("n_adds2") - F.col("n_lacks2")
    adds_needed = (grows * 4 - F.col("pivot_n")) / 9 + F.greatest("n_lacks", "n_lacks2")
    all_needed = ((F.col("n_adds") + F.col("n_adds2")) * 4 + (F.col("n_lacks") + F.col("n_lacks2")) * 5 - F.col("pivot_n")) / 9
    needed = F.when(F.col("kind") == 0, adds_needed).when(F.col("kind") == 1, all_needed).otherwise(0)
    while True:
        several = rows.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.max("lead").alias("any_lead")).filter("x <> y and any_lead")
        rows = materialise(rows.join(several.select("bucket"), "bucket", "left_semi"), "dup-open")
        if rows.isEmpty():
            return found
        each = [F.min(F.when(F.pmod(F.xxhash64("id"), F.lit(PIVOTS)) == i, F.struct(*second))).alias(f"p{i}") for i in range(PIVOTS)]
        pivots = rows.filter("lead").groupBy("bucket").agg(*each).select("bucket", F.inline(F.array_compact(F.array(*[f"p{i}" for i in range(PIVOTS)]))))
        pivots = materialise(pivots.toDF("bucket", *[c + "2" for c in second]), "dup-pivots")
        used = pivots.select("bucket", F.col("id2").alias("id"), F.lit(True).alias("used"))
        met = rows.join(used, ["bucket", "id"], "left").join(pivots, "bucket").filter((F.col("class") != F.col("class2")) & (F.col("used").isNull() | (F.col("id") < F.col("id2"))))
        met = met.filter(F.least("left", "left2") >= needed - 1e-6)
        met = materialise(met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), F.least("class", "class2").alias("x"), F.greatest("class", "class2").alias("y")).distinct(), "dup-met")
        linked = compared(met.select("a", "b", F.lit(False).alias("many")), _held(met, seqs)).filter(F.col("similar") >= SIMILAR).select("a", "b")
        linked = materialise(met.join(linked, ["a", "b"], "left_semi").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "dup-links")
        rows = rows.join(used, ["bucket", "id"], "left_anti")
        if not linked.isEmpty():
            found = linked if found is None else found.unionByName(linked)
            now = components(linked).select(F.col("node").alias("class"), F.col("class").alias("now"))
            rows = rows.join(now, "class", "left").withColumn("class", F.coalesce("now", "class")).drop("now")
        rows = rows.select("bucket", "kind", "id", "class", "n_adds", "n_lacks", "pivot_n", "left", "lead")


def connected(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, class) of all nodes with links."""
    nodes = sketches.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    reps = sketches.join(nodes, ["digest", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), F.explode("picks").alias("key"))
    full = reps.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    members = materialise(reps.join(full, "key"), "dup-members")
    # the pivot of a bucket is the member with the most company in all buckets: the middle of a group of near copies
    company = members.groupBy("id").agg(F.sum("c").alias("company"))
    pivots = members.join(company, "id").groupBy("key").agg(F.max_by("id", F.struct("company", -F.col("id"))).alias("pivot"))
    seen = members.join(pivots, "key").filter("id <> pivot")
    first = materialise(seen.groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg((F.max("c") > 2).alias("many")), "dup-pairs")
    ids = first.select(F.col("a").alias("id")).unionByName(first.select(F.col("b").alias("id"))).distinct()
    seqs = materialise(_sequences_of(docs, ids), "dup-sequences")
    told = materialise(compared(first, seqs), "dup-first")
    stars = components(told.filter(F.col("similar") >= SIMILAR))
    # what the pivots leave open: members of one pivot that aren't connected yet
    own = stars.select(F.col("node").alias("a"), F.col("class").alias("pivot_class"))
    known = told.filter("adds is not null").join(stars, F.col("b") == F.col("node"), "left").join(own, "a", "left")
    turned = (F.col("shared") >= SIMILAR) & (F.col("similar") < SIMILAR)
    known = known.select(
        "a", F.col("b").alias("id"), F.coalesce("class", "b").alias("class"), F.coalesce("pivot_class", "a").alias("pivot_class"), "adds", "lacks", "pivot_n",
        F.size("adds").alias("n_adds"), F.size("lacks").alias("n_lacks"), turned.alias("turned"), (F.size("lacks") > F.size("adds")).alias("loose"),
    )
    apart = known.groupBy("a").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("a")
    known = materialise(known.join(apart, "a"), "dup-known")
    told_of = known.select("a", "id", "class", "n_adds", "n_lacks", "pivot_n", "loose", "turned")
    met = meetings(known.filter("not turned")).join(told_of, ["a", "id"])
    rows = met.select(F.xxhash64("kind", "a", "item").alias("bucket"), "kind", "id", "class", "n_adds", "n_lacks", "pivot_n", "left", ((F.col("kind") == 0) | F.col("loose")).alias("lead"))
    # members with the pivot's shingles in another order: their differences say nothing, but whom they may link to shares a bucket with them
    held = seen.select("key", F.col("pivot").alias("a"), "id").join(told_of, ["a", "id"])
    held = held.join(held.filter("turned").select("key").distinct(), "key", "left_semi")
    rows = rows.unionByName(held.select(F.xxhash64(F.lit(2), "key").alias("bucket"), F.lit(2).alias("kind"), "id", "class", "n_adds", "n_lacks", "pivot_n", F.lit(0).cast("long").alias("left"), F.col("turned").alias("lead")))
    more = settled(rows, seqs)
    edges = stars.select(F.col("node").alias("a"), F.col("class").alias("b"))
    return stars if more is None else components(more.unionByName(edges))


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), copy_of (smallest doc_id of its text)."""
    sketches = materialise(sketched(docs), "dup-sketches")
    linked = connected(docs, sketches)
    nodes = sketches.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("copy_of"))
    nodes = nodes.join(linked, nodes["copy_of"] == linked["node"], "left").select("digest", "copy_of", F.coalesce("class", "copy_of").alias("class_id"))
    rows = sketches.select("doc_id", "digest").join(nodes, "digest", "left")
    return rows.select("doc_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each class; rows without doc_id stay, repeated rows are one."""
    told = materialise(classes(docs), "dup-classes")
    drop = told.filter("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(bounded_broadcast(drop, IDS_BROADCAST), "doc_id", "left_anti").select(*docs.columns)
    repeated = materialise(told.filter("doc_id = class_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "dup-repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
