"""Prefix trie of conversations by chained digests.

1. Turns get their place in their conversation from global prefix sums over a range partitioning (equal turns of a conversation
   are counted first), so a conversation of any length is never one group. Texts are replaced by SHA-256 digests before they are shuffled.
2. Prefix digests are chained in blocks of `BLOCK` turns: inside a block each digest covers the one before and the turn; the digests of
   whole blocks are chained in the same way, as often as lengths ask for, and a prefix covers the chain before its block. A digest
   depends on the turns of its prefix alone, and each group is one block.
3. Every prefix is a row; rows of the same (depth, digest) are a node. Its owner is the smallest conversation in it. Members of a deeper
   node are among those of its parent, so a conversation owns a contiguous range of its own prefixes: a chain.
4. Each chain (not each of its nodes, which would take rows that grow with the square of a conversation's length) is exploded to all
   chains above it, with the depth at which the path leaves them. Along a chain what came in is summed from its end, in blocks of depths.
   There are never more such rows than prefixes, as every chain above adds at least one turn to the path.
5. Member lists of ends are cut in pieces of `PIECE` ids by their global rank; a node's pieces are hashed as they stream by in order.

Defined cases: rows without conv_id belong to no conversation and are left out; null role or text is empty; null turns come first; turns
that tie are ordered by role, then by the digest of role and text, and equal rows are turns of their own; negative ids take their sign
along (% truncates); an empty table has no node, not even a root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.sharding import prefix_sums
from fieldloom.session import materialise

BLOCK = 64
DEPTHS = 1024
PIECE = 4096
ROOT = hashlib.sha256(b"").digest()


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, turn_digest, n_bytes), pos from 1, and (conv_id, n, start): lengths and where conversations start in global order."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", role.alias("role"), _sha(F.sha2(role, 256).cast("binary"), text.cast("binary")).alias("turn_digest"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    copies = turns.groupBy("conv_id", "turn", "role", "turn_digest", "n_bytes").agg(F.count(F.lit(1)).alias("copies"))
    rows = prefix_sums(copies, ["conv_id", "turn", "role", "turn_digest"], "copies", "turns")[0]
    convs = materialise(rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.min("row_start").alias("start")), "conversations")
    first = F.col("row_start") - F.col("start")
    kept = ["conv_id", "turn_digest", "n_bytes"]
    out = rows.join(convs, "conv_id").select(*kept, first.alias("first"), (first + F.col("copies")).alias("last"))
    out = out.select(*kept, F.explode(F.sequence("first", F.col("last") - 1, F.lit(PIECE).cast("long"))).alias("first"), "last")  # no array is longer than a piece
    return out.select(*kept, F.explode(F.sequence(F.col("first") + 1, F.least("last", F.col("first") + PIECE))).alias("pos")), convs


def rebuilt_turns(conversations: DataFrame, span: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, turn_digest, n_bytes) and (conv_id, length).

    Conversation c begins with the first h turns of conversation c - c % span, and goes on with its own after its first h;
    h is crc32(c) modulo heads.
    """
    turns, convs = placed_turns(conversations)
    turns = materialise(turns, "placed")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    own = convs.select("conv_id", "n", head, (F.col("conv_id") - F.col("conv_id") % span).alias("base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")
    plan = own.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").select("conv_id", "base", "h", taken, "n")
    plan = materialise(plan, "rebuild")
    first = turns.filter((F.col("conv_id") % span == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    shared = first.join(plan, "base").filter("pos <= h").select("conv_id", F.col("pos").alias("depth"), "turn_digest", "n_bytes")
    rest = turns.join(plan, "conv_id").filter("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "turn_digest", "n_bytes")
    return shared.unionByName(rest), plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def chained(items: DataFrame, longest: int) -> DataFrame:
    """items (conv_id, depth from 1, x, n_bytes) with x replaced by `digest`, that of all x up to depth."""
    block = F.floor((F.col("depth") - 1) / BLOCK).cast("long")
    inside = items.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("depth", "x", "n_bytes"))).alias("xs"))
    steps = F.aggregate("xs", F.array(F.lit(ROOT)), lambda ys, e: F.concat(ys, F.array(_sha(F.element_at(ys, -1), e["x"]))))
    inside = inside.select("conv_id", "block", "xs", F.slice(steps, 2, BLOCK).alias("ys"))
    digest = F.col("e.ys")
    if longest > BLOCK:
        inside = materialise(inside, "blocks")
        ends = inside.select("conv_id", (F.col("block") + 1).alias("depth"), F.element_at("ys", -1).alias("x"), F.lit(0).cast("long").alias("n_bytes"))
        before = chained(ends, -(-longest // BLOCK)).select("conv_id", F.col("depth").alias("block"), F.col("digest").alias("before"))
        inside = inside.join(before, ["conv_id", "block"], "left")
        digest = F.when(F.col("before").isNull(), digest).otherwise(_sha(F.col("before"), digest))
    else:
        inside = inside.withColumn("before", F.lit(None).cast("binary"))
    rows = inside.select("conv_id", "before", F.explode(F.arrays_zip("xs", "ys")).alias("e"))
    return rows.select("conv_id", F.col("e.xs.depth").alias("depth"), digest.alias("digest"), F.col("e.xs.n_bytes").alias("n_bytes"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order."""
    node, state, done = None, None, []
    for b in batches:
        for owner, depth, text in zip(b.column("owner").to_pylist(), b.column("depth").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if (owner, depth) != node:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (owner, depth), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if len(done) >= 4096:
            yield _hashed(done)
            done = []
    if node:
        done.append((*node, state.hexdigest()))
    yield _hashed(done)


def _hashed(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("owner", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())))}
    )


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of ends (owner, depth, conv_id): ids ascending, comma-joined."""
    ranked = prefix_sums(ends.withColumn("one", F.lit(1).cast("long")), ["owner", "depth", "conv_id"], "one", "ends")[0]
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids")
    pieces = ranked.groupBy("owner", "depth", F.floor(F.col("row_index") / PIECE).alias("piece")).agg(ids)
    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "piece").mapInArrow(_streamed, "owner bigint, depth bigint, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt_turns(conversations)
    convs = materialise(convs, "lengths")
    total, root, longest = convs.agg(F.count(F.lit(1)), F.min("conv_id"), F.max("length")).first()
    prefixes = materialise(chained(turns.withColumnRenamed("turn_digest", "x"), longest or 0), "prefixes")
    nodes = materialise(
        prefixes.groupBy("depth", "digest").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner"), F.max("n_bytes").alias("n_bytes")), "nodes"
    )
    # where each conversation's path leaves each owner's chain
    at_root = convs.select("conv_id", F.lit(root).cast("long").alias("owner"), F.lit(0).cast("long").alias("depth"))
    on_path = prefixes.join(nodes.select("depth", "digest", "owner"), ["depth", "digest"]).select("conv_id", "owner", "depth").unionByName(at_root)
    paths = materialise(on_path.groupBy("conv_id", "owner").agg(F.max("depth").alias("depth")), "paths")
    above = F.col("owner") != F.col("conv_id")
    last = F.max(F.when(above, F.struct("depth", "owner")))
    chains = paths.groupBy("conv_id").agg(last["owner"].alias("parent"), last["depth"].alias("at"), F.max(F.when(~above, F.col("depth"))).alias("length"))
    chains = materialise(chains, "chains")
    owned = chains.filter("length is not null")

    children = materialise(
        owned.filter("parent is not null").groupBy(F.col("parent").alias("owner"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("branches")), "branches"
    )
    root_row = convs.agg(F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(root).cast("long").alias("owner"), F.lit(0).cast("long").alias("n_bytes")
    )
    saved = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")
    own = nodes.select("depth", "n_convs", "owner", "n_bytes").unionByName(root_row).select("owner", "depth", "n_convs", saved)
    own = own.join(owned.select(F.col("conv_id").alias("owner"), "parent", "at", "length"), "owner").join(children, ["owner", "depth"], "left")
    branches = F.coalesce("branches", F.lit(0))
    going_on = (F.col("depth") < F.col("length")).cast("long")
    parent = F.when(F.col("depth") - 1 == F.col("at"), F.col("parent")).when(F.col("depth") > 0, F.col("owner")).alias("parent_conv_id")
    own = own.select("owner", "depth", "n_convs", parent, "saved", (going_on + branches).alias("n_children"))
    own = materialise(own.withColumn("leaves", (F.col("n_children") == 0).cast("long")), "own")

    sums = own.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("saved").alias("saved_in"), F.sum("leaves").alias("leaves_in"))
    incoming = paths.filter(above).join(materialise(sums, "sums"), "conv_id").groupBy("owner", "depth").agg(F.sum("saved_in").alias("saved_in"), F.sum("leaves_in").alias("leaves_in"))
    valued = own.join(incoming, ["owner", "depth"], "left").select(
        *[c for c in own.columns if c not in ("saved", "leaves")],
        (F.col("saved") + F.coalesce("saved_in", F.lit(0))).alias("saved"),
        (F.col("leaves") + F.coalesce("leaves_in", F.lit(0))).alias("leaves"),
        F.floor(F.col("depth") / DEPTHS).alias("stretch"),
    )
    valued = materialise(valued, "valued")
    below = Window.partitionBy("owner").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    stretches = valued.groupBy("owner", "stretch").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    after = stretches.select("owner", "stretch", F.coalesce(F.sum("s").over(below), F.lit(0)).alias("saved_after"), F.coalesce(F.sum("l").over(below), F.lit(0)).alias("leaves_after"))
    inside = Window.partitionBy("owner", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = valued.withColumns({"saved": F.sum("saved").over(inside), "leaves": F.sum("leaves").over(inside)}).join(after, ["owner", "stretch"])

    ends = chains.select(F.when(F.col("length").isNull(), F.col("parent")).otherwise(F.col("conv_id")).alias("owner"), F.coalesce("length", "at").alias("depth"), "conv_id")
    return summed.join(hashed_ends(ends), ["owner", "depth"], "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.col("leaves_after")).alias("n_leaves"),
        (F.col("saved") + F.col("saved_after")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"),
    )
