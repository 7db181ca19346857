"""The trie against one built by hand, conversation by conversation."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from fieldloom.llm import convtrie, registry

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(hashlib.sha256(role.encode()).hexdigest().encode() + text.encode()).digest()
            own[c].append(((turn is not None, turn or 0), role, tie, text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        kids = children[node]
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        own_saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own_saved + sum(saved[k] for k in kids)
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if len(whole[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(kids), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def test_whole_table(spark, sf):
    conversations = spark.read.parquet(f"{sf}/conversations.parquet")
    want = by_hand([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()])
    out = registry.op11_trie(spark, sf)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert rows_of(out) == want
    assert any(r[3] > 1 and r[1] for r in want)


@pytest.mark.parametrize("seed", range(3))
def test_edge_rows(spark, seed, monkeypatch):
    """Small blocks, so that chains, sums and lists of members run over several of them; ties, repeats, nulls, clashing columns."""
    monkeypatch.setattr(convtrie, "BLOCK", 4)
    monkeypatch.setattr(convtrie, "DEPTHS", 5)
    monkeypatch.setattr(convtrie, "PIECE", 3)
    rnd = random.Random(seed)
    rows = [(None, 1, "user", "lost"), (3, None, "user", None), (3, None, None, "first"), (1, 1, "user", "x" * 100_000)]
    rows += [(7, 2, "user", "again")] * 5
    for c in rnd.sample(range(-12, 60), 40):
        kind = rnd.choice(["copy", "own", "long"])
        for t in range({"copy": 6, "own": rnd.randint(1, 4), "long": rnd.randint(20, 90)}[kind]):
            rows.append((c, t // 2 if kind == "own" else t, rnd.choice([None, "user"]) if kind == "own" else "user", {"copy": f"c{t}", "own": rnd.choice(["é", "", None, "b"]), "long": f"l{t // 30}"}[kind]))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as depth", "'clash' as OWNER", "'clash' as n").repartition(5)
    assert rows_of(convtrie.trie(df)) == by_hand(rows)


def test_snapshots_of_one_growing_conversation(spark):
    """Conversation k is the first k turns: each owns one node; the rows of paths stay within those of prefixes."""
    rows = [(5 * k, t, "user", f"t{t}") for k in range(1, 40) for t in range(k)]
    assert rows_of(convtrie.trie(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)


def test_empty(spark):
    assert convtrie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
