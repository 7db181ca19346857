"""Fingerprints: entropy levels and features against plain loops, whole results against texts paired by hand."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import fingerprints as fp
from fieldloom.llm import registry


def level(window: bytes) -> float:
    return -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values()) / math.log2(fp.WINDOW) * fp.LEVELS


def texts(seed, n=30):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeéü漢 \n", k=rnd.randint(2, 9))) for _ in range(300)]
    return [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 60, 400]))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_levels(seed):
    data = np.frombuffer("".join(texts(seed)).encode(), np.uint8)
    got = fp.levels(data)
    assert len(got) == len(data) - fp.WINDOW + 1
    for i in range(0, len(got), 7):
        want = level(data[i : i + fp.WINDOW].tobytes())
        assert abs(got[i] - want) <= 1 and got[i] <= want + 1e-3


def elected(text: bytes, rank) -> list[int]:
    """Votes by a plain loop over runs, clipped at the text's ends."""
    ranks = [int(rank[v]) for v in fp.levels(np.frombuffer(text, np.uint8))] if len(text) >= fp.WINDOW else []
    votes = Counter()
    for start in range(-fp.RUN + 1, len(ranks)):
        run = [(ranks[i], i) for i in range(max(start, 0), min(start + fp.RUN, len(ranks)))]
        if run and min(run)[0] <= fp.LEVELS:
            votes[min(run)[1]] += 1
    return sorted(i for i, n in votes.items() if n >= fp.VOTES)


@pytest.mark.parametrize("piece", [fp._PIECE, 512])
def test_features_of_a_batch_and_of_long_texts(monkeypatch, piece):
    monkeypatch.setattr(fp, "_PIECE", piece)
    column = pa.array([*texts(3), None, "", "x", "x" * 5000, "ab" * 3000])
    counts = fp.level_counts(column)
    whole = Counter(int(v) for t in column.to_pylist() if t for v in fp.levels(np.frombuffer(t.encode(), np.uint8)))
    assert {i: int(n) for i, n in enumerate(counts) if n} == dict(whole)
    rank = fp.precedence(dict(enumerate(counts.tolist())))
    got = [h for g in fp.text_groups(column, piece) for h in fp.features(g.data, g.bounds, rank)]
    seen = {}
    for text, hashes in zip(column.to_pylist(), got, strict=True):
        raw = (text or "").encode()
        at = elected(raw, rank)
        windows = [raw[i : i + fp.WINDOW] for i in at]
        if len(windows) < fp.FEW:
            windows += list(dict.fromkeys(raw[i : i + fp.SHORT] for i in range(max(len(raw) - fp.SHORT + 1, min(len(raw), 1)))))
        assert len(windows) == len(hashes)
        for w, h in zip(windows, hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_likeness():
    rnd = np.random.default_rng(1)
    a, b = (rnd.integers(0, 2**63, 1000, dtype=np.uint64) for _ in range(2))
    chain = fp.filters(a)
    assert [n for n, _ in chain] == [160] * 6 + [40]
    again = fp.read(fp.written(chain))
    assert all(m == n and np.array_equal(x, y) for (m, x), (n, y) in zip(chain, again, strict=True))
    assert fp.likeness(chain, again) == 1.0 == fp.likeness([], [])
    assert fp.likeness(chain, []) == 0.0
    assert fp.likeness(chain, fp.filters(b)) < 0.05
    assert 0.7 < fp.likeness(chain, fp.filters(np.concatenate([a[:800], b[:200]]))) < 0.85
    assert fp.likeness(chain, fp.filters(a[:320])) == pytest.approx(1.0)


def paired_by_hand(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, following))
    return out


def check(df, rows):
    want = paired_by_hand(rows)
    got = {(r.doc_id, r.n_chars): r for r in df.collect()}
    assert df.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    prints = {}
    for doc_id, n, sha, text, edited, _following in want:
        r = got[doc_id, n]
        assert r.edited_sha256 == sha
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
    for doc_id, n, _, text, edited, following in want:
        r = got[doc_id, n]
        assert r.near_edited == fp.likeness(fp.read(prints[text]), fp.read(prints[edited]))
        assert r.near_next == fp.likeness(fp.read(prints[text]), fp.read(prints[following]))
    return got


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = check(registry.op13_fingerprints(spark, sf), rows)
    assert len(out) == len(rows)
    alike = [r.near_edited for r in out.values() if r.n_chars >= 100]
    assert min(alike) > 0.4
    apart = sorted(r.near_next for r in out.values() if r.near_next < 1)
    assert apart[len(apart) * 9 // 10] < 0.1


def test_edge_rows(spark, edge):
    df = edge.filter("doc_id is null or doc_id <> 7").dropDuplicates(["doc_id"])
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    out = check(fp.edited_fingerprints(df.withColumn("FINGERPRINT", F.lit("clash")).repartition(4)), rows)
    assert out[2, 0].fingerprint == "" and out[2, 0].near_edited == 1.0
    everything = fp.edited_fingerprints(edge).collect()
    assert len(everything) == edge.count()
    same = {r.fingerprint for r in everything if r.n_chars == 31}
    assert len(same) == 1
    assert [r.fingerprint for r in fp.fingerprints(edge).filter("doc_id = 8").collect()] == list(same)


def test_one_document_and_none(spark, none):
    alone = spark.createDataFrame([(5, "abcdefgh" * 20)], "doc_id long, text string")
    [r] = fp.edited_fingerprints(alone).collect()
    assert (r.n_chars, r.near_next) == (160, 1.0)
    assert fp.edited_fingerprints(none).collect() == []
