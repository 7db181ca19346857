import random
from collections import Counter

import pytest

from fieldloom.llm import neardup
from fieldloom.llm.components import components


def shingles(text):
    w = text.split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def similarity(a, b):
    """The plain dynamic programme."""
    a, b = shingles(a), shingles(b)
    common = (Counter(a) & Counter(b)).total()
    if not common or common / (len(a) + len(b) - common) < 0.8:
        return 0.0  # the order can only take from what the bags share
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def brute(rows):
    """doc_id -> smallest doc_id of its class, over all pairs of texts."""
    known = [(k, t) for k, t in rows if t is not None]
    boss = {k: k for k, _ in rows}

    def top(k):
        while boss[k] != k:
            k = boss[k]
        return k

    for i, (k, t) in enumerate(known):
        for m, u in known[:i]:
            if t == u or similarity(t, u) >= 0.8:
                a, b = sorted((top(k), top(m)))
                boss[b] = a
    return {k: top(k) for k, _ in rows}


def edited(words, edits, rnd, vocabulary):
    w = list(words)
    for _ in range(edits):
        at, what = rnd.randrange(len(w)), rnd.random()
        if what < 0.6:
            w[at] = rnd.choice(vocabulary)
        elif what < 0.8:
            w.insert(at, rnd.choice(vocabulary))
        else:
            del w[at]
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for group in range(3):  # groups of near copies, from light to heavy edits, so that many don't link to the middle
        words = [rnd.choice(vocabulary) for _ in range((120, 60, 200)[group])]
        few = rnd.sample(vocabulary, 6)  # edits repeat: members share them
        texts += [edited(words, rnd.randrange(0, 9), rnd, few) for _ in range(45)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(80)) + " " + passage for _ in range(15)]
    texts += [texts[3], texts[3], "a b c", "a b c", "a b  c", "a b d", "", "", "  ", "x"]
    rows = list(enumerate(texts)) + [(900, None), (901, None)]
    rnd.shuffle(rows)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert max(Counter(got.values()).values()) > 10


def test_edge_cases(spark, edge, none):
    rows = neardup.classes(edge).collect()
    assert len(rows) == edge.count()
    by = {(r.doc_id, r.class_id, r.copy_of) for r in rows}
    assert {(7, 7, 7), (8, 7, 7), (None, 7, 7), (1, 1, 1), (None, None, None)} <= by
    kept = neardup.one_of_each(edge)
    assert kept.columns == edge.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[7] == 1 and ids[8] == 0 and ids[None] == 2 and ids[1] == ids[9] == ids[10] == 1
    assert neardup.classes(none).count() == 0 and neardup.one_of_each(none).count() == 0


def test_one_of_each_class_stays(spark, docs):
    told = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert {r.doc_id for r in neardup.one_of_each(docs).collect()} == set(told.values())


def test_alignment_equals_the_plain_programme(spark):
    rnd = random.Random(5)
    words = [str(rnd.randrange(30)) for _ in range(80)]
    import numpy as np

    def hashed(t):
        return np.array([hash(s) & ((1 << 64) - 1) for s in shingles(t)], np.uint64)

    for edits in (0, 1, 2, 3, 5):
        for _ in range(10):
            a, b = " ".join(words), edited(words, edits, rnd, ["x", "y", "1", "2"])
            want = similarity(a, b)
            got = neardup.aligned(hashed(a), hashed(b))[1]
            assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (201, 202), (202, 201), (201, 202)]
    got = {r.node: r["class"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {201: 201, 202: 201}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_take_only_the_texts_that_they_compare(spark, monkeypatch):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    words, few = [rnd.choice(vocabulary) for _ in range(120)], rnd.sample(vocabulary, 6)
    rows = list(enumerate(edited(words, rnd.randrange(0, 9), rnd, few) for _ in range(45)))
    calls = []

    def told(pairs, seqs, compared=neardup.compared):
        ids = {x for r in pairs.select("a", "b").collect() for x in r}
        calls.append((ids, [r.id for r in seqs.select("id").collect()]))
        return compared(pairs, seqs)

    monkeypatch.setattr(neardup, "compared", told)
    neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert len(calls) > 1
    for ids, sent in calls:
        assert sorted(sent) == sorted(ids)
