"""Collocations against counts by plain loops, and against the query's SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from fieldloom.llm import phrases, registry

SCHEMA = "doc_id long, text string, lang string"


def by_hand(rows, least, first=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for m in range(1, 6):
                for i in range(len(ws) - m + 1):
                    f[lang][tuple(ws[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        c = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        hidden = {g[i : i + j] for g, a in c.items() for j in range(2, len(g)) for i in range(len(g) - j + 1) if 100 * a >= 100 * c[g[i : i + j]]}
        kept = []
        for g, a in c.items():
            if g not in hidden:
                score, _, left, r = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), left, r))
        out += [(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(kept)[:first])]
    return sorted(out)


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_small_texts(spark, seed):
    rnd = random.Random(seed)
    vocab = ["The", "the", "of", "a", "A", "é", "É", "x\x01y", "漢", "b-c", "\x0e", "z" * 50]
    seps = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", "?! "]
    rows = [("".join(rnd.choice(vocab) + rnd.choice(seps) for _ in range(rnd.choice([0, 1, 3, 30, 200]))), rnd.choice(["en", "de", None, "und"])) for _ in range(80)]
    rows += [(None, "en"), ("", None), (" \t\n", "fr")] + [("one text that is there many times", "en")] * 20 + [("of the " * 100_000 + "w" * 50_000, "en")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).selectExpr("*", "'clash' as CODE", "'clash' as n", "'clash' as digest").repartition(6)
    want = by_hand(rows, 5)
    assert {r[0] for r in want} == {"en", "de", "und"} and any(len(r[2].split()) == 5 for r in want)
    assert rows_of(phrases.collocations(df, least=5)) == want
    assert rows_of(phrases.collocations(df, least=5, first=3)) == [r for r in want if r[1] <= 3]
    if seed == 0:  # codes that collide are drawn anew
        assert rows_of(phrases.collocations(df, least=5, code_bits=9)) == want


def test_long_texts_are_cut_between_words(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"w{i % 7}, x{i}" for i in range(3000))
    [g] = phrases.text_groups(pa.array([text]))
    whole = phrases.tokens(g, np.array([5], np.uint64))
    monkeypatch.setattr(phrases, "_PIECE", 100)
    assert all(np.array_equal(a, b) for a, b in zip(whole, phrases.tokens(g, np.array([5], np.uint64)), strict=True))


def test_keys_that_share_a_digest():
    keys = np.array([[1, 2, 0], [3, 4, 0], [1, 2, 0], [3, 4, 5], [9, 9, 9]], np.uint64)
    out = phrases._frequent(np.array([7, 7, 7, 7, 8], np.uint64), keys, np.array([2, 1, 3, 9, 5]), 5).to_pydict()
    assert sorted(zip(out["codes"], out["n"], strict=True)) == [([1, 2], 5), ([3, 4, 5], 9), ([9, 9, 9], 5)]


def test_score_is_exact(spark):
    rnd = random.Random(4)
    rows = [(10**15 + rnd.randrange(10**15), 10**15 + rnd.randrange(8 * 10**15), 10**14 * rnd.randrange(15, 99) + 1, 10**15 + rnd.randrange(10**15)) for _ in range(200)]
    rows += [(100, 3, 300, 1), (100, 299, 100, 100), (2**40 + 1, 2**50 - 1, 2**41, 2**45 + 3)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select(phrases.score_of("a", "n", "l", "r")).collect()
    assert [g[0] for g in got] == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(registry.oracle_sql()["op12_phrases"]).fetchall()
    assert len(want) > 50
    assert rows_of(registry.op12_phrases(spark, sf)) == sorted(want)


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tasks_pass_on_rows_in_parts_and_batches_are_bounded(spark):
    """Nothing is lost between the parts, in order; equal keys are added up, those of one digest apart."""
    n = 3 * phrases._ROWS // 2
    keys = np.arange(2 * n, dtype=np.uint64).reshape(n, 2)
    parts = list(phrases._slices(phrases._rows(np.arange(n, dtype=np.uint64), keys, np.ones(n, np.int64))))
    assert [p.num_rows for p in parts] == [phrases._ROWS, n - phrases._ROWS]
    assert [k for p in parts for k in p["digest"].to_pylist()] == list(range(n))
    digest, own, count = phrases._combined(np.array([7, 3, 7, 7], np.uint64), np.array([[2, 1], [5, 5], [1, 9], [2, 1]], np.uint64), np.array([1, 2, 4, 8]))
    assert (digest.tolist(), own.tolist(), count.tolist()) == ([3, 7, 7], [[5, 5], [2, 1], [1, 9]], [2, 9, 4])
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    phrases.collocations(spark.createDataFrame([(1, "a b", "en")], SCHEMA), 1)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b") == str(phrases._CHUNK)
