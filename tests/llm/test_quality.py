import re
from collections import Counter, defaultdict

import pytest

from fieldloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] >= 2:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def check_base(docs):
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        b = brute(r.text)
        want[(r.doc_id, *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    rows = quality.judge(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == want
    assert not any(r.kept and r.base_failed for r in rows)
    return rows


def test_counts_equal_brute_force(docs):
    rows = check_base(docs)
    assert any(r.kept for r in rows)


def test_edge_cases(edge):
    check_base(edge)


def test_empty_table(none):
    assert quality.judge(none).count() == 0
    assert quality.kept_documents(none).count() == 0


def test_thresholds_are_quantiles_of_their_group(docs):
    counted = quality.measured(docs, ["doc_id", "lang", "source"])
    limits = {(r.t_lang, r.t_source): r.upper for r in quality.thresholds(quality.sketches(counted)).collect()}
    values, langs, whole = defaultdict(list), defaultdict(list), []
    for r in counted.collect():
        if r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words:
            continue
        for m, (top, below, _) in quality.MEASURES.items():
            v = r[top] / r[below] if r[below] else 0.0
            values[(r.lang, r.source), m].append(v)
            langs[r.lang, m].append(v)
            whole.append((m, v))
    assert limits
    for (lang, source), upper in limits.items():
        for m, (_, _, least) in quality.MEASURES.items():
            mine, tongue, every = values[(lang, source), m], langs[lang, m], [v for k, v in whole if k == m]
            # each value with its weight: own ones count 1, SHRINK documents are spread over the language, which is shrunk likewise
            k = quality.SHRINK
            weights = sorted([(v, 1.0) for v in mine] + [(v, k / (len(tongue) + k)) for v in tongue] + [(v, k / (len(tongue) + k) * k / len(every)) for v in every])
            total, q1, q3, sofar = sum(w for _, w in weights), None, None, 0.0
            for v, w in weights:
                sofar += w
                q1 = v if q1 is None and sofar >= total * 0.25 - 1e-6 else q1
                q3 = v if q3 is None and sofar >= total * 0.75 - 1e-6 else q3
            want = q3 + max(q3 - q1, least) * quality.REACH
            # a bin's value is off by up to SKETCH_ERROR, and the reach multiplies what both quartiles are off
            assert upper[m] == pytest.approx(want, abs=0.002 + quality.SKETCH_ERROR * (q3 + quality.REACH * (q3 + q1)))


def test_merged_sketches_are_the_sketch_of_all(docs):
    counted = quality.measured(docs, ["doc_id", "lang", "source"])
    whole = {tuple(r) for r in quality.sketches(counted).collect()}
    parts = quality.sketches(counted.filter("doc_id % 3 = 0")).unionByName(quality.sketches(counted.filter("doc_id % 3 <> 0")))
    merged = parts.groupBy("lang", "source", "measure", "bin").sum("n")
    assert {tuple(r) for r in merged.collect()} == whole


def test_an_outlier_of_its_group_goes_and_kept_documents_keep_their_columns(spark):
    clean = [(i, " ".join(f"word{(i * 7 + j) % 997} plain" for j in range(60)), "en", "web", 0) for i in range(300)]
    loud = [(1000, " ".join(f"WORD{j} !!! ### $$$" for j in range(60)), "en", "web", 0)]
    docs = spark.createDataFrame(clean + loud, "doc_id long, text string, lang string, source string, n_chars long")
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(300))


def test_verdicts_equal_brute_force(docs):
    """Each document's verdict from the thresholds that the test above holds against plain quantiles."""
    counted = quality.measured(docs, ["doc_id", "lang", "source"])
    limits = {(r.t_lang, r.t_source): r.upper for r in quality.thresholds(quality.sketches(counted)).collect()}
    want = {}
    for r in counted.collect():
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        broken = [m for m, (top, below, _) in quality.MEASURES.items() if limits.get((r.lang, r.source)) and (r[top] / r[below] if r[below] else 0.0) > limits[r.lang, r.source][m]]
        want[r.doc_id] = (failed, not failed and not broken)
    assert {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(docs).collect()} == want
    assert len(set(want.values())) > 1


def test_one_document_more_moves_no_threshold_far(spark):
    """No size at which a group's rule changes: a threshold moves by less than a tenth when a group grows by one."""
    from pyspark.sql import functions as F

    rows = [("en", s, "symbols_per_word", 50 + i % 9, 1) for s in ("a", "b") for i in range(400)] + [("en", "c", "symbols_per_word", 150 + i % 9, 1) for i in range(202)]
    uppers = []
    for n in (199, 200, 201):
        sketch = spark.createDataFrame(rows[: 800 + n], "lang string, source string, measure string, bin int, n long").groupBy("lang", "source", "measure", "bin").agg(F.sum("n").alias("n"))
        uppers.append(quality.thresholds(sketch).filter("t_source = 'c'").first().upper["symbols_per_word"])
    assert max(uppers) <= 1.1 * min(uppers)
