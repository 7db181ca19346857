"""The pipeline's stages, each against what it says of its own input, on a small fixture."""

import re
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from fieldloom.llm import neardup, pieces, quality, secrets
from fieldloom.session import BATCH_BYTES, materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark):
    sf = "/root/testdata/sf0.01"
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], sf), name.replace(" ", "-")))
    return out


def rows(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_all_but_the_last_return_documents(steps):
    for df in steps[:-1]:
        assert df.columns == list(corpus_pipeline.COLUMNS)


def test_quality_keeps_what_it_judges_kept(steps):
    kept = {r.doc_id for r in quality.judge(steps[0]).filter("kept").collect()}
    assert rows(steps[1]) == Counter({k: n for k, n in rows(steps[0]).items() if k[0] in kept})
    assert 0 < sum(rows(steps[1]).values()) < steps[0].count()


def test_dedup_keeps_one_of_each_class(steps):
    told = {r.class_id for r in neardup.classes(steps[1]).collect()}
    assert rows(steps[2]) == Counter({k: n for k, n in rows(steps[1]).items() if k[0] in told})


def test_secrets_are_gone(steps):
    want = Counter((k, secrets.redact(t), a, b, len(secrets.redact(t))) for k, t, a, b, _ in rows(steps[2]).elements())
    assert rows(steps[3]) == want


def test_mix_takes_whole_texts_or_runs_of_words(steps):
    texts = {k[0]: k[1] for k in rows(steps[3])}
    words = Counter()
    for (k, t, _, source, n), times in rows(steps[4]).items():
        assert t.strip() in texts[k] and n == len(t)
        words[source] += len(WORD.findall(t)) * times
    all_words = sum(len(WORD.findall(t)) for t in texts.values())
    assert sum(words.values()) == pytest.approx(1.5 * all_words, rel=0.05)


def test_pieces_decode_to_the_texts(steps):
    coded = steps[5]
    assert coded.filter("not round_trip").count() == 0
    back = Counter(r.text for r in pieces.decoded(coded).collect())
    assert back == Counter(k[1] for k in rows(steps[4]).elements())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_bound_what_a_worker_is_given_at_once(spark, steps, stage):
    """3000 texts of 4000 characters come in batches of a few megabytes, not at once."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    stage(spark, steps[0].limit(50), "")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    got = spark.range(3000).selectExpr("repeat('text', 1000) as text").coalesce(1).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 3000
    assert max(r.size for r in got) < 1.5 * BATCH_BYTES
