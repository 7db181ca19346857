from pathlib import Path

import pytest
import sentencepiece

from fieldloom.llm import pieces

MODELS = sorted(str(p) for p in Path("/opt/tokenizers").rglob("*.model"))
ODD = ["", " ", "  two  spaces ", "\n\ttabs\r\n", "naïve 漢字 😀👍🏽 é", "a" * 500, "aaaa bbbb " * 40, "x\x00y", "http://a.b/c?d=e&f", "1234567890 3.14", "▁already▁escaped ▁", "<s> </s> <unk>", "İstanbul ß ǅ", "​ 　"]


@pytest.mark.parametrize("path", MODELS)
def test_ids_equal_the_library(path, docs):
    try:
        model = pieces.Model.load(path)
    except ValueError:
        pytest.skip("a model of a kind that is refused")
    known, mine = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Transducer(model)
    texts = ODD + [r.text[:4000] for r in docs.limit(60).collect()]
    for t in texts:
        assert list(memoryview(mine.encode(t)).cast("i")) == known.encode(t), t[:80]


def test_some_model_is_there():
    assert pieces.MODEL in MODELS


def test_round_trip_of_all_documents(docs):
    coded = pieces.encoded(docs).cache()
    assert coded.filter("not round_trip or n_ids <> size(ids)").count() == 0
    back = {r.doc_id: r.text for r in pieces.decoded(coded).collect()}
    assert back == {r.doc_id: r.text.replace("▁", " ") for r in docs.collect()}


def test_edge_cases(edge, none):
    rows = pieces.encoded(edge).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert (r.ids is None) == (r.n_ids is None) == (r.round_trip is None)
        assert r.ids is None or (r.round_trip and len(r.ids) == r.n_ids)
    assert pieces.encoded(none).count() == 0


def test_unigram_paths_are_the_lightest():
    """Against all segmentations of short texts."""
    m = pieces.Model(["<unk>", "a", "b", "ab", "ba", "aba", "bb"], [0, -2.0, -2.5, -3.0, -3.4, -5.9, -9.0], [2, 1, 1, 1, 1, 1, 1], False, False, False, False)
    t = pieces.Transducer(m)

    def best(s):
        if not s:
            return 0.0
        return max(m.scores[t.arcs[s[:n]]] + best(s[n:]) for n in range(1, len(s) + 1) if s[:n] in t.arcs)

    for s in ("a", "abab", "ababab", "bbaabba", "abbbba"):
        assert sum(m.scores[i] for i in t.path(s)) == pytest.approx(best(s))
        assert "".join(m.pieces[i] for i in t.path(s)) == s


def test_a_worker_keeps_one_transducer():
    """Workers outlive queries: the same model is not loaded twice, another one takes its place."""

    class Shipped:
        value = property(lambda self: object())

    first = pieces.of_worker("a", Shipped())
    assert pieces.of_worker("a", Shipped()) is first
    other = pieces.of_worker("b", Shipped())
    assert other is not first and list(pieces._workers.values()) == [other]
    pieces._workers.clear()


def test_ids_do_not_depend_on_the_caches_room(docs, monkeypatch):
    texts = [r.text[:3000] for r in docs.limit(20).collect()]
    whole = pieces.Transducer(pieces.Model.load(pieces.MODEL))
    want = [whole.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "CACHED", 30)
    monkeypatch.setattr(pieces, "AGREED", 40)
    small = pieces.Transducer(pieces.Model.load(pieces.MODEL))
    for t, ids in zip(texts, want, strict=True):
        assert small.encode(t) == ids
        assert len(small.words) <= 30 and len(small.agree) <= 40
