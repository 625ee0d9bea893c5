"""N-best segmentation against all segmentations; decoding gives the text back."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logsift.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return pieces.Encoder(vocabulary, 4)


def all_ways(vocabulary, text):
    out = []

    def go(i, score, ids):
        if i == len(text):
            out.append((score, ids))
        for j in range(i + 1, len(text) + 1):
            found = vocabulary.score.get(text[i:j])
            if found:
                go(j, score + found[1], ids + [found[0]])
            elif j == i + 1:
                go(j, score + vocabulary.unknown, ids + vocabulary.spell(text[i]))

    go(0, 0.0, [])
    return sorted(out, key=lambda w: -w[0])


@pytest.mark.parametrize("chunk", ["▁hello", "▁the.rest", "漢x😀", "▁▁▁▁a", "aaaaaaa", "…ß", "\n", "▁12,5)"])
def test_segment(vocabulary, chunk):
    want, got = all_ways(vocabulary, chunk), vocabulary.segment(chunk, 5)
    assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in want[:5]]
    for score, ids in got:
        assert any(abs(score - s) < 1e-6 and ids == i for s, i in want)
    assert len({tuple(i) for _, i in got}) == len(got)


def test_best_scores_of_a_text(vocabulary, encoder):
    text = "a. cat\nsat, ok"
    ids, scores = encoder.encode([text])
    want = all_ways(vocabulary, "▁" + text.replace(" ", "▁"))
    assert np.allclose(scores[0], [s for s, _ in want[:4]])
    assert any(abs(s - scores[0][0]) < 1e-6 and i == ids[0].tolist() for s, i in want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abcer .,\n\téß漢😀|'²)", "the ", "ing "]), max_size=40).map("".join), max_size=5))
def test_round_trip(encoder, texts):
    ids, scores = encoder.encode(texts)
    assert encoder.decode(ids) == texts
    for text, best in zip(texts, scores, strict=True):
        assert best == sorted(best, reverse=True) and bool(text) == bool(best)


def test_together_as_alone(vocabulary, encoder):
    """The vectorised forward pass gives what the plain one gives."""
    words = [f"▁{a}{b}" for a in ("un", "re", "", "th") for b in ("believable", "stion", "ndwh", "x", "öst", "aaaa")]
    sizes, flat, best, second = encoder.lattices.solve(words)
    at = np.cumsum(sizes) - sizes
    for i, word in enumerate(words):
        ways = vocabulary.segment(word, 2)
        assert abs(ways[0][0] - best[i]) < 1e-6
        assert len(ways) < 2 or abs(ways[1][0] - second[i]) < 1e-6
        assert flat[at[i] : at[i] + sizes[i]].tolist() == ways[0][1]


def test_decodes_like_the_library(vocabulary, encoder):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["Hello  world", " a", "naïve 漢字 😀", "x\ny"]
    ids, _ = encoder.encode(texts)
    assert [model.decode(i.tolist()) for i in ids] == texts
    assert encoder.decode([np.array(model.encode(t)) for t in texts]) == texts


def test_forgetting_changes_nothing(vocabulary, encoder, monkeypatch):
    texts = [f"some words number {i} again" for i in range(20)]
    want = [i.tolist() for i in encoder.encode(texts)[0]]
    monkeypatch.setattr(pieces, "KEPT", 3)
    few = pieces.Encoder(vocabulary, 4)
    assert [few.encode([t])[0][0].tolist() for t in texts] == want


def test_table(docs_of):
    rows = [(1, "plain text"), (1, "plain text"), (2, None), (3, ""), (None, "▁ mark"), (4, "long word" * 20_000)]
    got = pieces.encode(docs_of(rows, "1 AS ids,2 AS decoded")).collect()
    assert sorted(r.decoded for r in got) == sorted([(t or "").replace("▁", " ") for _, t in rows])
    assert all(r.n_pieces == len(r.ids) for r in got)
    assert pieces.encode(docs_of([])).collect() == []


def test_ids_are_the_models_own(encoder):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["Elle est belle.", "Hello  world", " a", "naïve 漢字 😀", "x\ny", "aaaaaaaaab", "12,5) Straße|²", "unbelievable" * 30]
    texts += [f"{a}{b} {b}, {a}." for a in ("un", "re", "Th") for b in ("believable", "stion", "öst", "é'")]
    assert [w[0][1].tolist() for w in encoder.ranked(texts)] == [model.encode(t) for t in texts]


def test_all_segmentations_are_returned(vocabulary, docs_of):
    texts = ["a. cat\nsat, ok", "Elle", "x", "漢", ""]
    got = {r.doc_id: r for r in pieces.encode(docs_of(list(enumerate(texts))), n=4).collect()}
    for i, text in enumerate(texts):
        ways = all_ways(vocabulary, "▁" + text.replace(" ", "▁")) if text else []
        rest = [w for w in ways if w[1] != got[i].ids]
        assert len(rest) == max(len(ways) - 1, 0)
        assert len(got[i].other_ids) == len(rest[:3])
        assert np.allclose(got[i].best_scores[1:], [s for s, _ in rest[:3]])
        for ids, score in zip([got[i].ids, *got[i].other_ids], got[i].best_scores, strict=bool(text)):
            assert any(abs(s - score) < 1e-6 and w == ids for s, w in ways)
        assert len({tuple(w) for w in got[i].other_ids}) == len(got[i].other_ids)
