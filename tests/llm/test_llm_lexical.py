"""Ranked search against all scores."""

import math
import random
import re
from collections import Counter

import pytest

from logsift.llm import lexical

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return _TERM.findall(lowered)


def brute(docs, items, k):
    split = [(i, terms(t)) for i, t in docs]
    held = [(i, len(t), Counter(t)) for i, t in split if t]
    total = sum(n for _, n, _ in held)
    holding = Counter(t for _, _, counts in held for t in counts)
    out = []
    for item, text in set(items):
        scores = []
        for doc_id, n, counts in held:
            m = 100 - 50 + 50 * n * len(held) // total
            score = 0
            for t in set(terms(text)):
                w = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * holding[t] + 1)))
                score += w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return out


def tables(spark, docs, items, parts=4):
    left = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, item_id string")
    right = spark.createDataFrame([(*r, 2.0) for r in items], "item_id long, text string, rank double")
    return left.repartition(parts), right.repartition(2)


def key(row):
    return tuple((v is None, v or 0) for v in row)


def check(spark, docs, items, k, **how):
    got = lexical.search(*tables(spark, docs, items), k=k, **how).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, items, k), key=key)


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "été", "ß9", "日本", "x" * 5000]
    text = lambda n: rng.choice([" ", "-", ".\n"]).join(rng.choices(words, k=n))
    docs = [(i, text(rng.choice([1, 3, 8, 40, 400]))) for i in range(200)]
    docs += [(500 + i, docs[5][1]) for i in range(40)] + [docs[7]] * 30
    docs += [(900, None), (901, ""), (902, " .,;\t"), (None, docs[3][1]), (None, docs[3][1]), (903, "a" * 3_000_000 + " w1")]
    items = [(i, text(rng.choice([1, 5, 20]))) for i in range(25)]
    items += [items[0], (0, "w1 w2"), (70, None), (71, ""), (72, "nowhere"), (None, "w3 W3 w3")]
    return docs, items


@pytest.mark.parametrize(("k", "width"), [(50, 4096), (5, 4096), (5, 7), (1, 1), (400, 64)])
def test_search(spark, sample, k, width):
    check(spark, *sample, k, width=width)


def test_blocks(spark, sample, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    check(spark, *sample, 5)


def test_pieces(monkeypatch):
    text = "aa bb, cc" * 50 + "d" * 99 + " E"
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "PIECE", 7)
    assert lexical.term_counts(text) == whole
    assert whole == {t.encode(): terms(text).count(t) for t in terms(text)}


def test_bounds_hold():
    """No sketch look-up is below the score it stands for, and few documents are scored."""
    rng = random.Random(1)
    texts = [" ".join(rng.choices([f"t{i}" for i in range(3000)], k=60)) for _ in range(3000)]
    counted = [lexical.term_counts(t) for t in texts]
    own = sorted(counted[17])
    block = lexical.Block({t: i for i, t in enumerate(own)}, lexical.np.full(len(own), 900), [lexical.np.arange(len(own))], 3000, 180000, 4096)
    search, offered = lexical._Search(block, 5), []
    search.best.offer, keep = lambda i, s, *r: (offered.extend(s), keep(i, s, *r)), search.best.offer
    search.take(counted, lexical.np.arange(3000), lexical.np.ones(3000, bool))
    assert search.best.ids[0, 0] == 17
    assert len(offered) <= 3 * search.STRIDE


def test_empty(spark, sample):
    docs, items = sample
    check(spark, [], items, 5)
    check(spark, docs, [], 5)
    check(spark, [(1, None)], items, 5)
