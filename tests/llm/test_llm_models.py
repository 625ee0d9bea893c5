"""The two classifiers: the kernel against its definition, held-out accuracy, odd tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm import quality, toxicity
from logsift.llm.tables import crc_mod


def brute_kernel(a, b):
    def feature(word):
        out = {}
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i < toxicity.SPAN:
                u = word[i] + word[j] + word[k]
                out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = feature(a), feature(b)
    dot = sum(v * y.get(u, 0) for u, v in x.items())
    return dot / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_kernel():
    words = ["banana", "bandana", "b.a.n.a.n.a", "cabana", "xylophone", "abcabcabc"]
    letters = toxicity.Letters.of(words)
    pairs = toxicity.features(words, letters)
    tables = []
    for keys, values in pairs:
        table = np.zeros(letters.size**3)
        table[keys] = values
        tables.append(table)
    for (i, a), (j, b) in itertools.product(enumerate(words), repeat=2):
        assert abs(tables[i] @ tables[j] - brute_kernel(a, b)) < 1e-9


def toxic_table(n=700):
    rng = random.Random(2)
    syllables = ["ta", "re", "mi", "so", "lu", "no", "pe", "da", "ki", "vo"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 60))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["grubwit", "snarfle", "Grubwit!", "quibhead"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def toxic(spark, docs_of):
    rows, labels = toxic_table()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return toxicity.fit(docs_of(rows), table, crc_mod("doc_id", 5) != 0), rows, labels


def test_toxic_held_out(toxic, docs_of):
    model, rows, labels = toxic
    scored = toxicity.score(docs_of(rows, "1 AS score,2 AS held").withColumn("out", crc_mod("doc_id", 5) == 0), model)
    truth = {i: t for i, _, t in labels}
    got = [(truth[r.doc_id], r.score) for r in scored.filter("out").collect()]
    assert all(0 <= s <= 1 for _, s in got)
    assert sum((s >= 0.5) == bool(t) for t, s in got) >= 0.97 * len(got)


def test_toxic_disguises(toxic):
    model = toxic[0]
    plain, *rest = model.scores(["so kita grubwit nomi", "so g.r.u.b.w.i.t no", "a g r u b w i t b", "grrubwit", "gru-bwit", "so kita nomi"])
    assert plain > 0.5 and all(s > 0.5 for s in rest[:4]) and rest[4] < 0.5


def test_toxic_odd_texts(toxic):
    model = toxic[0]
    base, *rest = model.scores(["", None, " . ", "ab", "😀", "ta" * 200_000])
    assert all(abs(s - base) < 1e-9 for s in rest[:4]) and base < 0.5
    assert model.scores(["ta re " * 50_000 + "grubwit"])[0] > 0.5
    assert len(model.scores([])) == 0


def test_toxic_odd_tables(spark, docs_of, toxic):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs_of([(1, "a")]), none, F.lit(True))
    assert [r.score for r in toxicity.score(docs_of([(1, "a"), (None, None)]), model).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1, 1), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs_of([(1, "a"), (2, "b")]), one, F.lit(True)).share == 1.0
    assert toxicity.score(docs_of([]), toxic[0]).collect() == []


def quality_table(n=600):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        bad = i % 4 == 0
        text = " ".join(words) + "."
        if bad:
            text = rng.choice([text.upper() + "!!!", " ".join([words[0]] * 60), " | ".join(words), "$$ " * 40])
        rows.append((i, text))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality_held_out(spark, docs_of):
    rows, labels = quality_table()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs_of(rows), table, crc_mod("doc_id", 4) != 2)
    scored = quality.score(docs_of(rows, "1 AS score").withColumn("out", crc_mod("doc_id", 4) == 2), model)
    truth = {i: q for i, q, _ in labels}
    got = [(truth[r.doc_id], r.score) for r in scored.filter("out").collect()]
    assert sum((s >= 0.7) == bool(q) for q, s in got) >= 0.97 * len(got)
    assert len(model.pairs) == quality.PAIRS
    odd = model.scores([None, "", "x" * 300_000, "\n\n"])
    assert odd[0] == odd[1] and all(0 <= s <= 1 for s in odd)
    assert quality.score(docs_of([]), model).collect() == []


def test_quality_tables_add_up():
    """The sum of looked-up bins is the margin, for one row at a time as well."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.train(x, y, np.ones(400))
    whole = model.margins(x)
    assert np.allclose(whole, [model.margins(x[i : i + 1])[0] for i in range(400)])
    assert ((whole > 0) == (y == 1)).mean() > 0.9  # an interaction single tables cannot learn


def test_quality_one_class(spark, docs_of):
    one = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs_of([(1, "a")]), one, F.lit(True))
    assert [r.score for r in quality.score(docs_of([(1, "a"), (2, None)]), model).collect()] == [1.0, 1.0]


def test_toxic_scores_against_landmarks_said_plainly():
    """The score of a text: the logistic curve of its loudest word, over the kernel's definition."""
    rng = random.Random(6)
    clean = ["table", "window", "garden", "morning", "bridge", "pocket", "yellow", "summer", "on", "a"]
    bad = ["scumbag", "idiots", "moronic"]
    texts = [" ".join(rng.choices(clean, k=9) + ([rng.choice(bad)] if i % 2 else [])) for i in range(120)]
    trainer = toxicity.Trainer(texts, [i % 2 for i in range(120)])
    model = trainer.fit()

    def code(c):
        return model.letters.codes.get(c, 1)

    def margin(word):
        value = {}
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i < toxicity.SPAN:
                triple = (code(word[i]) * model.letters.size + code(word[j])) * model.letters.size + code(word[k])
                value[triple] = value.get(triple, 0) + toxicity.DECAY ** (k - i + 1)
        if not value:
            return model.bias + toxicity.QUIET
        dot = sum(v * model.table[t] for t, v in value.items())
        return model.bias + max(toxicity.QUIET, dot / sum(v * v for v in value.values()) ** 0.5)

    def said(text):
        loudest = max(map(margin, toxicity.words_of(text)), default=model.bias + toxicity.QUIET)
        return 1 / (1 + np.exp(-model.slope * (loudest - model.middle)))

    tried = texts + ["", None, "a on", "s.c.u.m.b.a.g here", "scu-mbag", "日本語の文", "moronnic window", "x" * 300]
    np.testing.assert_allclose(model.scores(tried), [said(t) for t in tried], rtol=1e-6, atol=1e-9)
    # The folded table against the landmarks: the kernel with each, times what they were given.
    landmarks = trainer.tables @ trainer.root.astype(np.float32)
    assert landmarks.shape[1] <= toxicity.LANDMARKS and model.table.shape == (model.letters.size**3,)


def test_words_without_features(spark, docs_of):
    docs = docs_of([(i, "a bc de" if i % 2 else "fg h ij") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(40)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert model == toxicity.Constant(0.0)


def test_repeated_ids_do_not_enlarge_a_sample(spark, docs_of):
    docs = docs_of([(i % 4, f"words of text {i}") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4)], "doc_id long, toxic int, quality int")
    sample = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), {0: 10, 1: 10}).collect()
    assert sorted((r.doc_id, r.text) for r in sample) == [(i, min(f"words of text {k}" for k in range(i, 400, 4))) for i in range(4)]


def plain_grow(g, h, depth):
    """The best step tree over bins in order, by trying every cut."""
    whole = sum(g) / (sum(h) + quality.RIDGE)
    if not depth or len(g) < 2:
        return [whole] * len(g)
    gain = lambda a, b: sum(a) ** 2 / (sum(b) + quality.RIDGE)
    cuts = [(gain(g[:c], h[:c]) + gain(g[c:], h[c:]), -c) for c in range(1, len(g))]
    most, c = max(cuts)
    if most <= gain(g, h) + 1e-9:
        return [whole] * len(g)
    return plain_grow(g[:-c], h[:-c], depth - 1) + plain_grow(g[-c:], h[-c:], depth - 1)


def test_boosting_against_a_plain_booster(monkeypatch):
    """Cyclic boosting of the single tables, bin by bin, on a small table."""
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 0)
    monkeypatch.setattr(quality, "ROUNDS", 7)
    rng = random.Random(2)
    x = [[rng.random(), rng.randrange(4) / 3, rng.gauss(0, 1)] for _ in range(90)]
    y = [int(a + b / 2 + rng.random() / 2 > 0.9) for a, b, _ in x]
    weight = [1.0 + (i % 3) / 4 for i in range(90)]
    model = quality.train(np.array(x), np.array(y, float), np.array(weight))
    share = sum(w * t for w, t in zip(weight, y)) / sum(weight)
    bins = [[sum(e <= row[f] for e in model.edges[f]) for row in x] for f in range(3)]
    tables, margins = [[0.0] * (len(e) + 1) for e in model.edges], [np.log(share / (1 - share))] * 90
    for _ in range(7):
        for f, table in enumerate(tables):
            p = [1 / (1 + np.exp(-m)) for m in margins]
            g, h = [0.0] * len(table), [0.0] * len(table)
            for i, b in enumerate(bins[f]):
                g[b] += weight[i] * (y[i] - p[i])
                h[b] += weight[i] * p[i] * (1 - p[i])
            step = [quality.RATE * s for s in plain_grow(g, h, quality.DEPTH)]
            table[:] = [a + b for a, b in zip(table, step)]
            margins = [m + step[b] for m, b in zip(margins, bins[f])]
    for mine, theirs in zip(tables, model.tables):
        np.testing.assert_allclose(theirs, mine, atol=1e-9)
    np.testing.assert_allclose(model.margins(np.array(x)), margins, atol=1e-9)
