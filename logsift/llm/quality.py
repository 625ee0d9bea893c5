"""Quality by a generalised additive model with pairwise interactions.

Each feature has a table of bins, and so has each chosen pair of features. Boosting
goes round the features: a shallow tree over the bins is fitted to the gradient of
the logistic loss and added, shrunk, to the feature's table. When the single
tables are done, the pairs with the largest gain on what is left get tables in the
same way. A score is the sum of one entry of each table, looked up for all rows of
a batch at once, through the logistic function.

Training takes a bounded sample of labelled texts, weighted so that the classes
count as often as in all labels. Features read whole texts. Null counts as the
empty text, which has a score like any other. Repeated rows get equal scores. An
empty table gives an empty result. With one class only, all texts get its share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.tables import extended, portions, without

BINS = 32
PAIR_BINS = 8
ROUNDS = 120
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.1
DEPTH = 2
RIDGE = 1.0
#: Labelled texts that training takes of each class, those with the least hash of their id.
SAMPLE = {1: 8000, 0: 8000}
THRESHOLD = 0.7

FEATURES = (
    "log_bytes",
    "mean_word",
    "long_words",
    "short_words",
    "upper",
    "digits",
    "marks",
    "exclaims",
    "bars",
    "beyond_ascii",
    "controls",
    "spaces",
    "distinct_words",
    "repeats",
    "top_word",
    "distinct_lines",
    "line_bytes",
    "ended_lines",
    "capital_words",
    "signs_in_words",
)

_BYTE = np.arange(256)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SPACE = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
_HIGH = _BYTE >= 128
_CONTROL = (_BYTE < 32) & ~_SPACE
_MARK = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _HIGH | _CONTROL)


def features_of(text: str | None) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(count[_LOWER].sum() + count[_UPPER].sum() + count[_HIGH].sum()))
    words = raw.split()
    n_words = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    seen = Counter(words)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    capital = sum(w[:1].isupper() for w in words)
    signs = sum(not w.rstrip(b".,;:").isalpha() and w.isascii() for w in seen)
    return [
        float(np.log1p(len(raw))),
        float(sizes.sum() / n_words),
        float((sizes > 15).sum() / n_words),
        float((sizes <= 2).sum() / n_words),
        float(count[_UPPER].sum() / letters),
        float(count[_DIGIT].sum() / n),
        float(count[_MARK].sum() / n),
        float(count[33] / n),
        float(count[124] / n),
        float(count[_HIGH].sum() / n),
        float(count[_CONTROL].sum() / n),
        float(count[_SPACE].sum() / n),
        len(seen) / n_words,
        repeats / n_words,
        max(seen.values(), default=0) / n_words,
        len(set(lines)) / n_lines,
        float(np.log1p(len(raw) / n_lines)),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / n_lines,
        capital / n_words,
        signs / max(1, len(seen)),
    ]


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features_of(t) for t in texts], float).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for (a, b), table in self.pairs.items():
            i, j = (np.searchsorted(self.coarse[f], x[:, f], "right") for f in (a, b))
            total += table[i, j]
        return total

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(feature_matrix(texts))))


@dataclass
class Constant:
    share: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.share)


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g**2 / (h + RIDGE)


def _grow(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A tree over bins in order: the step of each bin."""
    out = np.full(len(g), g.sum() / (h.sum() + RIDGE))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
        at = int(gain.argmax()) + 1
        if gain[at - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            out[:at], out[at:] = _grow(g[:at], h[:at], depth - 1), _grow(g[at:], h[at:], depth - 1)
    return out


def _grow_pair(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The better of: a cut of the first feature and one of the second on each side, or the other way round."""
    best, most = np.zeros_like(g), -1.0
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, gg.shape[0]):
            sides = [_grow(gg[s].sum(0), hh[s].sum(0), 1) for s in (slice(cut), slice(cut, None))]
            gain = sum((2 * w * gg[s].sum(0) - w**2 * (hh[s].sum(0))).sum() for w, s in zip(sides, (slice(cut), slice(cut, None)), strict=True))
            if gain > most:
                step = np.vstack([np.tile(sides[0], (cut, 1)), np.tile(sides[1], (gg.shape[0] - cut, 1))])
                best, most = (step.T if turned else step), float(gain)
    return best, most


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Boosts the single tables round after round, then the tables of the best pairs."""
    share = float((weight * y).sum() / weight.sum())
    edges = [_cuts(x[:, f], BINS) for f in range(x.shape[1])]
    coarse = [_cuts(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    wide = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    model = Model(edges, coarse, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges])
    margin = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _grow(np.bincount(bins[f], g, len(table)), np.bincount(bins[f], h, len(table)), DEPTH)
            table += step
            margin += step[bins[f]]

    def squares(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = wide[a] * shape[1] + wide[b]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    g, h = slopes()
    gains = {(a, b): _grow_pair(*squares(a, b, g, h))[1] for a, b in combinations(range(x.shape[1]), 2)}
    for pair in sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]:
        model.pairs[pair] = np.zeros((len(coarse[pair[0]]) + 1, len(coarse[pair[1]]) + 1))
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in model.pairs.items():
            step = RATE * _grow_pair(*squares(a, b, *slopes()))[0]
            table += step
            margin += step[wide[a], wide[b]]
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        x = feature_matrix(batch.column("text").to_pylist())
        lists = pa.ListArray.from_arrays(
            np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), pa.array(x.ravel(), pa.float64())
        )
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sizes: dict[int, int] | None = None) -> Model | Constant:
    """Features of at most sum(SAMPLE) labelled texts come to the driver, which boosts the tables."""
    sizes = sizes or SAMPLE
    known = labels.filter(learn & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    known = known.filter(F.col("label").isin(*sizes))
    totals = dict(known.groupBy("label").count().collect())
    if len(totals) < 2:
        return Constant(float(next(iter(totals), 0)))
    parts = [
        known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        for label, size in sizes.items()
    ]
    # As many ids as the sizes say, so the side is bounded. An id with both labels has the higher.
    chosen = parts[0].unionByName(parts[1]).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Rows of one id are one text, the first in order, so that the sample is bounded by its ids.
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    data = rows.mapInArrow(_measured, "doc_id long, label int, x array<double>").toPandas()
    data = data.sort_values("doc_id", kind="stable")
    if data["label"].nunique() < 2:
        return Constant(float(data["label"].max()) if len(data) else 0.0)
    y = data["label"].to_numpy(float)
    taken = {c: (y == c).sum() for c in totals}
    weight = np.array([totals[c] / taken[c] for c in y.astype(int)])
    return train(np.stack(data["x"].to_numpy()), y, weight / weight.mean())


def score(docs: DataFrame, model: Model | Constant) -> DataFrame:
    """The documents' columns and score; a column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            scores = held.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    rows = docs.select(*without(docs, "score"))
    return rows.mapInArrow(run, extended(rows, {"score": "double"}))
