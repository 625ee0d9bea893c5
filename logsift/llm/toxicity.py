"""Toxicity by a subsequence string-kernel machine with Nystroem landmarks.

The kernel of two words compares their subsequences of three letters, each
occurrence weighted by DECAY to the power of the span it stretches over, spans of up
to SPAN letters. Letters put between those of an insult, or left out, cost weight
but not the match. Words are normalised to length one in the kernel's space.

Training takes a bounded sample of labelled texts. Words that set toxic texts
apart become landmarks; the Nystroem map turns a word into its kernel values with
the landmarks times the inverse root of the landmarks' own kernel matrix; a linear
machine with squared hinge loss is fitted on words of the labelled sentences. Only
texts are labelled, so the words that speak for a toxic text are those with the
highest margins, chosen anew in each round; all words of the other texts are
negative. A text's margin is the highest of its words; a logistic curve turns it
into a score.

Since the kernel is a sum over letter triples, landmarks and weights fold into
one table of triples, and scoring is a look-up per triple.

Null and empty texts have no words and get the lowest score. Long texts are read
whole; words longer than WINDOW letters are read in overlapping windows. Repeated
rows get equal scores. An empty table gives an empty result. If the labelled
sample holds only one class, all texts get that class's share as score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.tables import extended, portions, without

DECAY = 0.7
SPAN = 6
WINDOW = 24
LANDMARKS = 64
#: Labelled texts that training takes of each class, those with the least hash of
#: their id, and the longest text it takes.
SAMPLE = {1: 1000, 0: 1500}
SAMPLE_BYTES = 40_000
#: Texts that are not toxic whose words are tried on the first machine, and how many
#: of the words it takes for insults are used to fit the second.
HARD_SAMPLE = 20_000
HARD_WORDS = 2_000
HARD_WEIGHT = 30.0
ROUNDS = 3
#: Words of a toxic text that may speak for it: the first, and others that are rarely met elsewhere.
WITNESSES = 3
SURE = 4.0
#: Of the words that speak most often, so many are disguised.
DISGUISED = 200
#: Words scored at a time.
SCORED = 20_000
#: Words mapped at a time in training.
CHUNK = 1_000
#: A word whose part of the margin is at most this has no say.
QUIET = 0.25
THRESHOLD = 0.5

_EDGES = ".,;:!?\"'()[]{}<>*_~-/\\|«»„“”…"
_SIGNS = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text, lower-case; letters written apart are put together too."""
    low = (text or "").lower()
    words = {w.strip(_EDGES) for w in low.split()}
    if _SPACED.search(low):
        words |= {m[0].replace(" ", "").strip(_EDGES) for m in _SPACED.finditer(low)}
    # Signs put between letters are left out, besides the word as it stands.
    words |= {_SIGNS.sub("", w) for w in words if not w.isalpha()}
    words.discard("")
    long = [w for w in words if len(w) > WINDOW]
    for word in long:
        words.remove(word)
        words |= {word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)}
    return words


@dataclass
class Letters:
    """Codes of the letters: 0 parts words, 1 stands for all that are not listed."""

    codes: dict[str, int]

    @property
    def size(self) -> int:
        return len(self.codes) + 2

    @staticmethod
    def of(words: list[str], most: int = 40) -> Letters:
        count = Counter(c for w in words for c in w)
        listed = sorted(count, key=lambda c: (-count[c], c))[:most]
        return Letters({c: i + 2 for i, c in enumerate(listed)})

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words one after another, SPAN zeros after each; where each word begins."""
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, place = np.unique(text, return_inverse=True)
        codes = np.array([self.codes.get(chr(c), 1) for c in distinct], np.int32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(sizes + SPAN)[:-1]]) if len(words) else np.zeros(0, np.int64)
        flat = np.zeros(int((sizes + SPAN).sum()), np.int32)
        if len(text):
            inside = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            flat[np.repeat(starts, sizes) + inside] = codes[place]
        return flat, starts


def _triples(flat: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, float]]:
    """For each way to leave gaps: the triple that begins at each place (0 if there is none), its weight."""
    n = len(flat) - SPAN + 1
    first = flat[:n] * (size * size)
    for b in range(1, SPAN - 1):
        head = first + flat[b : b + n] * size
        sound = (flat[:n] > 0) & (flat[b : b + n] > 0)
        for c in range(b + 1, SPAN):
            third = flat[c : c + n]
            yield np.where(sound & (third > 0), head + third, 0), DECAY ** (c + 1)


def features(words: list[str], letters: Letters) -> list[tuple[np.ndarray, np.ndarray]]:
    """Triples and weights of each word, at length one; empty for words of under three letters."""
    out = []
    for word in words:
        flat, _ = letters.encode([word])
        triples, weights = [], []
        for triple, weight in _triples(flat, letters.size):
            triples.append(triple)
            weights.append(np.full(len(triple), weight))
        key, value = np.concatenate(triples), np.concatenate(weights)
        key, place = np.unique(key, return_inverse=True)
        total = np.bincount(place, value)
        total[key == 0] = 0
        norm = np.sqrt((total**2).sum())
        out.append((key[total > 0], total[total > 0] / norm) if norm else (key[:0], total[:0]))
    return out


def _squares(keys: list[np.ndarray], weights: list[float], starts: np.ndarray, n: int) -> np.ndarray:
    """Squared length of each word: occurrences of one triple are added before they are squared."""
    word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    key, who, weight = [], [], []
    for triple, w in zip(keys, weights, strict=True):
        real = np.flatnonzero(triple)
        key.append(triple[real])
        who.append(word[real])
        weight.append(np.full(len(real), w))
    key, who, weight = np.concatenate(key), np.concatenate(who), np.concatenate(weight)
    order = np.lexsort((key, who))
    key, who, weight = key[order], who[order], weight[order]
    if not len(key):
        return np.zeros(len(starts))
    begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (who[1:] != who[:-1])))
    total = np.add.reduceat(weight, begin)
    return np.bincount(who[begin], total**2, len(starts))


@dataclass
class Model:
    letters: Letters
    #: The landmarks' features times their weights, by triple.
    table: np.ndarray
    bias: float
    slope: float
    middle: float

    def word_margins(self, words: list[str]) -> np.ndarray:
        """bias plus the word's part, which counts as QUIET if it is at most that."""
        steps = range(0, len(words), SCORED)
        return np.concatenate([np.zeros(0), *(self._margins(words[at : at + SCORED]) for at in steps)])

    def _margins(self, words: list[str]) -> np.ndarray:
        part = np.full(len(words), QUIET)
        flat, starts = self.letters.encode(words)
        n = len(flat) - SPAN + 1
        dots, least = np.zeros(n), np.zeros(n)
        for triple, weight in _triples(flat, self.letters.size):
            dots += weight * self.table[triple]
            least += weight**2 * (triple > 0)
        dots, least = np.add.reduceat(dots, starts), np.add.reduceat(least, starts)
        # Without repeated triples the squared length is `least`; it is never less.
        loud = np.flatnonzero(dots > QUIET * np.sqrt(least))
        if len(loud):
            named = [words[i] for i in loud]
            flat, starts = self.letters.encode(named)
            ways = list(_triples(flat, self.letters.size))
            square = _squares([t for t, _ in ways], [w for _, w in ways], starts, len(flat) - SPAN + 1)
            part[loud] = np.maximum(QUIET, dots[loud] / np.sqrt(square))
        return self.bias + part

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """One score for each text."""
        number: dict[str, int] = {}
        of = [[number.setdefault(w, len(number)) for w in words_of(t)] for t in texts]
        margins = self.word_margins(list(number))
        best = np.full(len(texts), self.bias + QUIET)
        sizes = np.array([len(x) for x in of])
        filled = np.flatnonzero(sizes)
        if len(filled):
            flat = np.concatenate([np.array(of[i]) for i in filled])
            best[filled] = np.maximum.reduceat(margins[flat], np.cumsum(sizes[filled]) - sizes[filled])
        return 1 / (1 + np.exp(-self.slope * (best - self.middle)))


def _linear(x: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Squared hinge loss over rows of x by Newton's method; the last coefficient is the bias."""
    n = x.shape[1] + 1
    w, hold = np.zeros(n), np.eye(n) * ridge
    hold[-1, -1] = 1e-6
    for _ in range(25):
        left, right = hold.copy(), np.zeros(n)
        for at in range(0, len(rows), CHUNK):
            part = slice(at, at + CHUNK)
            z = np.column_stack([x[rows[part]], np.ones(len(rows[part]))])
            inside = y[part] * (z @ w) < 1
            z, c = z[inside], weight[part][inside]
            left += (z * c[:, None]).T @ z
            right += (z * c[:, None]).T @ y[part][inside]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def disguised(word: str) -> list[str]:
    """Ways to write a word with a letter put in or doubled."""
    inner = range(1, len(word))
    return [word[:i] + "x" + word[i:] for i in inner] + [word[:i] + word[i - 1] + word[i:] for i in inner]


class Trainer:
    """Landmarks and mapped words of a labelled sample that has both classes."""

    def __init__(self, texts: list[str], labels: list[int]) -> None:
        self.y = np.array(labels)
        self.bags = [sorted(words_of(t)) for t in texts]
        count = {c: Counter(w for b, k in zip(self.bags, self.y, strict=True) if k == c for w in b) for c in (0, 1)}
        n = {c: max(1, int((self.y == c).sum())) for c in (0, 1)}

        def odds(word: str) -> float:
            """How surely a word speaks for toxic texts: a difference of shares over its deviation."""
            p, q = count[1][word] / n[1], count[0][word] / n[0]
            both = (count[1][word] + count[0][word] + 1) / (n[1] + n[0])
            return (p - q) / np.sqrt(both * (1 / n[1] + 1 / n[0]))

        self.words = sorted(count[1] | count[0])
        self.letters = Letters.of(self.words)
        self._choose_landmarks(
            sorted((w for w in count[1] if len(w) > 2), key=lambda w: (-odds(w), w))[: 4 * LANDMARKS]
            + sorted((w for w in count[0] if len(w) > 2), key=lambda w: (-count[0][w], w))[: LANDMARKS // 4]
        )
        self.odds = np.array([odds(w) for w in self.words])
        number = {w: i for i, w in enumerate(self.words)}
        self.toxic = [np.array([number[w] for w in b]) for b, k in zip(self.bags, self.y, strict=True) if k == 1 and b]
        self.clean = np.array(sorted(number[w] for w in count[0]), np.int64)
        self.space = self.mapped(self.words)

    def _choose_landmarks(self, candidates: list[str]) -> None:
        """The first candidates that are not too like one chosen before."""
        held: list[np.ndarray] = []
        for pairs in features(candidates, self.letters):
            table = np.zeros(self.letters.size**3, np.float32)
            table[pairs[0]] = pairs[1]
            if len(pairs[0]) and all(table @ other < 0.9 for other in held):
                held.append(table)
            if len(held) == LANDMARKS:
                break
        self.tables = np.stack(held, 1) if held else np.zeros((self.letters.size**3, 1), np.float32)
        values, vectors = np.linalg.eigh((self.tables.T @ self.tables).astype(float))
        self.root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        used = np.flatnonzero(self.tables.any(1))
        self.row_of = np.zeros(self.letters.size**3, np.int32)
        self.row_of[used] = np.arange(1, len(used) + 1)
        self.rows = np.vstack([np.zeros((1, self.tables.shape[1]), np.float32), self.tables[used]])

    def mapped(self, words: list[str]) -> np.ndarray:
        """The Nystroem map of words."""
        out = np.zeros((len(words), self.tables.shape[1]), np.float32)
        for at in range(0, len(words), CHUNK):
            flat, starts = self.letters.encode(words[at : at + CHUNK])
            ways = list(_triples(flat, self.letters.size))
            sums = np.zeros((len(flat) - SPAN + 1, self.tables.shape[1]))
            for triple, weight in ways:
                rows = self.row_of[triple]
                hit = np.flatnonzero(rows)
                sums[hit] += weight * self.rows[rows[hit]]
            square = _squares([t for t, _ in ways], [w for _, w in ways], starts, len(sums))
            dots = np.add.reduceat(sums, starts, axis=0)
            out[at : at + CHUNK] = dots / np.sqrt(np.maximum(square, 1e-12))[:, None] @ self.root
        return out

    def fit(self, hard: list[str] = ()) -> Model:
        """hard: further words of texts that are not toxic; they count for more than others."""
        wrong = self.mapped(list(hard))
        margin = self.odds
        for _ in range(ROUNDS):
            first = [b[np.argsort(-margin[b], kind="stable")[:WITNESSES]] for b in self.toxic]
            sure = [np.append(b[:1], b[1:][self.odds[b[1:]] > SURE]) for b in first]
            speak, times = np.unique(np.concatenate(sure), return_counts=True)
            # The chosen words also count with a letter put in, so that a disguise keeps a margin.
            often = np.argsort(-times, kind="stable")[:DISGUISED]
            chosen = [(self.words[speak[i]], times[i]) for i in often if times[i] > 2]
            ways = [(d, n / len(w) / 8) for w, n in chosen for d in disguised(w)]
            extra = self.mapped([d for d, _ in ways])
            x = np.vstack([self.space, extra, wrong])
            more = len(self.space) + np.arange(len(extra) + len(wrong))
            said = np.concatenate([times, [n for _, n in ways]])
            said *= 0.5 * len(self.clean) / said.sum()
            rows = np.concatenate([speak, more, self.clean])
            side = np.concatenate([np.ones(len(said)), -np.ones(len(wrong) + len(self.clean))])
            weight = np.concatenate([said, np.full(len(wrong), HARD_WEIGHT), np.ones(len(self.clean))])
            fitted = _linear(x, rows, side, weight)
            margin = self.space @ fitted[:-1].astype(np.float32) + fitted[-1]
        folded = (self.tables @ (self.root @ fitted[:-1]).astype(np.float32)).astype(float)
        model = Model(self.letters, folded, float(fitted[-1]), 1.0, 0.0)
        return _calibrated(model, self.bags, self.y, list(hard))


def _calibrated(model: Model, bags: list[list[str]], y: np.ndarray, hard: list[str]) -> Model:
    """The logistic curve's middle parts the classes with the fewest errors, at the middle of the gap.

    Each hard word counts as one more text that is not toxic.
    """
    bags, y = bags + [[w] for w in hard], np.append(y, np.zeros(len(hard), y.dtype))
    words = sorted({w for b in bags for w in b})
    number = {w: i for i, w in enumerate(words)}
    margins = model.word_margins(words)
    best = np.array([max((margins[number[w]] for w in b), default=model.bias + QUIET) for b in bags])
    order = np.argsort(best, kind="stable")
    ranked, side = best[order], y[order]
    # Errors if the cut lies before the i-th text; both classes weigh the same.
    weight = np.where(side == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))
    wrong = np.concatenate([[0], np.cumsum(weight * (side == 1))]) + np.concatenate(
        [np.cumsum((weight * (side == 0))[::-1])[::-1], [0]]
    )
    cut = int(np.flatnonzero(wrong <= wrong.min() + 1e-12)[-1])
    low, high = ranked[max(0, cut - 1)], ranked[min(len(ranked) - 1, cut)]
    model.middle = float((low + high) / 2)
    model.slope = 6.0
    return model


@dataclass
class Constant:
    """What is scored if the sample has one class only."""

    share: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.share)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, learn: Column, sizes: dict[int, int]) -> DataFrame:
    """text, label of a bounded number of rows of each class that may be learned from."""
    known = labels.filter(learn & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).alias("label"))
    parts = []
    for label, size in sizes.items():
        ids = known.filter(F.col("label") == label)
        parts.append(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size))
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    # As many ids as the sizes say, so the side is bounded. An id with both labels has the higher.
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES)
    # Rows of one id are one text, the first in order, so that the sample is bounded by its ids.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def hard_words(docs: DataFrame, labels: DataFrame, learn: Column, model: Model) -> list[str]:
    """Words of texts that are not toxic that the model takes for insults, the worst first."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            words = sorted(set().union(*map(words_of, batch.column("text").to_pylist())))
            margins = held.value.word_margins(words) - held.value.middle
            loud = np.flatnonzero(margins > -1)
            names, found = [words[i] for i in loud], [pa.array(margins[loud])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *found], names=["word", "margin"])

    texts = labelled_sample(docs, labels, "toxic", learn, {0: HARD_SAMPLE}).select("text")
    found = texts.mapInArrow(run, "word string, margin double").groupBy("word").agg(F.max("margin").alias("margin"))
    return [w for w, _ in found.orderBy(F.desc("margin"), "word").limit(HARD_WORDS).collect()]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sizes: dict[int, int] | None = None) -> Model | Constant:
    """Trains on the driver, on at most sum(SAMPLE) texts of at most SAMPLE_BYTES bytes and HARD_WORDS words."""
    sample = labelled_sample(docs, labels, "toxic", learn, sizes or SAMPLE).toPandas()
    sample = sample.sort_values(["doc_id", "text"])
    classes = sample["label"].unique()
    if len(classes) < 2:
        return Constant(float(classes[0]) if len(classes) else 0.0)
    trainer = Trainer(sample["text"].tolist(), sample["label"].tolist())
    if not trainer.tables.any():
        # No word has features, so no text can be told from another.
        return Constant(0.0)
    return trainer.fit(hard_words(docs, labels, learn, trainer.fit()))


def score(docs: DataFrame, model: Model | Constant) -> DataFrame:
    """The documents' columns and score; a column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            scores = held.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    rows = docs.select(*without(docs, "score"))
    return rows.mapInArrow(run, extended(rows, {"score": "double"}))
