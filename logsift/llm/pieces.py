"""SentencePiece encoding and decoding with the N best segmentations.

The first segmentation is the model's own: the model is a BPE model, so neighbouring
pieces are joined, the pair whose piece has the highest score first. The others are
the best of the lattice of vocabulary pieces; a segmentation's score is
the sum of its pieces' scores in the model file. Forward Viterbi gives the best score
up to every place. Backward A* starts at the end with that score as its estimate of
what is left; the estimate is exact, so segmentations come out best first and no
path is taken up that does not end in one.

The best of the lattice and the score of the second come from the forward pass, which
numpy makes for all new chunks of a batch together and which is A*'s estimate; A* runs
for the chunks whose other segmentations matter and gives their ids. The model's own
segmentation is left out of those that follow it.

No piece goes on to a space mark after another sign, or from a letter to an ending
sign, and none holds a line feed (this is checked), so a text falls into chunks
between which nothing is shared. A chunk is solved once
and kept in a table of bounded size. The N best of a text differ from its best in
the few chunks where a change costs least: only the N-1 chunks with the least
loss can take part.

A sign that no piece covers is an edge with the least score less a penalty, and is
written as byte pieces. Spaces become marks and a mark is put before the text, as
the model file says. Decoding joins the pieces and takes that back; U+2581 in a
text decodes as a space, as in SentencePiece itself, all else comes back exactly.

Null and empty texts have no pieces and decode to the empty text. Texts are read whole.
Ties go to the segmentation whose last pieces are longer. Repeated rows get equal
results. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logsift.llm.tables import extended, portions, without

MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
NBEST = 3
MARK = "▁"
PENALTY = 10.0
#: A worker forgets its solved chunks when it has more.
KEPT = 300_000
#: Chunks longer than this are solved one by one.
LONGEST_TOGETHER = 64

ADDED = {
    "ids": "array<int>",
    "n_pieces": "long",
    "other_ids": "array<array<int>>",
    "best_scores": "array<double>",
    "decoded": "string",
}


@dataclass
class Vocabulary:
    """Pieces by text, byte pieces by byte, and what each id decodes to."""

    score: dict[str, tuple[int, float]]
    byte_ids: list[int]
    text_of: list[bytes]
    unknown: float
    longest: int
    starts: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        score = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
        for piece in score:
            if _CROSSING.search(piece):
                raise ValueError(f"piece {piece!r} crosses a chunk boundary")
        text_of = [b""] * len(ids)
        for i in plain:
            text_of[i] = model.id_to_piece(i).replace(MARK, " ").encode()
        byte_ids = [0] * 256
        for i in ids:
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
                text_of[i] = bytes([int(model.id_to_piece(i)[1:-1], 16)])
        starts: dict[str, int] = {}
        for piece in score:
            starts[piece[0]] = max(starts.get(piece[0], 0), len(piece))
        least = min(s for _, s in score.values())
        return Vocabulary(score, byte_ids, text_of, least - PENALTY, max(map(len, score)), starts)

    def spell(self, sign: str) -> list[int]:
        return [self.byte_ids[b] for b in sign.encode("utf-8", "surrogatepass")]

    def merged(self, chunk: str) -> tuple[float, list[int]]:
        """The model's own segmentation, by joining: the best pair first, the leftmost on a tie."""
        known, n = self.score, len(chunk)
        # A part is known by the place it begins at; `end` is 0 once it was joined to the one before.
        end, before = list(range(1, n + 1)), list(range(-1, n))
        pairs: list[tuple[float, int, int]] = []
        for i in range(n - 1):
            found = known.get(chunk[i : i + 2])
            if found:
                pairs.append((-found[1], i, i + 2))
        heapq.heapify(pairs)
        while pairs:
            _, left, stop = heapq.heappop(pairs)
            right = end[left]
            if not right or right >= stop or end[right] != stop:
                continue
            end[left], end[right] = stop, 0
            before[stop] = left
            if stop < n:
                found = known.get(chunk[left : end[stop]])
                if found:
                    heapq.heappush(pairs, (-found[1], left, end[stop]))
            first = before[left]
            if first >= 0:
                found = known.get(chunk[first:stop])
                if found:
                    heapq.heappush(pairs, (-found[1], first, stop))
        ids: list[int] = []
        total, at = 0.0, 0
        while at < n:
            found = known.get(chunk[at : end[at]])
            ids += [found[0]] if found else self.spell(chunk[at])
            total += found[1] if found else self.unknown
            at = end[at]
        return total, ids

    def forward(self, chunk: str) -> tuple[list[float], list[list[tuple[int, float, int]]]]:
        """Viterbi scores of all places, and the edges that end at each: where from, score, id (-1: unknown)."""
        n = len(chunk)
        best = [0.0] + [-np.inf] * n
        edges: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        known, starts = self.score, self.starts
        for i in range(n):
            here = best[i]
            first = known.get(chunk[i])
            piece, score = first if first else (-1, self.unknown)
            edges[i + 1].append((i, score, piece))
            if here + score > best[i + 1]:
                best[i + 1] = here + score
            for j in range(i + 2, min(n, i + starts.get(chunk[i], 0)) + 1):
                found = known.get(chunk[i:j])
                if found:
                    edges[j].append((i, found[1], found[0]))
                    if here + found[1] > best[j]:
                        best[j] = here + found[1]
        return best, edges

    def segment(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations, best first: score and ids."""
        best, edges = self.forward(chunk)
        # Entries: minus the best score a path can end with, place, order, score behind, path.
        heap: list[tuple] = [(-best[-1], len(chunk), 0, 0.0, None)]
        order, out = 0, []
        while heap and len(out) < n:
            _, place, _, behind, path = heapq.heappop(heap)
            if not place:
                out.append((behind, self._ids(chunk, path)))
                continue
            for start, score, piece in edges[place]:
                order += 1
                heapq.heappush(heap, (-(best[start] + score + behind), start, order, behind + score, (start, piece, path)))
        return out

    def _ids(self, chunk: str, path: tuple | None) -> list[int]:
        ids: list[int] = []
        while path:
            start, piece, path = path
            ids += [piece] if piece >= 0 else self.spell(chunk[start])
        return ids


_ENDS = ".,;:!?)\"'|"
_LETTER = "[^\\W\\d_²]"
#: Marks with letters up to an ending sign; else marks with what follows up to the next mark
#: or line feed; line feeds stand alone.
_CHUNKS = re.compile(f"{MARK}*{_LETTER}+(?=[{_ENDS}])|{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_CROSSING = re.compile(f"[^{MARK}]{MARK}|\n|{_LETTER}[{_ENDS}]")


def chunks_of(text: str | None) -> list[str]:
    """The chunks of a text after its spaces became marks."""
    return _CHUNKS.findall(MARK + text.replace(" ", MARK)) if text else []


class Lattices:
    """Forward Viterbi with the two best scores of every place, for many chunks at once.

    A trie of the pieces is walked from all places of all chunks, a letter at a time;
    the pieces found are the lattices' edges. Places are then settled from left to
    right, all chunks together.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        signs = sorted({c for p in vocabulary.score for c in p})
        self.sign = {c: i for i, c in enumerate(signs)}
        nodes: dict[tuple[int, int], int] = {}
        self.piece, self.score = [-1], [0.0]
        for text, (piece, score) in vocabulary.score.items():
            node = 0
            for c in text:
                key = (node, self.sign[c])
                if key not in nodes:
                    nodes[key] = len(self.piece)
                    self.piece.append(-1)
                    self.score.append(0.0)
                node = nodes[key]
            self.piece[node], self.score[node] = piece, score
        self.piece, self.score = np.array(self.piece, np.int32), np.array(self.score)
        step = np.array([a * len(signs) + b for a, b in nodes], np.int64)
        order = np.argsort(step)
        self.steps, self.targets = step[order], np.array(list(nodes.values()), np.int32)[order]

    def solve(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each chunk (of pieces' signs only) the number of best ids, all ids, best and second score."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(sizes)
        text = "".join(chunks)
        signs = np.fromiter(map(self.sign.__getitem__, text), np.int64, len(text))
        stop = np.repeat(ends, sizes)
        source, length, node = self._edges(signs, stop)
        # Places are numbered chunk by chunk, one more than a chunk has signs.
        shift = np.arange(len(chunks))
        chunk = np.repeat(shift, sizes)
        begin = source + chunk[source]
        finish = begin + length
        first_place = ends - sizes + shift
        rank = finish - first_place[chunk[source]]
        order = np.lexsort((begin, finish, rank))
        begin, finish, rank, node = begin[order], finish[order], rank[order], node[order]
        gain = self.score[node]
        best = np.full(len(text) + len(chunks), -np.inf)
        second, back = best.copy(), np.zeros(len(best), np.int64)
        best[first_place] = 0.0
        cuts = np.searchsorted(rank, np.arange(1, (sizes.max() if len(sizes) else 0) + 2))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            self._settle(low, high, begin, finish, gain, best, second, back)
        return *self._trace(first_place, first_place + sizes, begin, node, back), best[first_place + sizes], second[first_place + sizes]

    def _edges(self, signs: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each edge begins, its length, its trie node."""
        at = np.arange(len(signs))
        node = np.zeros(len(signs), np.int64)
        n_signs, found, depth = len(self.sign), [], 0
        while len(at):
            key = node * n_signs + signs[at + depth]
            where = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            alive = self.steps[where] == key
            at, node = at[alive], self.targets[where[alive]].astype(np.int64)
            depth += 1
            piece = self.piece[node] >= 0
            found.append((at[piece], np.full(piece.sum(), depth), node[piece]))
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))

    @staticmethod
    def _settle(low, high, begin, finish, gain, best, second, back) -> None:
        """Scores of the places that the edges from low to high end at."""
        if low == high:
            return
        part = slice(low, high)
        groups = np.flatnonzero(np.append(True, finish[low + 1 : high] != finish[low : high - 1]))
        place = finish[part][groups]
        top = best[begin[part]] + gain[part]
        most = np.maximum.reduceat(top, groups)
        of = np.repeat(np.arange(len(groups)), np.diff(np.append(groups, high - low)))
        # On a tie the edge that begins first, the longest piece, is taken.
        hits = np.flatnonzero(top == most[of])
        chosen = hits[np.unique(of[hits], return_index=True)[1]]
        rest = np.maximum.reduceat(second[begin[part]] + gain[part], groups)
        top[chosen] = -np.inf
        best[place] = most
        second[place] = np.maximum(np.maximum.reduceat(top, groups), rest)
        back[place] = low + chosen

    def _trace(self, starts, ends, begin, node, back) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each chunk, and all ids."""
        here, open_, seen = ends.copy(), np.arange(len(ends)), []
        while len(open_):
            edge = back[here[open_]]
            seen.append((open_, self.piece[node[edge]]))
            here[open_] = begin[edge]
            open_ = open_[here[open_] > starts[open_]]
        if not seen:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        who = np.concatenate([w for w, _ in seen])
        step = np.concatenate([np.full(len(w), -k) for k, (w, _) in enumerate(seen)])
        order = np.lexsort((step, who))
        return np.bincount(who, minlength=len(ends)), np.concatenate([i for _, i in seen])[order]


class Merges:
    """The model's own segmentation of many chunks at once.

    Chunks of one length are a matrix of piece ids. In every round each of them joins
    its best pair, the leftmost on a tie, and so gets one column shorter; those
    without a pair are done. A pair's piece comes from a table of all ways to cut a
    piece into two.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        known = vocabulary.score
        self.single = {c: i for c, (i, _) in known.items() if len(c) == 1}
        self.width = len(vocabulary.text_of)
        pairs = [
            (known[text[:cut]][0] * self.width + known[text[cut:]][0], piece, score)
            for text, (piece, score) in known.items()
            for cut in range(1, len(text))
            if text[:cut] in known and text[cut:] in known
        ]
        pairs.sort()
        self.keys = np.array([k for k, _, _ in pairs], np.int64)
        self.joined = np.array([p for _, p, _ in pairs], np.int32)
        self.gain = np.array([s for _, _, s in pairs])
        self.score = np.zeros(self.width)
        for piece, score in known.values():
            self.score[piece] = score

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score (minus infinity: none) and piece of each pair."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.gain[at], -np.inf), np.where(found, self.joined[at], -1)

    def _matrix(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows that are done, with their ids."""
        rows = np.arange(len(ids))
        gain, piece = self._pairs(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1 and len(rows):
            best = gain.argmax(1)
            some = np.arange(len(rows))
            live = gain[some, best] > -np.inf
            if not live.all():
                yield rows[~live], ids[~live]
                rows, ids, gain, piece, best = rows[live], ids[live], gain[live], piece[live], best[live]
                some = some[: len(rows)]
            new = piece[some, best]
            columns = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.take_along_axis(ids, columns + (columns > best[:, None]), 1)
            ids[some, best] = new
            columns = columns[:, :-1]
            gain = np.take_along_axis(gain, columns + (columns >= best[:, None]), 1)
            piece = np.take_along_axis(piece, columns + (columns >= best[:, None]), 1)
            for at in (best - 1, best):
                has = np.flatnonzero((at >= 0) & (at < ids.shape[1] - 1))
                where = at[has]
                gain[has, where], piece[has, where] = self._pairs(ids[has, where], ids[has, where + 1])
        if len(rows):
            yield rows, ids

    def solve(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each chunk (of pieces' signs only) the number of ids, all ids, and the score."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        text = "".join(chunks)
        signs = np.fromiter(map(self.single.__getitem__, text), np.int32, len(text))
        begins = np.cumsum(lengths) - lengths
        sizes, scores = np.zeros(len(chunks), np.int64), np.zeros(len(chunks))
        parts = []
        for length in np.unique(lengths):
            which = np.flatnonzero(lengths == length)
            for rows, ids in self._matrix(signs[begins[which][:, None] + np.arange(length)]):
                sizes[which[rows]] = ids.shape[1]
                # From the left, as a text's score is summed up.
                for column in self.score[ids].T:
                    scores[which[rows]] += column
                parts.append((which[rows], ids))
        at = np.cumsum(sizes) - sizes
        flat = np.zeros(sizes.sum(), np.int32)
        for rows, ids in parts:
            flat[at[rows][:, None] + np.arange(ids.shape[1])] = ids
        return sizes, flat, scores


def _gathered(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ids of some chunks, one after the other."""
    held = sizes[which]
    inside = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    return flat[np.repeat(at[which], held) + inside]


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))


class Encoder:
    """Encodes and decodes batches of texts, keeping solved chunks."""

    def __init__(self, vocabulary: Vocabulary, n: int = NBEST) -> None:
        self.vocabulary, self.n = vocabulary, n
        self.lattices, self.merges = Lattices(vocabulary), Merges(vocabulary)
        self.alphabet = frozenset(c for c in vocabulary.score if len(c) == 1)
        lengths = np.array([len(t) for t in vocabulary.text_of])
        self.bytes_at = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(vocabulary.text_of), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.ways: dict[int, list[tuple[float, np.ndarray]]] = {}
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.own_sizes, self.own_flat, self.own = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
        self.first, self.loss = np.zeros(0), np.zeros(0)

    def _solve(self, new: list[str]) -> None:
        """Solve chunks and add them to the table: usual ones together, odd or long ones alone."""
        usual, odd = [], []
        for chunk in new:
            (usual if len(chunk) <= LONGEST_TOGETHER and self.alphabet.issuperset(chunk) else odd).append(chunk)
        sizes, flat, first, second = self.lattices.solve(usual)
        alone = [self.vocabulary.segment(c, 2) for c in odd]
        self.names += usual + odd
        for chunk in usual + odd:
            self.number[chunk] = len(self.number)
        self.sizes = np.concatenate([self.sizes, sizes, [len(w[0][1]) for w in alone]]).astype(np.int64)
        self.flat = np.concatenate([self.flat, flat, *(w[0][1] for w in alone)]).astype(np.int32)
        self.first = np.concatenate([self.first, first, [w[0][0] for w in alone]])
        losses = [w[0][0] - w[1][0] if len(w) > 1 else np.inf for w in alone]
        self.loss = np.concatenate([self.loss, first - second, losses])
        own_sizes, own_flat, own = self.merges.solve(usual)
        alone = [self.vocabulary.merged(c) for c in odd]
        self.own_sizes = np.concatenate([self.own_sizes, own_sizes, [len(i) for _, i in alone]]).astype(np.int64)
        self.own_flat = np.concatenate([self.own_flat, own_flat, *(i for _, i in alone)]).astype(np.int32)
        self.own = np.concatenate([self.own, own, [s for s, _ in alone]])

    def _ways(self, row: int) -> list[tuple[float, np.ndarray]]:
        """Scores and ids of a chunk's n best segmentations, by A*."""
        if row not in self.ways:
            found = self.vocabulary.segment(self.names[row], self.n)
            self.ways[row] = [(score, np.array(ids, np.int32)) for score, ids in found]
        return self.ways[row]

    def _rows(self, texts: list[str | None]) -> list[np.ndarray]:
        """Places in the table of the texts' chunks, which are solved if they are new."""
        if len(self.number) > KEPT:
            self._forget()
        parts = [chunks_of(t) for t in texts]
        self._solve(list(dict.fromkeys(c for p in parts for c in p if c not in self.number)))
        return [np.fromiter(map(self.number.__getitem__, part), np.int64, len(part)) for part in parts]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[list[float]]]:
        """Of each text the best ids of the lattice, and the scores of the n best segmentations of the whole."""
        rows = self._rows(texts)
        at = np.cumsum(self.sizes) - self.sizes
        best = [self._best(which, at) for which in rows]
        return [w[0][1] if w else np.zeros(0, np.int32) for w in best], [[s for s, _ in w] for w in best]

    def ranked(self, texts: list[str | None]) -> list[list[tuple[float, np.ndarray]]]:
        """Of each text n segmentations with their scores: the model's own, then the best others of the lattice."""
        rows = self._rows(texts)
        at, own_at = np.cumsum(self.sizes) - self.sizes, np.cumsum(self.own_sizes) - self.own_sizes
        out = []
        for which in rows:
            if not len(which):
                out.append([])
                continue
            own = _gathered(self.own_flat, own_at, self.own_sizes, which)
            others = [w for w in self._best(which, at) if not np.array_equal(w[1], own)]
            out.append([(float(self.own[which].sum()), own), *others[: self.n - 1]])
        return out

    def _best(self, which: np.ndarray, at: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """Scores and ids of the n best segmentations of the lattice of some chunks in a row."""
        if not len(which):
            return []
        few = np.arange(len(which))
        if len(which) >= self.n > 1:
            few = np.sort(np.argpartition(self.loss[which], self.n - 2)[: self.n - 1])
        sums: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        ways = [self._ways(which[i]) for i in few]
        for way in ways:
            losses = [way[0][0] - score for score, _ in way]
            sums = sorted((a + b, (*taken, k)) for a, taken in sums for k, b in enumerate(losses))[: self.n]
        top = float(self.first[which].sum())
        ids = _gathered(self.flat, at, self.sizes, which)
        ends = np.cumsum(self.sizes[which])
        out = []
        for loss, taken in sums:
            parts, done = [], 0
            for i, way, k in zip(few, ways, taken, strict=True):
                parts += [ids[done : ends[i] - self.sizes[which[i]]], way[k][1]]
                done = ends[i]
            out.append((top - loss, np.concatenate([*parts, ids[done:]])))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of id lists; bytes that are no UTF-8 become U+FFFD."""
        sizes = np.array([len(i) for i in ids], np.int64)
        flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
        length = np.diff(self.bytes_at)[flat]
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        raw = self.bytes[np.repeat(self.bytes_at[flat], length) + inside].tobytes()
        ends = np.concatenate([[0], np.cumsum(length)])
        stops = ends[np.concatenate([[0], np.cumsum(sizes)])]
        # The mark put before the text is the first byte.
        return [raw[a + 1 : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(stops, stops[1:], strict=False)]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, n: int, vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder, which outlives a task; a worker keeps one."""
    if (path, n) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, n] = Encoder(vocabulary, n)
    return _ENCODERS[path, n]


def encode(docs: DataFrame, path: str = MODEL, n: int = NBEST, digest: bool = False) -> DataFrame:
    """The documents' columns with ids, n_pieces, other_ids, best_scores and decoded.

    With `digest` no text comes back: text is left out, and decoded is decoded_sha256, the
    hexadecimal SHA-256 of its UTF-8.

    `ids` are the model's own and `other_ids` the n - 1 best others, best first;
    `best_scores` are the scores of all n in that order.

    The pieces, as many as the vocabulary has, are read on the driver and broadcast.
    """
    spark: SparkSession = docs.sparkSession
    held = spark.sparkContext.broadcast(Vocabulary.load(path))
    last = "decoded_sha256" if digest else "decoded"
    added = {**{name: kind for name, kind in ADDED.items() if name != "decoded"}, last: "string"}
    rows = docs.select(*without(docs, *ADDED, last))
    out = extended(rows.drop("text") if digest else rows, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, n, held.value)
        for part in portions(batches, 500):
            ways = encoder.ranked(part.column("text").to_pylist())
            ids = [w[0][1] if w else np.zeros(0, np.int32) for w in ways]
            counts = np.concatenate([[0], np.cumsum([max(len(w) - 1, 0) for w in ways])]).astype(np.int32)
            made = [
                _lists(ids),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.ListArray.from_arrays(counts, _lists([i for w in ways for _, i in w[1:]])),
                pa.array([[score for score, _ in w] for w in ways], pa.list_(pa.float64())),
                pa.array([shown(t) for t in encoder.decode(ids)], pa.string()),
            ]
            kept = [name for name in part.schema.names if not digest or name != "text"]
            yield pa.RecordBatch.from_arrays([*part.select(kept).columns, *made], names=[*kept, *added])

    def shown(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if digest else text

    return rows.mapInArrow(run, out)


