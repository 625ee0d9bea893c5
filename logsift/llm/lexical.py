"""Ranked lexical search by hashed max-sketches.

A term's impact in a document is floor(1e9 tf / (1000 tf + 20 m)), where m grows
with the document's length; a document's score for an item is the sum, over the
item's terms, of the term's weight times its impact, all in whole numbers.

1. One pass counts documents, terms, and the documents that hold each of the
   items' terms. Weights and mean length come from these counts.
2. In the second pass every document folds the impacts of all its terms into a
   sketch: `WIDTH` coordinates, a term's coordinate is a hash of it, and a
   coordinate holds the largest impact that falls on it. So the sum of weights
   times the coordinates of an item's terms is never below the item's score.
   These upper bounds are looked up for a batch of documents and all items of a
   block at once, as one matrix product of whole numbers below 2^53.
3. For each item the batch's documents are scored exactly, from their own counts,
   in the order of falling bounds; the walk stops at the first bound below the
   k-th best score that the task has met. What each task keeps, k rows an item,
   is ranked in two steps.

Items are worked on in blocks of bounded size (`BLOCK_ITEMS`, `BLOCK_BYTES`): only
a block's terms are broadcast. Documents are neither shuffled nor copied.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII
in the whole text, A-Z lower-cased. Null and empty texts have no terms; documents
without terms are not counted and never found, items without terms find nothing.
Equal scores are ranked by doc_id, null ids last; repeated rows are documents of
their own. Rows of `items` with equal id and text are one item; rows with equal id
and different texts are ranked each by itself under that id. Empty tables give an
empty result. Extra columns are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.tables import portions
from logsift.sources.storage import saved

K = 50
#: Coordinates of a sketch.
WIDTH = 1 << 12
BLOCK_ITEMS = 512
BLOCK_BYTES = 1 << 20
#: Documents that a task works on at a time.
BATCH_ROWS = 1000
#: A long text is counted in pieces of about this size.
PIECE = 1 << 20
#: What the tasks keep is ranked in so many parts an item before the parts are.
PARTS = 64
_NO_ID = np.iinfo(np.int64).max
_TERM_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(c if c in _TERM_BYTES else 0x20 for c in range(256)).lower()


def term_counts(text: str | None) -> Counter[bytes]:
    """How often each term occurs in a text."""
    held = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    counts: Counter[bytes] = Counter()
    at = 0
    while at < len(held):
        end = at + PIECE
        if end < len(held):
            end = held.find(b" ", end)
            end = len(held) if end < 0 else end
        counts.update(held[at:end].split())
        at = end
    return counts


def _coordinate(term: bytes, width: int) -> int:
    return xxhash.xxh64_intdigest(term) % width


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def length_part(n, documents: int, total: int):
    """m of a document with n terms, of so many documents with so many terms in all."""
    return 100 - 50 + 50 * n * documents // total


# --- first pass: counts --------------------------------------------------------

_DOCUMENTS, _TERMS = -1, -2


def _counting(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[bytes, int] = vocabulary.value
        holding = np.zeros(len(wanted), np.int64)
        documents = total = 0
        for batch in portions(batches, BATCH_ROWS):
            for text in batch.column("text"):
                counts = term_counts(text.as_py())
                if counts:
                    documents += 1
                    total += counts.total()
                    holding[[wanted[t] for t in counts.keys() & wanted.keys()]] += 1
        met = np.flatnonzero(holding)
        terms = np.concatenate([[_DOCUMENTS, _TERMS], met])
        numbers = np.concatenate([[documents, total], holding[met]])
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(numbers)], names=["term", "n"])

    return run


# --- second pass: bounds and scores --------------------------------------------


@dataclass
class Block:
    """Some items: their terms by number, weights, and the coordinates that their terms take."""

    terms: dict[bytes, int]
    weights: np.ndarray
    items: list[np.ndarray]
    documents: int
    total: int
    width: int
    #: Coordinates in use, the place of each coordinate among them (-1: not in use), weights by (place, item).
    places: np.ndarray = field(init=False)
    lookups: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        coordinates = np.array([_coordinate(t, self.width) for t in self.terms], np.int64)
        used, place = np.unique(coordinates, return_inverse=True)
        self.places = np.full(self.width, -1, np.int32)
        self.places[used] = np.arange(len(used))
        self.lookups = np.zeros((len(used), len(self.items)))
        for item, terms in enumerate(self.items):
            np.add.at(self.lookups[:, item], place[terms], self.weights[terms])


class _Best:
    """The k best rows of each item of a block."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.scores = np.zeros((items, k), np.int64)
        self.ids = np.full((items, k), _NO_ID, np.int64)
        self.named = np.zeros((items, k), bool)

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.scores[item, -1])
        if not good.any():
            return
        scores = np.concatenate([self.scores[item], scores[good]])
        ids = np.concatenate([self.ids[item], ids[good]])
        named = np.concatenate([self.named[item], named[good]])
        first = np.lexsort((ids, ~named, -scores))[: self.k]
        self.scores[item], self.ids[item], self.named[item] = scores[first], ids[first], named[first]


class _Search:
    """One task: sketches, bounds and exact scores of its documents."""

    #: Documents scored at a time while bounds are walked down.
    STRIDE = 64

    def __init__(self, block: Block, k: int) -> None:
        self.block, self.best = block, _Best(len(block.items), k)
        self.known: dict[bytes, int] = {}

    def _place(self, term: bytes) -> int:
        place = self.known.get(term)
        if place is None:
            if len(self.known) >= 1 << 20:
                self.known.clear()
            place = self.known[term] = int(self.block.places[_coordinate(term, self.block.width)])
        return place

    def take(self, counted: list[Counter[bytes]], ids: np.ndarray, named: np.ndarray) -> None:
        block = self.block
        lengths = np.array([c.total() for c in counted], np.int64)
        # 50 n N may be beyond 64 bits where a collection is very large.
        m = np.array([length_part(int(n), block.documents, block.total) for n in lengths], np.int64)
        sketches = np.zeros((len(counted), block.lookups.shape[0]))
        exact: list[dict[int, int]] = []
        for row, counts in enumerate(counted):
            places = np.fromiter(map(self._place, counts), np.int64, len(counts))
            tfs = np.fromiter(counts.values(), np.int64, len(counts))
            np.maximum.at(sketches[row], places[places >= 0], impact(tfs[places >= 0], m[row]))
            exact.append({block.terms[t]: counts[t] for t in counts.keys() & block.terms.keys()})
        bounds = (sketches @ block.lookups).astype(np.int64)
        hopeful = (bounds >= np.maximum(self.best.scores[:, -1], 1)).any(0)
        for item in np.flatnonzero(hopeful):
            self._walk(item, bounds[:, item], exact, m, ids, named)

    def _walk(self, item: int, bound: np.ndarray, exact: list[dict[int, int]], m, ids, named) -> None:
        best, terms = self.best, self.block.items[item]
        weights = self.block.weights[terms]
        live = np.flatnonzero(bound >= max(best.scores[item, -1], 1))
        order = live[np.argsort(-bound[live], kind="stable")]
        at = 0
        while at < len(order) and bound[order[at]] >= max(best.scores[item, -1], 1):
            part = order[at : at + self.STRIDE]
            tf = np.array([[exact[row].get(t, 0) for t in terms.tolist()] for row in part], np.int64)
            best.offer(item, (weights * impact(tf, m[part, None])).sum(1), ids[part], named[part])
            at += self.STRIDE

    def rows(self, names: list[int]) -> pa.RecordBatch:
        item, place = np.nonzero(self.best.scores > 0)
        ids = self.best.ids[item, place]
        doc_ids = pa.array(ids, mask=~self.best.named[item, place])
        keys = pa.array(np.array(names, np.int64)[item])
        return pa.RecordBatch.from_arrays(
            [keys, doc_ids, pa.array(self.best.scores[item, place])], names=["key", "doc_id", "score"]
        )


def _searching(shared, names: list[int], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(shared.value, k)
        for batch in portions(batches, BATCH_ROWS):
            counted = [term_counts(t.as_py()) for t in batch.column("text")]
            kept = [row for row, counts in enumerate(counted) if counts]
            if kept:
                doc_ids = batch.column("doc_id")
                named = doc_ids.is_valid().to_numpy(zero_copy_only=False)[kept]
                ids = doc_ids.fill_null(_NO_ID).to_numpy()[kept]
                search.take([counted[row] for row in kept], ids, named)
        yield search.rows(names)

    return run


# --- the job -------------------------------------------------------------------


def _blocks(items: DataFrame) -> list[DataFrame]:
    """key, item_id, text: the items, dealt by hash over blocks of bounded size."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    rows = saved(rows.filter(F.col("text").isNotNull()))
    held = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not held["n"]:
        return []
    blocks = max(math.ceil(held["n"] / BLOCK_ITEMS), math.ceil((held["bytes"] or 0) / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [rows.filter(block == b) for b in range(blocks)]


def _search_block(docs: DataFrame, block: DataFrame, k: int, width: int) -> DataFrame | None:
    session = docs.sparkSession
    rows = [r for r in block.collect()]
    rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
    terms: dict[bytes, int] = {}
    items, ids = [], []
    for row in rows:
        own = sorted(term_counts(row["text"]))
        if own:
            ids.append(row["item_id"])
            items.append(np.array([terms.setdefault(t, len(terms)) for t in own], np.int64))
    if not items:
        return None
    counted = docs.select("text").mapInArrow(_counting(session.sparkContext.broadcast(terms)), "term long, n long")
    # One row for each term of the block, and two.
    counts = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, total = counts.get(_DOCUMENTS, 0), counts.get(_TERMS, 0)
    if not documents:
        return None
    weights = np.array([weight(documents, counts.get(t, 0)) for t in range(len(terms))], np.int64)
    shared = session.sparkContext.broadcast(Block(terms, weights, items, documents, total, width))
    names = list(range(len(items)))
    found = docs.mapInArrow(_searching(shared, names, k), "key long, doc_id long, score long")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    first = Window.partitionBy("key", "part").orderBy(*best)
    few = found.withColumn("part", part).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*best))).filter(F.col("rank") <= k)
    named = session.createDataFrame(list(zip(names, ids, strict=True)), "key long, item_id long")
    return ranked.join(F.broadcast(named), "key").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """item_id, rank, doc_id, score: for every item its k documents with the highest score above 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for block in _blocks(items):
        part = _search_block(rows, block, k, width)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found
