"""Exact top-k by inner product with pivot-table elimination.

Components are made integers, floor(256 x). Every vector carries its distances to
a few pivots. For a query and a candidate, the largest difference of their
distances to a pivot is a lower bound of the distance between them, and with the
norms an upper bound of their score. A task takes candidates in the order of that
bound and stops at the first that cannot reach the k-th best score it has.

The work is a grid: queries are cut into blocks of bounded size, candidates are
dealt over slices, and each cell of the grid is one block of queries against one
slice, so no side is broadcast and no task holds more than a block of queries and
a batch of candidates. Every cell keeps k rows a query, and these are ranked.

Vectors that are null, empty, or hold a null or non-finite component take no part, nor do
null ids. Missing components of shorter vectors count as zero. Rows repeated with the
same id are candidates of their own but never their own query's; a repeated query
id counts once, by its first vector in component order. Ties go to the smaller id.
Scores are exact: components so large that a score may reach 2^53 are an error. Extra columns are
dropped; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.sources.storage import saved

K = 5
PIVOTS = 32
#: Pivots are picked from so many vectors, those with the least hash of their id.
PIVOT_SAMPLE = 2048
QUERY_BLOCK = 1024
#: Candidates whose bounds are worked out at a time.
STEP = 2048
#: Candidates scored at a time while bounds are walked down.
STRIDE = 64


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (integers as doubles) of the vectors that take part."""
    wide = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")
    )
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = wide.filter(F.col("vec_id").isNotNull() & (F.size("e") > 0) & ~F.coalesce(bad, F.lit(True)))
    # floor() of a double is a long in Spark; no sound component of use is beyond it.
    return sound.select("vec_id", F.transform("e", lambda x: F.floor(x * 256).cast("double")).alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), inside] = flat
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _measure(pivots: np.ndarray, width: int):
    """Adds far: each vector's distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _distances(_matrix(batch.column("v"), width), pivots)
            offsets = pa.array(np.arange(len(far) + 1, dtype=np.int32) * len(pivots))
            lists = pa.ListArray.from_arrays(offsets, pa.array(far.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "v", "far"])

    return run


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each next pivot is the vector farthest from those chosen."""
    chosen = [0]
    far = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


class _Cell:
    """One block of queries and the best k candidates met so far for each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, table: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.table, self.k = ids, vectors, table, k
        self.norms = (vectors**2).sum(1)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, ids: np.ndarray, vectors: np.ndarray, table: np.ndarray) -> None:
        norms = (vectors**2).sum(1)
        low = np.zeros((len(self.ids), len(ids)))
        for p in range(table.shape[1]):
            np.maximum(low, np.abs(self.table[:, p, None] - table[None, :, p]), out=low)
        # Room for the rounding of roots: never an elimination too many.
        slack = 1e-9 * (self.norms[:, None] + norms[None, :]) + 1e-6
        bounds = (self.norms[:, None] + norms[None, :] - low**2) / 2 + slack
        hopeful = np.flatnonzero((bounds >= self.scores[:, -1:]).any(1))
        for q in hopeful:
            self._walk(q, ids, vectors, bounds[q])

    def _walk(self, q: int, ids: np.ndarray, vectors: np.ndarray, bound: np.ndarray) -> None:
        live = np.flatnonzero(bound >= self.scores[q, -1])
        order = live[np.argsort(-bound[live], kind="stable")]
        at, stride = 0, STRIDE
        while at < len(order) and bound[order[at]] >= self.scores[q, -1]:
            part = order[at : at + stride]
            part = part[ids[part] != self.ids[q]]
            score = vectors[part] @ self.vectors[q]
            good = score >= self.scores[q, -1]
            if good.any():
                scores = np.concatenate([self.scores[q], score[good]])
                found = np.concatenate([self.found[q], ids[part[good]]])
                best = np.lexsort((found, -scores))[: self.k]
                self.scores[q], self.found[q] = scores[best], found[best]
            at += stride
            stride *= 2

    def rows(self) -> pa.RecordBatch:
        q, r = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[q]), pa.array(self.found[q, r]), pa.array(self.scores[q, r].astype(np.int64))],
            names=["query_id", "vec_id", "score"],
        )


def _search(pivots: np.ndarray, width: int, k: int):
    """Rows come by cell, queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, waiting, cell = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("block", "slice", "kind")], 1)
            if not len(keys):
                continue
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                part = batch.slice(begin, end - begin)
                if tuple(keys[begin, :2]) != here:
                    if cell:
                        yield cell.rows()
                    here, waiting, cell = tuple(keys[begin, :2]), [], None
                ids, vectors = part.column("vec_id").to_numpy(), _matrix(part.column("v"), width)
                table = _matrix(part.column("far"), len(pivots))
                if keys[begin, 2] == 0:
                    waiting.append((ids, vectors, table))
                    continue
                if cell is None and waiting:
                    cell = _Cell(*(np.concatenate(x) for x in zip(*waiting, strict=True)), k)
                if cell:
                    for at in range(0, len(ids), STEP):
                        step = slice(at, at + STEP)
                        cell.offer(ids[step], vectors[step], table[step])
        if cell:
            yield cell.rows()

    return run


def top_k(vectors: DataFrame, is_query, k: int = K, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query."""
    spark = vectors.sparkSession
    sound = saved(integer_vectors(vectors))
    largest = F.max(F.array_max(F.transform("v", F.abs)))
    n_queries, n, width, top = (
        sound.agg(F.count_distinct(F.when(is_query, F.col("vec_id"))), F.count(F.lit(1)), F.max(F.size("v")), largest).first()
    )
    if n and top * top * width >= 2.0**53:
        raise ValueError("components are too large for exact scores")
    sample = sound.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").collect() if n else []
    rows = np.zeros((len(sample), width or 1))
    for row, (v,) in zip(rows, sample, strict=True):
        row[: len(v)] = v
    chosen = choose_pivots(rows, pivots) if len(rows) else rows
    told = saved(sound.mapInArrow(_measure(chosen, width or 1), "vec_id long, v array<double>, far array<double>"))
    asked = told.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "far")).alias("q"))
    asked = asked.select("vec_id", "q.v", "q.far")
    blocks = max(1, -(-n_queries // query_block))
    # A cell a task, and no more copies of the queries than that takes.
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-parallel // blocks))
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asked.select("vec_id", "v", "far", block.alias("block"), all_of(slices).alias("slice"), F.lit(0).alias("kind"))
    right = told.select("vec_id", "v", "far", all_of(blocks).alias("block"), part.alias("slice"), F.lit(1).alias("kind"))
    # A number given keeps Spark from merging cells, whose work it cannot know from their bytes.
    dealt = left.unionByName(right).repartition(parallel, "block", "slice").sortWithinPartitions("block", "slice", "kind")
    best = dealt.mapInArrow(_search(chosen, width or 1, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
    return ranked.filter(F.col("rank") <= k)
