"""Whitening by principal components; eigenvectors by spectral divide-and-conquer.

1. Every task sums up its vectors' entries and their products in whole numbers;
   Spark adds the sums up, one row per pair of dimensions. They are exact, in any
   order and however the rows are dealt.
2. The covariance, one small matrix, is split on the driver. The polar factor of
   the covariance minus a shift, by QDWH iteration (dynamically weighted Halley
   steps, each a QR factorisation), is the sign of its eigenvalues; from it come
   the projectors on the eigenvectors above and below the shift. Bases of both
   ranges split the matrix into two smaller ones, and so on down to single
   components.
3. The components over the roots of their eigenvalues are broadcast (dimensions x
   components), and every row is projected where it is read.

An entry c becomes x = floor(64 c) + 1000000. Vectors that are null, empty, or
hold a null or non-finite entry take no part. Vectors take part if they have the
commonest length (of equally common ones the longest); others give no rows. An
entry whose x is beyond 62 bits is an error. Components whose eigenvalue is zero up
to rounding cannot be whitened and are left out: a table of one vector, or of equal
vectors, gives no rows, like an empty one. Null and repeated ids and repeated rows
are rows like others; extra columns are dropped. Which vector spans a component
with repeated eigenvalue is arbitrary but the same for all rows; its sign is
chosen so that its largest entry is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Vectors that a task works on at a time.
ROWS = 2048
_EXACT_FLOAT = 2.0**53
_LIMB = 64
_LIMBS = 4


# --- whole numbers -------------------------------------------------------------


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, e: the vectors without null and non-finite entries."""
    wide = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")
    )
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return wide.filter((F.size("e") > 0) & ~F.coalesce(bad, F.lit(True)))


def commonest_length(sound: DataFrame) -> int | None:
    """The length that most vectors have; None for an empty table."""
    counted = sound.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n"))
    first = counted.orderBy(F.desc("n"), F.desc("d")).first()
    return first and first["d"]


def _integers(lists: pa.Array, width: int) -> np.ndarray:
    """floor(64 c) of lists that all have one length, as longs."""
    scaled = np.floor(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) * SCALE)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise ValueError("an entry of a vector is beyond 62 bits")
    return scaled.astype(np.int64)


def _products(y: np.ndarray) -> np.ndarray:
    """y'y exactly: in doubles where all sums are whole doubles, else in Python's integers."""
    top = float(np.abs(y).max(initial=0))
    if top * top * max(len(y), 1) < _EXACT_FLOAT:
        return (y.T.astype(float) @ y.astype(float)).astype(np.int64)
    wide = y.astype(object)
    return wide.T.dot(wide)


def _moments(width: int):
    """Rows (i, j, limbs of the sum): products for i <= j, entries for i = -1, rows for both -1."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = _integers(batch.column(0).slice(at, ROWS), width)
                rows += len(y)
                # Sums of 62-bit numbers need not fit 64 bits.
                sums += y.sum(0) if len(y) * float(np.abs(y).max(initial=0)) < _EXACT_FLOAT else y.astype(object).sum(0)
                products += _products(y)
        if not rows:
            return
        i = np.concatenate([[-1], np.full(width, -1), upper[0]]).astype(np.int32)
        j = np.concatenate([[-1], np.arange(width), upper[1]]).astype(np.int32)
        values = [rows, *(int(s) for s in sums), *(int(p) for p in products[upper])]
        limbs = [
            pa.array([str(v >> _LIMB * k if k == _LIMBS - 1 else v >> _LIMB * k & (1 << _LIMB) - 1) for v in values])
            for k in range(_LIMBS)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *limbs], names=["i", "j", *_LIMB_NAMES])

    return run


_LIMB_NAMES = [f"l{k}" for k in range(_LIMBS)]


@dataclass
class Moments:
    """Exact sums over the fit list of y = floor(64 c)."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def covariance(self) -> np.ndarray:
        """Divisor n; every entry is the exact one, rounded once."""
        n, s = self.n, self.sums
        size = len(s)
        out = np.empty((size, size))
        for i in range(size):
            for j in range(i, size):
                out[i, j] = out[j, i] = float(Fraction(n * self.products[i][j] - s[i] * s[j], n * n))
        return out


def moments(sound: DataFrame, width: int) -> Moments:
    """Sums over all rows; what comes to the driver has one row per pair of dimensions."""
    found = sound.select("e").mapInArrow(_moments(width), "i int, j int, " + ", ".join(f"{n} string" for n in _LIMB_NAMES))
    total = found.groupBy("i", "j").agg(*[F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in _LIMB_NAMES])
    n, sums, products = 0, [0] * width, [[0] * width for _ in range(width)]
    for row in total.collect():
        value = sum(int(row[name]) << _LIMB * k for k, name in enumerate(_LIMB_NAMES))
        if row["j"] < 0:
            n = value
        elif row["i"] < 0:
            sums[row["j"]] = value
        else:
            products[row["i"]][row["j"]] = products[row["j"]][row["i"]] = value
    return Moments(n, sums, products)


# --- eigenvectors --------------------------------------------------------------

_EPS = float(np.finfo(float).eps)


def polar_factor(a: np.ndarray, steps: int = 40) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix by QDWH iteration."""
    size = len(a)
    x = a / np.linalg.norm(a)
    # The lower bound of the singular values steers the weights; too low a one costs steps only.
    low = max(1 / (np.linalg.norm(np.linalg.inv(x + _EPS * np.eye(size)), 1) * np.sqrt(size)), _EPS)
    low = min(low, 1.0)
    for _ in range(steps):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square)) if square < 1 else 0.0
        root = np.sqrt(1 + d)
        weight_a = root + np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0)) / 2
        weight_b = (weight_a - 1) ** 2 / 4
        weight_c = weight_a + weight_b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(weight_c) * x, np.eye(size)]))
        part = (weight_a - weight_b / weight_c) / np.sqrt(weight_c)
        last, x = x, weight_b / weight_c * x + part * q[:size] @ q[size:].T
        x = (x + x.T) / 2
        low = min(low * (weight_a + weight_b * square) / (1 + weight_c * square), 1.0)
        if np.linalg.norm(x - last) <= 10 * _EPS * size and 1 - low < 10 * _EPS:
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, int] | None:
    """A basis whose first k columns span the eigenvectors above the shift; None if that fails."""
    size = len(a)
    projector = (polar_factor(a - shift * np.eye(size)) + np.eye(size)) / 2
    k = round(float(np.trace(projector)))
    if not 0 < k < size or np.linalg.norm(projector @ projector - projector) > 1e-6:
        return None
    # The projector's longest columns, one after another, span its range.
    left, picked = projector.copy(), []
    for _ in range(k):
        column = int((left**2).sum(0).argmax())
        picked.append(column)
        unit = left[:, column] / np.linalg.norm(left[:, column])
        left -= np.outer(unit, unit @ left)
    basis = projector[:, picked]
    for _ in range(2):
        basis = projector @ np.linalg.qr(basis)[0]
    return np.linalg.qr(basis, mode="complete")[0], k


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and the unit eigenvectors as columns."""
    size = len(a)
    scale = np.linalg.norm(a)
    values, vectors = np.empty(size), np.empty((size, size))
    waiting = [(0, a, np.eye(size))]
    while waiting:
        at, part, basis = waiting.pop()
        m = len(part)
        off = part - np.diag(np.diag(part))
        centre = np.trace(part) / m
        if m == 1 or np.linalg.norm(part - centre * np.eye(m)) <= _EPS * scale:
            values[at : at + m], vectors[:, at : at + m] = np.diag(part), basis
            continue
        diagonal = np.sort(np.diag(part))
        if np.linalg.norm(off) <= _EPS * scale:
            order = np.argsort(-np.diag(part), kind="stable")
            values[at : at + m], vectors[:, at : at + m] = np.diag(part)[order], basis[:, order]
            continue
        # The median and mean of a diagonal lie between the least and the greatest eigenvalue.
        spread = np.linalg.norm(part - centre * np.eye(m))
        shifts = [np.median(diagonal), centre, *(centre + spread * f for f in (0.1, -0.1, 0.03, -0.03, 0.3, -0.3, 0.01, -0.01, 0.6, -0.6))]
        best = None
        for shift in shifts:
            split = _split(part, float(shift))
            if split is None:
                continue
            u, k = split
            turned = u.T @ part @ u
            error = np.linalg.norm(turned[k:, :k])
            if best is None or error < best[0]:
                best = (error, u, k, turned)
            if error <= 4 * _EPS * m * scale:
                break
        if best is None or best[0] > 1e-10 * scale:
            raise ArithmeticError("a covariance could not be split")
        _, u, k, turned = best
        turned = (turned + turned.T) / 2
        waiting.append((at, turned[:k, :k], basis @ u[:, :k]))
        waiting.append((at + k, turned[k:, k:], basis @ u[:, k:]))
    # Rounding of the whole matrix, not of its parts, decides the values.
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Whitening:
    """What whitens a vector: means as sums over n, components over the roots of their eigenvalues."""

    n: int
    sums: list[int]
    weights: np.ndarray
    explained: np.ndarray


def fit(sound: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    total = moments(sound, width)
    covariance = total.covariance()
    values, vectors = eigenvectors(covariance)
    trace = float(np.trace(covariance))
    used = int((values[:components] > 4 * _EPS * width * max(trace, 0)).sum())
    vectors = vectors[:, :used]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(used)] < 0, -1.0, 1.0)
    return Whitening(total.n, total.sums, vectors / np.sqrt(values[:used]), values[:used] / (trace or 1.0))


# --- projection ----------------------------------------------------------------


def _centred(y: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """x - S/n in doubles, and the exact sum over dimensions of (n x - S)^2."""
    top = max(float(np.abs(y).max(initial=0)) * model.n, max(map(abs, model.sums)))
    if 4 * top * top * y.shape[1] < 2.0**62:
        wide = y * np.int64(model.n) - np.array(model.sums, np.int64)
        return wide / float(model.n), (wide * wide).sum(1)
    wide = y.astype(object) * model.n - np.array(model.sums, object)
    return np.array([[float(Fraction(v, model.n)) for v in row] for row in wide]).reshape(y.shape), (wide * wide).sum(1)


def _whitened_batches(model, ship):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        width, used = known.weights.shape
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                centred, deviation = _centred(_integers(part.column("e"), width), known)
                yield from ship(part, centred @ known.weights, deviation, used)

    return run


def _rows(part: pa.RecordBatch, white: np.ndarray, deviation: np.ndarray, used: int) -> Iterator[pa.RecordBatch]:
    offsets = pa.array(np.arange(len(white) + 1, dtype=np.int32) * used)
    lists = pa.ListArray.from_arrays(offsets, pa.array(white.reshape(-1)))
    texts = pa.array([str(int(d)) for d in deviation], pa.string())
    yield pa.RecordBatch.from_arrays([part.column("vec_id"), texts, lists], names=["vec_id", "deviation", "white"])


def _second_moments(part: pa.RecordBatch, white: np.ndarray, deviation: np.ndarray, used: int) -> Iterator[pa.RecordBatch]:
    i, j = np.triu_indices(used)
    sums = np.concatenate([white.sum(0), (white.T @ white)[i, j]])
    i, j = np.concatenate([np.full(used, -1), i]), np.concatenate([np.arange(used), j])
    arrays = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums)]
    yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "s"])


def identity_error(sound: DataFrame, shared, model: Whitening) -> float:
    """Largest absolute entry of the covariance of all whitened rows, as measured, minus the identity."""
    used = model.weights.shape[1]
    parts = sound.mapInArrow(_whitened_batches(shared, _second_moments), "i int, j int, s double")
    means, products = np.zeros(used), np.zeros((used, used))
    for row in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        if row["i"] < 0:
            means[row["j"]] = row["s"] / model.n
        else:
            products[row["i"], row["j"]] = products[row["j"], row["i"]] = row["s"] / model.n
    return float(np.abs(products - np.outer(means, means) - np.eye(used)).max())


_SCHEMA = "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    deviation is a whole number of any length, hence text. The fit reads the vectors twice (sums; the covariance of what comes out), the result once more.
    """
    session = vectors.sparkSession
    sound = sound_vectors(vectors)
    width = commonest_length(sound)
    if width is None:
        return session.createDataFrame([], _SCHEMA)
    sound = sound.filter(F.size("e") == width)
    model = fit(sound, width, components)
    if not model.weights.shape[1]:
        return session.createDataFrame([], _SCHEMA)
    shared = session.sparkContext.broadcast(model)
    error = identity_error(sound, shared, model)
    white = sound.mapInArrow(_whitened_batches(shared, _rows), "vec_id long, deviation string, white array<double>")
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    long = white.select("vec_id", "deviation", F.posexplode("white"))
    return long.select(
        "vec_id",
        (F.col("pos") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("col").alias("whitened"),
        F.element_at(explained, F.col("pos") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
