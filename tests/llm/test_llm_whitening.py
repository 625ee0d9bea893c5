"""Whitening against plain sums in whole numbers and another eigenvalue method."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from logsift.llm import whitening


def brute(rows, components):
    held = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, v in held]
    width = max(sizes, key=lambda d: (sizes.count(d), d))
    held = [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, v in held if len(v) == width]
    n, sums = len(held), [sum(c) for c in zip(*(v for _, v in held))]
    centred = [[Fraction(n * x - s, n) for x, s in zip(v, sums)] for _, v in held]
    cov = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(width)] for i in range(width)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    white = np.array([[float(x) for x in r] for r in centred]) @ vectors / np.sqrt(values)
    deviations = [sum((n * x - s) ** 2 for x, s in zip(v, sums)) for _, v in held]
    return n, deviations, white, values / np.trace(cov)


def vectors(n=300, dim=7):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + 3 * d) + (rng.random() if d else 5) for d in range(dim)]) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [rows[5]] * 2
    rows += [(2000, None), (2001, []), (2002, [1.0, None]), (2003, [float("nan")] * dim), (2004, [float("inf")] * dim)]
    return rows + [(None, rows[8][1]), (2005, [1.0] * (dim - 1))]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, n int, component int")


@pytest.mark.parametrize("components", [32, 3])
@pytest.mark.parametrize("scale", [1.0, 1e6, 1e-3 * 2**55])
def test_whiten(spark, components, scale):
    rows = [(i, v and [x and x * scale for x in v]) for i, v in vectors()]
    n, deviations, white, explained = brute(rows, components)
    got = whitening.whiten(table(spark, rows).coalesce(1), components).collect()
    used = white.shape[1]
    assert len(got) == len(white) * used
    assert {r["n"] for r in got} == {n}
    assert [int(r["deviation"]) for r in got[::used]] == deviations
    mine = np.array([r["whitened"] for r in got]).reshape(-1, used)
    signs = np.sign((mine * white).sum(0))
    np.testing.assert_allclose(mine, white * signs, atol=1e-9)
    np.testing.assert_allclose([r["explained"] for r in got[:used]], explained, rtol=1e-9)
    assert [r["component"] for r in got[:used]] == list(range(1, used + 1))
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-8


def test_sums_do_not_depend_on_partitions(spark):
    rows = table(spark, vectors())
    one, many = (whitening.moments(whitening.sound_vectors(rows.repartition(p)).filter("size(e) = 7"), 7) for p in (1, 9))
    assert one == many


@pytest.mark.parametrize("kind", ["usual", "low rank", "repeated", "close", "diagonal", "equal", "zero"])
@pytest.mark.parametrize("size", [1, 2, 9, 64])
def test_eigenvectors(kind, size):
    rng = np.random.default_rng(size)
    base = rng.normal(size=(size, size))
    turn = np.linalg.qr(base)[0]
    made = {
        "usual": base @ base.T,
        "low rank": np.outer(base[0], base[0]),
        "repeated": turn @ np.diag(np.arange(size) // 3 + 1.0) @ turn.T,
        "close": turn @ np.diag(1 + 1e-9 * np.arange(size)) @ turn.T,
        "diagonal": np.diag(rng.permutation(size) * 1.0),
        "equal": 4 * np.eye(size),
        "zero": np.zeros((size, size)),
    }[kind]
    made = (made + made.T) / 2
    values, found = whitening.eigenvectors(made)
    scale = np.linalg.norm(made) or 1
    np.testing.assert_allclose(values, np.linalg.eigvalsh(made)[::-1], atol=1e-13 * scale)
    np.testing.assert_allclose(found.T @ found, np.eye(size), atol=1e-12)
    np.testing.assert_allclose(made @ found, found * values, atol=1e-13 * scale)


def test_polar_factor():
    rng = np.random.default_rng(2)
    made = rng.normal(size=(12, 12))
    made = made + made.T
    left, _, right = np.linalg.svd(made)
    np.testing.assert_allclose(whitening.polar_factor(made), left @ right, atol=1e-12)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(table(spark, rows)).collect() == []


def test_fewer_components_than_dimensions(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r["component"] for r in got} == {1}
    assert sum(r["whitened"] ** 2 for r in got) / 9 == pytest.approx(1)
    assert got[0]["explained"] == pytest.approx(1)


def test_too_large(spark):
    with pytest.raises(Exception, match="beyond 62 bits"):
        whitening.whiten(table(spark, [(1, [1e30]), (2, [0.0])])).collect()
