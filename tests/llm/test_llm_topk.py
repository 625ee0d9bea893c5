"""Exact top-k against all scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from logsift.llm import topk


def brute(rows, k):
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for q, v in sorted(good):
        if q % 5 == 0 and q not in {r[0] for r in out}:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def vectors(n=400, dim=6):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)]
    rows += [(2000, None), (2005, []), (2010, [1.0, None]), (2015, [float("nan")] * dim), (2020, [float("inf")] * dim)]
    rows += [(None, rows[0][1]), (2025, [0.5, -0.5]), (2030, [0.0] * dim)]
    return rows


@pytest.mark.parametrize(("block", "pivots"), [(1024, 32), (16, 3), (16, 1)])
def test_top_k(spark, block, pivots):
    rows = vectors()
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score int, v int")
    got = topk.top_k(table.repartition(4), F.col("vec_id") % 5 == 0, 5, pivots, block)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_few_candidates(spark):
    table = spark.createDataFrame([(0, [1.0]), (5, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 5 == 0).collect())) == brute([(0, [1.0]), (5, [2.0])], 5)


def test_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(table, F.col("vec_id") == 0).collect()))
    assert [r[:3] for r in got] == [(0, 1, 3), (0, 2, 3)]


def test_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(table, F.col("vec_id") % 5 == 0).collect() == []


def test_components_too_large(spark):
    table = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="too large"):
        topk.top_k(table, F.col("vec_id") == 0)
