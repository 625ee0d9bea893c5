"""Alignment of hunks against plain dynamic programming, and white-space changes by hunk."""

import random

import pytest

from logsift import schemas
from logsift.operators import align
from logsift.operators.changes import without_space_changes


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_is_longest():
    rng = random.Random(1)
    for _ in range(400):
        letters = rng.choice([1, 2, 4, 30])
        a, b = ([rng.randrange(letters) for _ in range(rng.randrange(40))] for _ in range(2))
        pairs = align.common(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        assert len(pairs) == lcs_length(a, b)


def plain_aligned(a, b):
    """Anchors by trying every choice of once-only items in order, the longest; then LCS lengths between."""
    once = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
    return lcs_length([x for x in a if x in once], [x for x in b if x in once])


def test_anchors_and_what_lies_between():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.randrange(rng.choice([3, 12, 60])) for _ in range(rng.randrange(30))] for _ in range(2))
        anchors = align.patience(a, b)
        assert len(anchors) == plain_aligned(a, b)
        pairs = align.aligned(a, b)
        assert set(anchors) <= set(pairs)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        ends = [(-1, -1), *anchors, (len(a), len(b))]
        between = sum(lcs_length(a[p + 1 : q], b[r + 1 : s]) for (p, r), (q, s) in zip(ends, ends[1:]))
        assert len(pairs) == len(anchors) + between


def test_long_sides():
    rng = random.Random(3)
    a = [rng.randrange(3) for _ in range(4000)]
    b = [rng.randrange(3) for _ in range(4000)]
    assert len(align.common(a, b)) > 2500


def _diff(spark, rows, extra=""):
    table = spark.createDataFrame(rows, schemas.DIFF_LINES)
    return table.selectExpr("*", extra) if extra else table


def test_a_moved_line_is_a_change(spark):
    texts = ["-int a;", "-int b;", "-int c;", "+int b;", "+int c;", "+int  a;", " same", "-x", "+ x"]
    rows = [("r", "f.c", n, t[0], t[1:]) for n, t in enumerate(texts)]
    left = without_space_changes(_diff(spark, rows), bits=4).orderBy("line_no").collect()
    assert [r.sign + r.text for r in left] == ["-int a;", "+int  a;", " same"]


@pytest.mark.parametrize("bits", [4, 18])
def test_random_hunks(spark, bits):
    rng = random.Random(7)
    rows, want = [], []
    for f in range(6):
        n, hunk = 0, []
        for _ in range(25):
            hunk = [(rng.choice("+-"), rng.choice(["a b", "ab", "c", " c", "d", "", "e f"])) for _ in range(rng.randrange(1, 9))]
            numbered = [(n + k, s, t) for k, (s, t) in enumerate(hunk)]
            bare = lambda sign: [("".join(t.split()), m) for m, s, t in numbered if s == sign]
            gone = set()
            for i, j in align.aligned([t for t, _ in bare("-")], [t for t, _ in bare("+")]):
                gone |= {bare("-")[i][1], bare("+")[j][1]}
            rows += [("r", f"f{f}", m, s, t) for m, s, t in numbered]
            want += [(f"f{f}", m) for m, _, _ in numbered if m not in gone]
            n += len(hunk)
            rows.append(("r", f"f{f}", n, " ", "between"))
            want.append((f"f{f}", n))
            n += 1
    got = without_space_changes(_diff(spark, rows).repartition(5), bits=bits).collect()
    assert sorted((r.path, r.line_no) for r in got) == sorted(want)


def test_given_hunks_and_nulls(spark):
    rows = [("r", None, 1, "+", "a b"), ("r", None, 2, "-", "ab"), ("r", None, 3, "-", None), ("r", None, 4, "+", " "), (None, "p", 5, "-", "x")]
    got = without_space_changes(_diff(spark, rows, "line_no div 2 AS hunk")).collect()
    assert sorted(r.line_no for r in got) == [1, 2, 3, 4, 5]
    got = without_space_changes(_diff(spark, rows, "0L AS hunk")).collect()
    assert sorted(r.line_no for r in got) == [5]
    assert without_space_changes(_diff(spark, [])).collect() == []
