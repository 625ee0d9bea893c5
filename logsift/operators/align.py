"""Alignment of the two sides of a hunk: patience anchors, then longest common subsequences."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import WHITE
from logsift.operators.ordered import running

Pairs = list[tuple[int, int]]


def _ends_of_prefixes(left: Sequence[int], right: Sequence[int]) -> np.ndarray:
    """The LCS length of left and each prefix of right, the empty one first; a machine word takes 64 of right at a time."""
    where: dict[int, int] = {}
    for place, item in enumerate(right):
        where[item] = where.get(item, 0) | 1 << place
    full = (1 << len(right)) - 1
    state = full
    for item in left:
        met = state & where.get(item, 0)
        state = ((state + met) | (state - met)) & full
    # A zero stands where the length grows by one.
    raw = np.frombuffer(state.to_bytes(len(right) // 8 + 1, "little"), np.uint8)
    bits = np.unpackbits(raw, bitorder="little")[: len(right)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(left: Sequence[int], right: Sequence[int]) -> Pairs:
    """Places of a longest common subsequence, by halving the left side; memory grows with the sides, not their product."""
    out: Pairs = []
    waiting = [(0, len(left), 0, len(right))]
    while waiting:
        a, b, c, d = waiting.pop()
        while a < b and c < d and left[a] == right[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        if b - a == 1:
            found = next((j for j in range(c, d) if right[j] == left[a]), None)
            if found is not None:
                out.append((a, found))
            continue
        middle = (a + b) // 2
        first = _ends_of_prefixes(left[a:middle], right[c:d])
        last = _ends_of_prefixes(left[middle:b][::-1], right[c:d][::-1])[::-1]
        cut = c + int((first + last).argmax())
        waiting += [(a, middle, c, cut), (middle, b, cut, d)]
    return sorted(out)


def patience(left: Sequence[int], right: Sequence[int]) -> Pairs:
    """Places of items that stand once on each side and keep their order: a longest rising run of them."""
    once_left, once_right = Counter(left), Counter(right)
    place = {item: j for j, item in enumerate(right) if once_right[item] == 1}
    both = [(i, place[item]) for i, item in enumerate(left) if once_left[item] == 1 and item in place]
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(both)
    for k, (_, j) in enumerate(both):
        at = bisect_left(tops, j)
        before[k] = ends[at - 1] if at else -1
        tops[at : at + 1], ends[at : at + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(both[k])
        k = before[k]
    return out[::-1]


def aligned(left: Sequence[int], right: Sequence[int]) -> Pairs:
    """Anchors, and between each two of them a longest common subsequence."""
    out: Pairs = []
    i = j = 0
    for a, b in [*patience(left, right), (len(left), len(right))]:
        out += [(i + x, j + y) for x, y in common(left[i:a], right[j:b])]
        if a < len(left):
            out.append((a, b))
        i, j = a + 1, b + 1
    return out


def _cancelled(table: pa.Table) -> pa.Table:
    """line_no of the lines of a hunk that have a partner."""
    ordered = table.sort_by("line_no")
    minus = np.array(ordered.column("minus").to_pylist(), bool)
    lines = ordered.column("line_no").to_numpy()
    digests = ordered.column("digest").to_numpy()
    removed, added = np.flatnonzero(minus), np.flatnonzero(~minus)
    pairs = aligned(digests[removed].tolist(), digests[added].tolist())
    gone = np.concatenate([removed[[i for i, _ in pairs]], added[[j for _, j in pairs]]]) if pairs else np.zeros(0, np.int64)
    key = ["_range", "_path", "_hunk"]
    columns = [pa.repeat(ordered.column(k)[0], len(gone)) for k in key]
    return pa.table([*columns, pa.array(lines[gone])], names=[*key, "line_no"])


def without_space_changes(diff_lines: DataFrame, bits: int = 18) -> DataFrame:
    """Lines that are left when white space does not count: the two sides of every hunk are aligned.

    Removed and added lines whose texts without white space are aligned cancel out. A
    line that moved past others stays, and so do equal lines of different hunks. A hunk
    is what `hunk` says, if there is such a column, else a run of changed lines without
    another line between. Other lines pass. Lines without a range or path are taken as one
    file. line_no must not repeat in a file.

    Only hunks in which some text stands on both sides are aligned; of these, 24 bytes
    a line meet in one task, so a hunk must fit one in that form.
    """
    kept = diff_lines.columns
    signed = F.coalesce(F.col("sign").isin("+", "-"), F.lit(False))
    key = ["_range", "_path"]
    keyed = diff_lines.withColumns(
        {
            # A letter before what is there, so that null is told from empty.
            "_range": F.coalesce(F.concat(F.lit("r"), "range_id"), F.lit("")),
            "_path": F.coalesce(F.concat(F.lit("p"), "path"), F.lit("")),
        }
    )
    if "hunk" in kept:
        numbered = keyed.withColumn("_hunk", F.coalesce(F.col("hunk").cast("long"), F.lit(-1)))
    else:
        numbered = running(keyed, key, "line_no", sums={"_hunk": ~signed}, bits=bits, few_chunks=False)
    hunk = [*key, "_hunk"]
    changed = numbered.filter(signed).select(
        *hunk,
        "line_no",
        (F.col("sign") == "-").alias("minus"),
        F.xxhash64(F.coalesce(F.regexp_replace("text", rf"{WHITE}+", ""), F.lit(""))).alias("digest"),
    )
    shared = changed.groupBy(*hunk, "digest").agg(F.min("minus").alias("least"), F.max("minus").alias("most"))
    worth = shared.filter(F.col("least") != F.col("most")).select(*hunk).distinct()
    gone = (
        changed.join(worth, hunk, "left_semi")
        .groupBy(*hunk)
        .applyInArrow(_cancelled, "_range string, _path string, _hunk long, line_no long")
    )
    left = numbered.filter(signed).join(gone, [*hunk, "line_no"], "left_anti").select(*kept)
    return left.unionByName(diff_lines.filter(~signed))

