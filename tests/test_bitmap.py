"""Bitmaps of keys, and folding by digests."""

import pytest
from pyspark.sql import functions as F

from logsift.operators import bitmap as bm
from logsift.options import CleanOptions
from logsift.plans.clean import clean


def test_holds_all_its_keys(spark):
    held = spark.range(0, 3000, 7).select((F.col("id") % 11).cast("string").alias("a"), F.col("id").alias("b"))
    bits = bm.bitmap(held, "a", "b")
    tried = spark.range(3000).select((F.col("id") % 11).cast("string").alias("a"), F.col("id").alias("b"))
    got = tried.filter(bm.may_hold(bits.scalar(), "a", "b")).select("b").collect()
    known = {i for i in range(0, 3000, 7)}
    passed = {r.b for r in got}
    assert known <= passed and len(passed - known) <= 3


def test_empty_holds_nothing(spark):
    rows = spark.range(0)
    assert rows.select(F.lit(1)).count() == 0
    assert spark.range(500).filter(bm.may_hold(bm.bitmap(rows, "id").scalar(), "id")).count() == 0


def test_every_bit(spark):
    """Keys enough to touch all halves of bytes: bits as counted one by one."""
    held = spark.range(40_000)
    place = F.pmod(F.xxhash64("id"), F.lit(bm.BITS))
    want = {r[0] for r in held.select(place).distinct().collect()}
    text = bm.bitmap(held, "id").first()[0].decode()
    got = {8 * (i // 2) + b + 4 * (1 - i % 2) for i, c in enumerate(text) if c != "0" for b in range(4) if int(c, 16) >> b & 1}
    assert got == want


def _plan(table):
    return table._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("logs", [3, 300])
def test_cut_lies_below_the_line_shuffle(spark, as_lines, logs):
    body = "\n".join(["==10== Invalid read of size 4", "==10==    at 0x1: f (a.c:1)"] * 4 + ["Successfully downloaded debug", "==10== Invalid write of size 8"])
    lines = as_lines({f"log{i}": body for i in range(logs)})
    done = clean(lines, CleanOptions(depth=1, chunk_bits=4))
    assert done.count() == logs
    plan = _plan(done)
    # The marker's lines alone are read before: no limit, no broadcast of cuts.
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert "bitmap_construct_agg" in plan


def test_text_of_blocks_is_shuffled_once(spark, as_lines):
    lines = as_lines({"a": "==10== Invalid read of size 4\n==10==    at 0x1: f (a.c:1)\n" * 50})
    done = clean(lines, CleanOptions(depth=2, trim=False))
    plan = _plan(done)
    # Only the bits of the winners' numbers are sorted to be aggregated, no block.
    assert all("bitmap_construct_agg" in line for line in plan.splitlines() if "SortAggregate" in line)
    first = done.collect()
    assert [(r.block_no, r.repeats) for r in first] == [(1, 50)]


def test_repeats_over_chunks(spark, as_lines):
    """Blocks inside chunks and across their edges fold together."""
    block = ["==10== Invalid read of size 4", "==10==    at 0x1: f (a.c:1)", "==10==    by 0x2: g (b.c:2)"]
    lines = as_lines({"a": block * 40 + ["==10== Invalid write of size 1"] + block[1:], "b": block * 3})
    for bits in (4, 5, 6, 18):
        got = clean(lines, CleanOptions(depth=3, trim=False, chunk_bits=bits)).collect()
        assert sorted((r.log_id, r.block_no, r.repeats) for r in got) == [("a", 1, 40), ("a", 41, 1), ("b", 1, 3)]
