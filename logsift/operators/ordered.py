"""Ordered work on groups of any size.

A window over a whole group puts the group into one task. Here a group is cut
into chunks (runs of order values), one small row of totals is kept per chunk,
the totals are summed up over the chunks, and the rows only ever meet the rows
of their own chunk. Rows are shuffled once, by (group, chunk).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUN = (W.unboundedPreceding, W.currentRow)
BEFORE = (W.unboundedPreceding, -1)


def chunk_of(order: Column, bits: int) -> Column:
    """Chunk of a 64-bit order value: a run of 2**bits values."""
    return F.shiftright(order.cast("long"), bits)


def running(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    totals: bool = False,
    inclusive: bool = True,
    bits: int = 18,
    few_chunks: bool = True,
) -> DataFrame:
    """Add running sums and running maxima per group; keys must not be null.

    `order` is a long column without repeats inside a group. With `totals`, the
    value over the whole group is added as `<name>_total`. `few_chunks` says
    that there are far fewer (group, chunk) pairs than rows.
    """
    keys = list(keys)
    jobs = {n: (F.sum, c.cast("long")) for n, c in (sums or {}).items()}
    jobs |= {n: (F.max, c) for n, c in (maxes or {}).items()}
    tagged = rows.withColumn("_chunk", chunk_of(F.col(order), bits)).withColumns(
        {f"_v_{n}": c for n, (_, c) in jobs.items()}
    )
    chunks = tagged.groupBy(*keys, "_chunk").agg(
        *[f(f"_v_{n}").alias(f"_c_{n}") for n, (f, _) in jobs.items()]
    )
    group = W.partitionBy(*keys)
    before = group.orderBy("_chunk").rowsBetween(*BEFORE)
    offsets = chunks.select(
        *keys,
        "_chunk",
        *[f(f"_c_{n}").over(before).alias(f"_o_{n}") for n, (f, _) in jobs.items()],
        *[f(f"_c_{n}").over(group).alias(f"{n}_total") for n, (f, _) in jobs.items() if totals],
    )
    if few_chunks:
        # Hash join: one shuffle of the rows serves the join and the window.
        offsets = offsets.hint("shuffle_hash")
    frame = RUN if inclusive else BEFORE
    inside = W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(*frame)

    def value(name: str) -> Column:
        function, _ = jobs[name]
        offset, own = F.col(f"_o_{name}"), function(f"_v_{name}").over(inside)
        if function is F.sum:
            return F.coalesce(offset, F.lit(0)) + F.coalesce(own, F.lit(0))
        return F.greatest(offset, own)

    return tagged.join(offsets, [*keys, "_chunk"]).select(
        *rows.columns,
        *[value(n).alias(n) for n in jobs],
        *[f"{n}_total" for n in jobs if totals],
    )


def range_buckets(rows: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Add `_bucket`, the place of `key` among sampled bounds; keys do not repeat.

    All rows of a bucket come before all rows of the next. The bounds are at
    most `buckets` keys with the smallest hashes, so they are the same on every
    run and fit one row, whatever the size of the table. A group of
    rows, however large, is spread over the buckets its keys fall into. By
    default there are four for each shuffle partition.
    """
    if buckets is None:
        buckets = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = (
        rows.select(key)
        .orderBy(F.xxhash64(key), key)
        .limit(buckets)
        .agg(F.sort_array(F.collect_list(key)))
    )
    below = F.filter("_bounds", lambda bound: bound <= F.col(key))
    placed = rows.withColumn("_bounds", bounds.scalar())
    # Never null, so that a join on the bucket infers no null test: Spark would
    # push the test, and with it the whole search, below the making of `key`.
    bucket = F.coalesce(F.size(below), F.lit(0))
    return placed.withColumn("_bucket", bucket).drop("_bounds")
