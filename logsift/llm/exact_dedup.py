"""Exact duplicates: frequent digests are settled map-side, the others by a shuffle.

1. Every task keeps a Misra-Gries summary of the digests it reads; the summaries
   are added up and the largest counters become candidates.
2. One aggregation counts the candidates exactly and finds the row that stays.
   These verified winners, at most `counters` rows, are broadcast.
3. All rows of a winner's group are labelled (or, but for the one that stays,
   dropped) where they are read. The other rows meet in a shuffle by digest; a group
   there is below about 1/counters of all rows.

Equal means: the same SHA-256 of the text, null counting as the empty text. Of a
group the largest doc_id stays, null being the smallest. If that doc_id occurs
more than once in the group (repeated rows), exactly one of those rows stays: rows
get a place, and the largest place wins. A third of all rows may be one row
repeated. An empty table gives an empty result. Extra columns are kept by
`drop_copies`, which takes any one of the repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.tables import without
from logsift.sources.storage import saved

COUNTERS = 4096


def text_digest() -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def _summary(counters: int):
    """Misra-Gries over one task: at most `counters` digests with a lower bound of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for pair in batch.column(0).value_counts():
                digest = pair["values"].as_py()
                counts[digest] = counts.get(digest, 0) + pair["counts"].as_py()
            if len(counts) > counters:
                # Taking the count of rank counters + 1 off all counters is the same
                # as that many single Misra-Gries decrements.
                cut = sorted(counts.values(), reverse=True)[counters]
                counts = {d: n - cut for d, n in counts.items() if n > cut}
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                names=["digest", "at_least"],
            )

    return run


def frequent_digests(keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` digests; each with over rows/counters + rows/1000 rows is among them."""
    found = keys.select("digest").mapInArrow(_summary(counters), "digest binary, at_least long")
    total = found.groupBy("digest").agg(F.sum("at_least").alias("at_least"))
    return total.orderBy(F.desc("at_least"), "digest").limit(counters).select("digest")


def winners(keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Of each candidate met more than once: exact number of rows, the doc_id and the place that stay."""
    hot = keys.join(F.broadcast(frequent_digests(keys, counters)), "digest", "left_semi")
    exact = hot.groupBy("digest").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "place")).alias("stays")
    )
    return saved(exact.filter("rows > 1").select("digest", "rows", F.col("stays.doc_id").alias("stays"), "stays.place"))


def _keys(docs: DataFrame) -> DataFrame:
    """doc_id, digest and place of every row; saved, so that places stay what they are."""
    return saved(docs.select("doc_id", text_digest().alias("digest"), F.monotonically_increasing_id().alias("place")))


def label_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    The text is read once; digests and ids, 48 bytes a row, are saved for the passes.
    """
    keys = _keys(docs)
    won = winners(keys, counters).withColumnRenamed("place", "stays_at")
    marked = keys.join(F.broadcast(won), "digest", "left")
    settled = F.col("rows").isNotNull()
    copies = marked.filter(settled).select(
        "doc_id",
        "digest",
        F.col("stays").alias("keep_id"),
        F.col("rows").alias("group_size"),
        (F.col("place") == F.col("stays_at")).alias("kept"),
    )
    group = Window.partitionBy("digest")
    first = group.orderBy(F.desc_nulls_last("doc_id"), F.desc("place"))
    others = marked.filter(~settled).select(
        "doc_id",
        "digest",
        F.max("doc_id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(first) == 1).alias("kept"),
    )
    labelled = copies.unionByName(others)
    return labelled.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with all their columns; a table of one row per text."""
    won = winners(_keys(docs), counters).select("digest", "rows", "stays")
    rows = docs.select(F.struct(*without(docs)).alias("doc"), "doc_id", text_digest().alias("digest"))
    marked = rows.join(F.broadcast(won), "digest", "left")
    # A winner's row that is repeated in full: folded in every task first, so that one a task travels.
    hot = marked.filter(F.col("rows").isNotNull() & F.col("doc_id").eqNullSafe(F.col("stays")))
    hot = hot.dropDuplicates(["digest"]).select("doc")
    order = Window.partitionBy("digest").orderBy(F.desc_nulls_last("doc_id"))
    ranked = marked.filter(F.col("rows").isNull()).select("doc", F.row_number().over(order).alias("place"))
    return hot.unionByName(ranked.filter("place = 1").select("doc")).select("doc.*")
