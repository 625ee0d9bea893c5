"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that the parts decide: 52 bits of the SHA-256 of their texts.

    Null parts count as empty. The same value can be had in SQL dialects that have
    SHA-256 in hexadecimal.
    """
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    digits = F.substring(F.sha2(F.concat_ws(":", *texts), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(2**52))


def without(table: DataFrame, *names: str) -> list[Column]:
    """The table's columns but those that an operator is going to add."""
    taken = {n.lower() for n in names}
    return [table[f"`{c}`"] for c in table.columns if c.lower() not in taken]


def extended(table: DataFrame, added: dict[str, str]) -> T.StructType:
    """The table's schema with columns more, name and type."""
    more = [T.StructType.fromDDL(f"{name} {kind}").fields[0] for name, kind in added.items()]
    return T.StructType([*table.schema.fields, *more])


#: Texts, and bytes of text, that a task works on at a time.
ROWS = 2000
BYTES = 4 << 20


def portions(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what a task makes of one stays small.

    Each has at most so many rows and bytes of text; a row with more is one by itself.
    """
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
        held = np.zeros(batch.num_rows + 1, np.int64)
        for column in texts:
            held[1:] += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(held), 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[at] + size, "right")) - 1
            stop = max(min(stop, at + rows), at + 1)
            yield batch.slice(at, stop - at)
            at = stop


def crc_mod(key: str, divisor: int) -> Column:
    """crc32 of an id written as text, modulo the divisor; a null id counts as the empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(divisor))
