"""A set of keys in a bitmap of fixed size: a test that may say yes too often, never no.

The bitmap is one value, whatever the number of keys, so it can be a scalar that is
tested where rows are read, below any shuffle. An exact join behind it drops what
the test let through. With so many keys that all bits are set it lets all rows
through and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^23 bits take 1 MiB; a tenth of them is set by about 900,000 keys.
BITS = 1 << 23
#: Bits in what Spark's bitmap aggregate makes.
_SLICE = 1 << 15
_NO_BITS = "00" * (_SLICE // 8)


def _place(keys: tuple[Column | str, ...]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def bitmap(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """One row, one column: the bits of all keys, as a binary of hexadecimal digits."""
    place = F.col("_place")
    number = F.floor(place / _SLICE).cast("int")
    slices = rows.select(_place(keys).alias("_place")).groupBy(number.alias("slice")).agg(
        F.bitmap_construct_agg(place % _SLICE).alias("bits")
    )
    known = F.map_from_entries(F.collect_list(F.struct("slice", F.hex("bits").alias("bits"))))
    every = F.sequence(F.lit(0), F.lit(BITS // _SLICE - 1))
    whole = slices.agg(known.alias("known")).select(
        F.array_join(F.transform(every, lambda i: F.coalesce(F.try_element_at("known", i), F.lit(_NO_BITS))), "")
    )
    return whole.toDF("bits").select(F.col("bits").cast("binary").alias("bits"))


def may_hold(bits: Column, *keys: Column | str) -> Column:
    """Whether the bitmap has the key's bit."""
    place = _place(keys)
    bit = place.bitwiseAND(F.lit(7))
    # The high half of a byte is its first digit.
    digit = F.shiftright(place, 3) * 2 + (bit < 4).cast("long") + 1
    code = F.ascii(F.substring(bits, digit.cast("int"), F.lit(1)).cast("string"))
    value = code - F.when(code > 64, 55).otherwise(48)
    return F.call_function("shiftright", value, bit.bitwiseAND(F.lit(3)).cast("int")).bitwiseAND(F.lit(1)) == 1
