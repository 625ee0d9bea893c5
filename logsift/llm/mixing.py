"""Mixing of sources to target weights by Poisson replication.

A source's repetition rate is its target share of the bytes to be drawn over the
bytes it has. A document is taken as often as a Poisson variable with that mean
says: a uniform number, a hash of seed and id, is put through the inverse of the
distribution. The copies are then dealt out and sorted by a hash of id and copy, so
that the result is in one global random order, `shuffle_key`.

Drawing is the feature: a copy count may be zero. The same seed, ids and sources
give the same result wherever it runs. Null text has no bytes; a null source is a
source of its own; null ids count as the empty text. Rows repeated with the same
id get the same number of copies each, and copies of them are numbered apart only
within the row. An empty table gives an empty result. Extra columns are kept;
columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.tables import uniform, without
from logsift.sources.storage import saved

SEED = "mix-1"
EXPONENT = 0.7
#: Up to so many sources the table of rates is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: And so many entries in its tables of quantiles, 8 bytes each.
BROADCAST_ENTRIES = 1_000_000


def rates(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    exponent: float = EXPONENT,
    total_bytes: int | None = None,
) -> DataFrame:
    """source, rate. Bytes are those of the text plus one for each document.

    weights: target share by source, others get none; by default a source weighs its
    bytes to the power of the exponent. total_bytes: how much to draw, by default
    what there is.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    held = docs.groupBy("source").agg(F.sum(size).alias("bytes"))
    if weights is None:
        weighed = held.withColumn("weight", F.pow("bytes", F.lit(float(exponent))))
    else:
        given = F.lit(0.0)
        for name, weight in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(given)
        weighed = held.withColumn("weight", given)
    weighed = saved(weighed)
    held_bytes, all_weights = weighed.agg(F.sum("bytes"), F.sum("weight")).first()
    if not all_weights:
        return weighed.select("source", F.lit(0.0).alias("rate"))
    total = float(held_bytes if total_bytes is None else total_bytes)
    rate = F.lit(total) * F.col("weight") / F.lit(float(all_weights)) / F.col("bytes")
    return weighed.select("source", rate.alias("rate"))


def quantiles(rated: DataFrame) -> DataFrame:
    """source, rate, steps: the distribution function of the source's Poisson variable at 0, 1, ..."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    terms = rated.select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    logs = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(upto)
    power = F.when(F.col("k") == 0, 0.0).otherwise(F.col("k") * F.log("rate"))
    chance = F.when(F.col("rate") > 0, F.exp(power - F.col("rate") - logs)).otherwise((F.col("k") == 0).cast("double"))
    points = terms.withColumn("chance", chance).withColumn("upto", F.sum("chance").over(upto))
    steps = points.groupBy("source", "rate").agg(F.sort_array(F.collect_list("upto")).alias("steps"))
    return steps


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    exponent: float = EXPONENT,
    total_bytes: int | None = None,
    seed: str = SEED,
) -> DataFrame:
    """The documents' columns with rate, copies, copy_no (from 0) and shuffle_key, in shuffled order."""
    table = saved(quantiles(rates(docs, weights, exponent, total_bytes)))
    sources, entries = table.agg(F.count(F.lit(1)), F.sum(F.size("steps"))).first()
    small = sources <= BROADCAST_SOURCES and (entries or 0) <= BROADCAST_ENTRIES
    table = table.select(F.col("source").alias("of"), "rate", "steps")
    rows = docs.select(
        F.struct(*without(docs, "rate", "copies", "copy_no", "shuffle_key")).alias("doc"), "doc_id", "source"
    )
    met = rows.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col("of")))
    drawn = uniform(seed, F.col("doc_id"))
    counted = met.select("doc", "doc_id", "rate", F.size(F.filter("steps", lambda p: p <= drawn)).alias("copies"))
    copies = counted.filter("copies > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy_no")
    )
    key = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy_no"), 256)
    keyed = copies.withColumn("shuffle_key", F.substring(key, 1, 16))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select("doc.*", "rate", "copies", "copy_no", "shuffle_key")
