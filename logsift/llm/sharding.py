"""Sharding by a tree of regions, racks and shards with weighted hash draws.

A document descends the tree: on every level each child draws -ln(u) / weight, u
being a hash of the document's id and the child's name, and the least draw wins.
The weight of a child is the sum of the shards below it. A child's draws depend on
nothing but its own name and weight, so a change of weights moves rows only into
or out of the subtrees whose weights change; siblings elsewhere keep theirs.

The law is `key`: the id and the number of shards decide. In such a tree a shard
put under a region that already stands would also pull rows from other regions to
its neighbours in that region. One more shard therefore opens a region and rack of
its own, and takes rows only into itself; `topology` places every shard beyond the
first `base` that way. `base` is the number of shards a store began with; it stays
what it is when shards are added.

A null id counts as the empty text, a null text as no bytes and the crc32 of the
empty text. Repeated rows get the same shard and different slots. An empty table
gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.tables import uniform

BASE = 8
REGIONS = 2
RACKS = 2
#: Parts of a shard whose rows are numbered apart.
BUCKETS = 4096


@dataclass(frozen=True)
class Place:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, base: int = BASE, regions: int = REGIONS, racks: int = RACKS) -> list[Place]:
    """The first `base` shards dealt over regions and racks; each further one in a region of its own."""
    first = min(shards, base)
    per_region = -(-first // regions)
    per_rack = -(-per_region // racks)
    dealt = [Place(s // per_region, s % per_region // per_rack, s) for s in range(first)]
    return dealt + [Place(regions + s - base, 0, s) for s in range(base, shards)]


def _tree(places: list[Place]) -> dict[str, list[tuple[str, float, int]]]:
    """Children of each node: name, weight, and the shard of a leaf."""
    children: dict[str, dict[str, list]] = {}
    for p in places:
        path = ""
        for level in ("region", "rack", "shard"):
            name = f"{path}/{level}{getattr(p, level)}"
            child = children.setdefault(path, {}).setdefault(name, [0.0, p.shard])
            child[0] += p.weight
            path = name
    return {path: [(n, w, s) for n, (w, s) in sorted(below.items())] for path, below in children.items()}


def _winner(key: Column, children: Column) -> Column:
    """The child with the least draw; of equal draws the one first by name."""

    def drawn(c: Column) -> Column:
        # 1 - u lies in (0, 1], so the logarithm is finite.
        draw = -F.log(1 - uniform(c["name"], key)) / c["weight"]
        return F.struct(draw.alias("draw"), c["name"].alias("name"), c["shard"].alias("shard"))

    return F.array_min(F.transform(children, drawn))


def shard_of(key: Column, places: list[Place]) -> Column:
    """The shard that a key descends to. Places of weight zero take nothing."""
    tree = _tree([p for p in places if p.weight > 0])

    def listed(path: str) -> Column:
        fields = ("name", "weight", "shard")
        return F.array(*(F.struct(*(F.lit(v).alias(f) for f, v in zip(fields, c, strict=True))) for c in tree[path]))

    below = F.create_map(*(x for path in tree if path for x in (F.lit(path), listed(path))))
    won = _winner(key, listed(""))
    for _ in range(2):
        won = _winner(key, F.element_at(below, won["name"]))
    return won["shard"]


def assign(docs: DataFrame, shards: int = BASE, base: int = BASE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    A store that began with fewer shards than `base` and has had no more since began
    with `shards`. Slots count the rows of a shard from 0 without gaps, in the order of a
    hash bucket of id, crc32 and size, the id, crc32 and size. They come from counts per bucket, so no
    task holds a shard; equal rows are counted before they are shuffled and take
    their slots from one count.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    distinct = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    key, base = F.col("doc_id"), min(base, shards)
    placed = distinct.withColumns(
        {
            "shard": shard_of(key, topology(shards, base)).cast("int"),
            "grown_shard": shard_of(key, topology(shards + 1, base)).cast("int"),
            "bucket": F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(BUCKETS)),
        }
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    before = F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    ranked = placed.withColumn("before", F.coalesce(before, F.lit(0)))
    sizes = placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("held"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    numbered = ranked.join(starts, ["shard", "bucket"]).select("*", copies)
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("before") + F.col("copy")).alias("slot"),
        "grown_shard",
    )
