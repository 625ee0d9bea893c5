"""Near-duplicates by SimHash: fingerprints meet at the codewords of a covering code.

Anchors are the codewords of the Hamming code of length 63, with the last bit
free. It covers all 64-bit words with radius 1: each word is a codeword or one
bit from exactly one. Two fingerprints at most 2 bits apart have a word between
them that is at most 1 bit from both, so the codeword next to that word is at
most 2 bits from both. It is enough, then, to replicate a fingerprint to the
anchors within covering radius plus half the threshold: 33 of them, or 2 if it is
a codeword itself. (Radius plus the whole threshold would be 652 copies for the
same links.) Fingerprints at one anchor are at most 4 bits apart and there can be
no more than 2081 of them, whatever the size of the table; they are compared in
pairs there. Links are joined up to components.

Equal fingerprints are folded before all this, so exact copies cost nothing. A
null text counts as empty; a text without words has fingerprint zero and is
linked like any other. Repeated rows get the same answer each. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.components import components
from logsift.llm.tables import portions, without
from logsift.operators.bitmap import bitmap, may_hold
from logsift.sources.storage import saved

WORDS = 3
SEED = 42
THRESHOLD = 2
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 17


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of every run of words, of all words if there are fewer."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(b" ".join(parts), seed)] if parts else []
    join = b" ".join
    return [digest(join(run), seed) for run in zip(*(parts[i:] for i in range(words)), strict=False)]


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each segment the number of hashes with each bit set, lowest bit first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """Fingerprints as unsigned numbers: a bit is set if over half of the hashes have it."""
    counts = np.zeros((len(texts), 64), np.int64)
    sizes = np.zeros(len(texts), np.int64)
    held: list[int] = []
    rows: list[int] = []
    starts: list[int] = []

    def count() -> None:
        if held:
            np.add.at(counts, rows, _bit_counts(np.array(held, np.uint64), np.array(starts)))
            held.clear()
            rows.clear()
            starts.clear()

    for row, text in enumerate(texts):
        hashes = shingle_hashes(text or "")
        sizes[row] = len(hashes)
        for at in range(0, len(hashes), BLOCK):
            rows.append(row)
            starts.append(len(held))
            held += hashes[at : at + BLOCK]
            if len(held) >= BLOCK:
                count()
    count()
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return ((counts * 2 > sizes[:, None]) * weights).sum(axis=1, dtype=np.uint64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        values = fingerprints_of(batch.column("text").to_pylist()).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(values)], names=["doc_id", "mark", "fp"]
        )


def _mark() -> Column:
    return F.xxhash64("text", F.col("doc_id").isNull())


def _key() -> Column:
    """The id as a join key; `_mark` tells null ids from others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("key")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash that tells texts of one doc_id apart), fp."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), "text")
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, mark long, fp long")


def anchors(fp: Column) -> Column:
    """The codewords at most 2 bits from a fingerprint."""
    # Bit p-1 stands for position p; the syndrome is the xor of the positions set.
    parity = [sum(1 << (p - 1) for p in range(1, 64) if p >> k & 1) for k in range(6)]
    odd = [F.bit_count(fp.bitwiseAND(F.lit(mask))) % 2 for mask in parity]
    syndrome = sum((bit * (1 << k) for k, bit in enumerate(odd)), F.lit(0))
    flip = lambda position: F.call_function("shiftleft", F.lit(1).cast("long"), position - 1)
    highest = F.lit(-(1 << 63))
    # One flip at the syndrome, or two flips whose positions have it as their xor.
    one = fp.bitwiseXOR(flip(syndrome))
    two = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(63)), lambda p: p < p.bitwiseXOR(syndrome)),
        lambda p: fp.bitwiseXOR(flip(p)).bitwiseXOR(flip(p.bitwiseXOR(syndrome))),
    )
    near = F.when(syndrome == 0, F.array(fp)).otherwise(F.concat(F.array(one), two))
    other = F.when(syndrome == 0, fp).otherwise(one).bitwiseXOR(highest)
    return F.concat(near, F.array(other))


def links(distinct: DataFrame) -> DataFrame:
    """u < v, fingerprints at most 2 bits apart; a link may come from several anchors."""
    # Few bytes make many rows here, which Spark's merging of small partitions cannot know.
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By a hash of fp: rows that come dealt by fp itself would not be dealt again.
    placed = distinct.repartition(parts, F.xxhash64("fp")).select("fp", F.explode(anchors(F.col("fp"))).alias("anchor"))
    met = placed.groupBy("anchor").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
    firsts = met.select("members", F.explode("members").alias("u"))
    near = F.filter("members", lambda m: (m > F.col("u")) & (F.bit_count(m.bitwiseXOR(F.col("u"))) <= THRESHOLD))
    return firsts.select("u", F.explode(near).alias("v"))


def _joined(marked: DataFrame) -> DataFrame:
    """The fingerprint table with component_id."""
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct.select("fp")))
    own = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    own = own.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = own.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = own.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp", "left")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row.

    A component without any doc_id has a null component_id.
    """
    joined = _joined(saved(fingerprints(docs)))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return joined.select("doc_id", digits.alias("fingerprint"), "component_id")


def _kept(docs: DataFrame, marked: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows of the documents in `first`, a row repeated in full once; `marked` has doc_id and mark of all rows.

    Most rows stay and come once: only those that may be others are shuffled.
    """
    key = ["key", "mark"]
    stays = firsts.select(F.coalesce("first.doc_id", F.lit(-1)).alias("key"), F.col("first.mark").alias("mark"), F.lit(True).alias("stays"))
    counts = marked.groupBy(_key(), "mark").agg(F.count(F.lit(1)).alias("n"))
    others = saved(counts.join(stays, key, "left").filter(F.col("stays").isNull() | (F.col("n") > 1)))
    rows = docs.select(F.struct(*without(docs)).alias("doc"), _key(), _mark().alias("mark"))
    other = may_hold(bitmap(others, *key).scalar(), *key)
    left = rows.filter(other).join(others.filter(F.col("stays").isNull()), key, "left_anti")
    # Repeats are folded in every task first.
    return rows.filter(~other).select("doc.*").union(left.dropDuplicates(key).select("doc.*"))


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id."""
    marked = saved(fingerprints(docs))
    roots = components(links(marked.select("fp").distinct())).withColumnRenamed("node", "fp")
    rooted = marked.join(roots, "fp", "left").select("doc_id", "mark", F.coalesce("root", "fp").alias("root"))
    return _kept(docs, marked, rooted.groupBy("root").agg(_first()))


# --- similar texts -------------------------------------------------------------

SIMILARITY = 0.8
SIMILAR_WORDS = 5
#: Fingerprints of similar texts are cut into so many blocks of 15 bits.
BLOCKS = 10
#: Sample shingles that must be equal for the blocks of two sets to meet.
SAMPLES = 3
_BLOCK_BITS = 15
_LONGS = 3
#: Bits, of all blocks together, in which two similar texts may differ; see `drop_similar`.
FAR = 50
#: Shingles whose bits are counted at a time.
SOME = 1 << 14
# Odd constants that make further 64-bit hashes out of one, from the digits of the golden ratio.
_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 for k in range(BLOCKS * SAMPLES + 2)], np.uint64)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another hash of each hash."""
    x = (hashes ^ (hashes >> np.uint64(31))) * _MIX[k]
    x = (x ^ (x >> np.uint64(29))) * _MIX[0]
    return x ^ (x >> np.uint64(32))


def _wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """192 bits of SimHash over a set of shingles, as three longs; the blocks are its first 150 bits."""
    counts = np.zeros(64 * _LONGS, np.int64)
    for at in range(0, len(hashes), SOME):
        part = hashes[at : at + SOME]
        both = np.stack([_mixed(part, 1 + k) for k in range(_LONGS)], axis=1)
        counts += np.unpackbits(both.astype("<u8").view(np.uint8).reshape(-1, 8 * _LONGS), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8").view(np.int64).tolist()


def _sample(hashes: np.ndarray) -> list[int]:
    """For each block a hash of its sample: the shingles that come first by SAMPLES hashes of the block's own."""
    if not len(hashes):
        return [0] * BLOCKS
    first = np.array([_mixed(hashes, 2 + k).min() for k in range(BLOCKS * SAMPLES)], "<u8").reshape(BLOCKS, SAMPLES)
    return [xxhash.xxh64_intdigest(row.tobytes(), SEED) - 2**63 for row in first]


def _parity(hashes: np.ndarray) -> bytes:
    """For each of two to four times as many places as shingles, if an odd number of them falls there, as bits."""
    places = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    counts = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def _sorted_hashes(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text or "", words), np.uint64))


_SETS = "doc_id long, mark long, digest binary, size long, fp array<long>, samples array<long>, parity binary"


def _set_batches(words: int):
    """The set of a text's shingles: a 128-bit digest, size, wide fingerprint, a sample for each block, parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 500):
            digests, sizes, fps, samples, parities = [], [], [], [], []
            for text in batch.column("text"):
                hashes = _sorted_hashes(text.as_py(), words)
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                fps.append(_wide_fingerprint(hashes))
                samples.append(_sample(hashes))
                parities.append(_parity(hashes))
            longs = pa.list_(pa.int64())
            columns = [
                batch.column("doc_id"),
                batch.column("mark"),
                pa.array(digests, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(fps, longs),
                pa.array(samples, longs),
                pa.array(parities, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "digest", "size", "fp", "samples", "parity"])

    return run


def block_anchors(block: Column) -> Column:
    """The codewords of the Hamming code of length 15 at most 2 bits from a block: 8, or 1 if it is one itself."""
    parity = [sum(1 << (p - 1) for p in range(1, 16) if p >> k & 1) for k in range(4)]
    odd = [F.bit_count(block.bitwiseAND(F.lit(mask))) % 2 for mask in parity]
    syndrome = sum((bit * (1 << k) for k, bit in enumerate(odd)), F.lit(0))
    flip = lambda position: F.call_function("shiftleft", F.lit(1), position - 1)
    two = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(15)), lambda p: p < p.bitwiseXOR(syndrome)),
        lambda p: block.bitwiseXOR(flip(p)).bitwiseXOR(flip(p.bitwiseXOR(syndrome))),
    )
    return F.when(syndrome == 0, F.array(block)).otherwise(F.concat(F.array(block.bitwiseXOR(flip(syndrome))), two))


def _block(number: int) -> Column:
    """Bits 15 n and following of the wide fingerprint."""
    at, mask, part = number * _BLOCK_BITS, F.lit((1 << _BLOCK_BITS) - 1), F.col("fp")
    low = F.shiftrightunsigned(part[at // 64], at % 64)
    if at % 64 + _BLOCK_BITS > 64:
        low = low.bitwiseOR(F.shiftleft(part[at // 64 + 1], 64 - at % 64))
    return low.bitwiseAND(mask).cast("int")


def meetings(sets: DataFrame) -> DataFrame:
    """u < v: at every anchor each set with the one before it in an order of the block's own; pairs may repeat.

    An anchor is a codeword of one block, kept apart by the block's sample. A group of any
    size at an anchor makes one pair a member, and each block other pairs.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.array(*[F.struct(_block(b).alias("bits"), F.col("samples")[b].alias("sample")) for b in range(BLOCKS)])
    # Few bytes make many rows here, which Spark's merging of small partitions cannot know.
    spread = sets.repartition(parts, F.xxhash64("sid"))
    each = spread.select("sid", F.posexplode(blocks).alias("block", "at"))
    placed = each.select("sid", "block", "at.sample", F.explode(block_anchors(F.col("at.bits"))).alias("word"))
    # The last four bits name the block, so that no column of its own is shuffled.
    anchor = F.xxhash64("block", "sample", "word").bitwiseAND(F.lit(~15)).bitwiseOR(F.col("block"))
    dealt = placed.select(anchor.alias("anchor"), "sid").repartition(parts, "anchor")
    # One order for all anchors of a block, so that sets which meet at several are neighbours there again.
    order = Window.partitionBy("anchor").orderBy("turn", "sid")
    turned = dealt.withColumn("turn", F.xxhash64(F.col("anchor").bitwiseAND(F.lit(15)), "sid"))
    before = turned.withColumn("before", F.lag("sid").over(order))
    pair = before.filter(F.col("before").isNotNull())
    return pair.select(F.least("sid", "before").alias("u"), F.greatest("sid", "before").alias("v"))


def _ids(sets: DataFrame) -> DataFrame:
    """sid, and key and mark of the set's first document."""
    return sets.select("sid", F.coalesce("first.doc_id", F.lit(-1)).alias("key"), F.col("first.mark").alias("mark"))


def _near_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs u < v that sizes and fingerprints leave possible."""
    side = lambda name, n: sets.select(
        F.col("sid").alias(name), F.col("size").alias(f"n{n}"), F.col("fp").alias(f"f{n}")
    )
    both = pairs.distinct().join(side("u", 1), "u").join(side("v", 2), "v")
    apart = sum((F.bit_count(F.col("f1")[k].bitwiseXOR(F.col("f2")[k])) for k in range(_LONGS)), F.lit(0))
    sizes = F.least("n1", "n2") >= similarity * F.greatest("n1", "n2") - 1e-9
    return both.filter(sizes & (apart <= FAR)).select("u", "v")


def _hash_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 500):
            sets = [_sorted_hashes(t.as_py(), words).view(np.int64) for t in batch.column("text")]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            hashes = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column("sid"), hashes], names=["sid", "hashes"])

    return run


def _possible_batches(similarity: float):
    """Pairs whose parities leave the similarity possible: what differs in them differs in the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b, total in zip(batch.column("a"), batch.column("b"), batch.column("total").to_pylist(), strict=True):
                left, right = sorted((np.frombuffer(side.as_buffer(), np.uint8) for side in (a, b)), key=len)
                # The places of the smaller are those of the larger without their high bits.
                folded = np.bitwise_xor.reduce(right.reshape(-1, len(left)), axis=0)
                shared = (total - int(np.bitwise_count(left ^ folded).sum())) / 2
                good.append(shared >= similarity * (total - shared) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _possible(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs u, v without those that parities rule out; none that has the similarity is."""
    side = lambda name, n, parity: sets.select(
        F.col("sid").alias(name), F.col("size").alias(f"n{n}"), F.col("parity").alias(parity)
    )
    both = pairs.join(side("v", 2, "b"), "v").join(side("u", 1, "a"), "u")
    both = both.select("u", "v", "a", "b", (F.col("n1") + F.col("n2")).alias("total"))
    return both.mapInArrow(_possible_batches(similarity), "u long, v long")


def _hashes_of(wanted: DataFrame, docs: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """sid, hashes of the sets in `wanted`, whose sid comes once each."""
    # The text of a set is read where its first document is; other texts are not shuffled.
    ids = saved(_ids(sets).join(wanted, "sid", "left_semi"))
    rows = docs.select(_key(), _mark().alias("mark"), "text")
    likely = rows.filter(may_hold(bitmap(ids, "key", "mark").scalar(), "key", "mark"))
    found = likely.dropDuplicates(["key", "mark"]).join(ids, ["key", "mark"]).select("sid", "text")
    return saved(found.mapInArrow(_hash_batches(words), "sid long, hashes array<long>"))


def _similar(pairs: DataFrame, docs: DataFrame, sets: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs u, v whose shingle sets have the Jaccard similarity, counted in full."""
    pairs = saved(_possible(pairs, sets, similarity))
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
    hashes = _hashes_of(wanted, docs, sets, words)
    both = pairs.join(hashes.select(F.col("sid").alias("v"), F.col("hashes").alias("b")), "v")
    both = both.join(hashes.select(F.col("sid").alias("u"), F.col("hashes").alias("a")), "u")
    # Counted where the rows are: whole sets of many pairs would make large batches on their way to Python.
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(shared >= similarity * (F.size("a") + F.size("b") - shared) - 1e-9).select("u", "v")


# --- what fingerprints leave out -------------------------------------------------

#: One text of so many tells which shingles are common; only the work depends on it, no result.
ONE_OF = 16
#: Common shingles that are told apart at most.
COMMON = 1 << 16
#: Sets of a group that make a large one, and that its centre is made of; only the work depends on it, no result.
FEW = 16
#: Sets that are compared with one copy of their group's centre.
PART = 1024


def _shingle_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 500):
            sets = [_sorted_hashes(t.as_py(), words).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["token"])

    return run


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a part of all have, sorted, and in how many."""
    some = docs.select("text", _mark().alias("mark")).filter(F.pmod("mark", F.lit(ONE_OF)) == 0).dropDuplicates(["mark"])
    counts = some.select("text").mapInArrow(_shingle_batches(words), "token long").groupBy("token").count()
    most = counts.filter("count > 1").orderBy(F.desc("count")).limit(COMMON).toArrow()
    tokens = most.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], most.column("count").to_numpy()[order].astype(np.int32)


def _shared_least(size: Column, similarity: float) -> Column:
    """How many shingles a set of the size shares with any that is similar, at least."""
    return F.ceil(similarity * size - 1e-6)


def _prefix_batches(similarity: float, words: int, tokens: np.ndarray, counts: np.ndarray):
    """The shingles of a set, rarest first, up to the last that a similar set may have as its first shared one."""

    def prefix(hashes: np.ndarray) -> np.ndarray:
        length = min(len(hashes), len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1)
        seen = np.zeros(len(hashes), np.int32)
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
            seen = np.where(tokens[at] == hashes, counts[at], 0)
        # The hashes are sorted: equal counts stay in their order.
        return hashes[np.argsort(seen, kind="stable")[:length]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 500):
            sets = [prefix(_sorted_hashes(t.as_py(), words)) for t in batch.column("text")]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            heads = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("mark"), heads], names=["key", "mark", "prefix"])

    return run


def _places(docs: DataFrame, rooted: DataFrame, similarity: float, words: int) -> DataFrame:
    """Shingles of prefixes that sets of several roots have: token, sid, size, root, held, top, n.

    `held` is how many of them the set has, `top` the root of most sets at the shingle and `n` the number of these. Similar sets share a shingle of their prefixes: those in the one order of all shingles
    that come before the least number any similar set must share, and one more.
    `rooted` has sid, key, mark, size and root.
    """
    tokens, counts = _common(docs, words)
    rows = docs.select(_key(), _mark().alias("mark"), "text")
    heads = rows.mapInArrow(_prefix_batches(similarity, words, tokens, counts), "key long, mark long, prefix array<long>")
    # A set that is a root by itself carries no number twice.
    own = rooted.select("key", "mark", "sid", F.when(F.col("root") != F.col("sid"), F.col("root")).alias("root"))
    each = heads.join(own, ["key", "mark"]).select("sid", "root", F.explode("prefix").alias("token"))
    at, root = Window.partitionBy("token"), F.coalesce("root", "sid")
    several = each.withColumns({"low": F.min(root).over(at), "high": F.max(root).over(at)}).filter("low <> high")
    met = saved(several.select("token", "sid").distinct())
    held = met.groupBy("sid").agg(F.count(F.lit(1)).alias("held")).join(rooted.select("sid", "size", "root"), "sid")
    counted = met.join(held, "sid").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token", "root")))
    ranked = counted.withColumn("most", F.max(F.struct("n", "root")).over(at))
    return saved(ranked.select("token", "sid", "size", "root", "held", F.col("most.root").alias("top"), F.col("most.n").alias("n")))


def _may_be_similar(shared: Column, similarity: float, n2: Column | None = None) -> Column:
    """Whether sets of n1 and n2 shingles that share so many of their prefixes, or fewer, can be similar.

    What two sets share beyond the prefixes is no more than what one of them has there,
    so the shared shingles inside must make up the rest.
    """
    n1, n2 = F.col("n1"), F.col("n2") if n2 is None else n2
    sizes = F.least(n1, n2) >= similarity * F.greatest(n1, n2) - 1e-6
    beyond = F.greatest(*[F.greatest(_shared_least(n, similarity) - 1, F.lit(0)) for n in (n1, n2)])
    wanted = similarity / (1 + similarity) * (n1 + n2)
    return sizes & (shared + beyond >= wanted - 1e-6)


def _centres(members: DataFrame, hashes: DataFrame) -> DataFrame:
    """root, centre: the shingles that over half of some members have. Any other centre would give the same links."""
    place = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("sid"), "sid"))
    some = members.select("root", "sid", place.alias("place")).filter(F.col("place") <= FEW)
    held = some.join(hashes, "sid").select("root", F.explode("hashes").alias("token")).groupBy("root", "token").count()
    return held.filter(F.col("count") > FEW // 2).groupBy("root").agg(F.collect_list("token").alias("centre"))


def _links_to_groups(places: DataFrame, rooted: DataFrame, docs: DataFrame, sets: DataFrame, similarity: float, words: int):
    """(links, settled): u, v that join sets to groups of FEW sets or more, and the groups (root, settled) this was done for.

    A set that has a shingle with a group is compared with all sets of that group by what each
    has more and less than a centre that they share: what differs between two sets is what they differ
    from the centre, but for what both differ in. So sets that were edited in other
    places never meet, and how much two sets share comes out exactly. One link to a
    group is enough. A group for which this would be more work than its shingles makes is left to `_pairs_between`.
    """
    top = places.filter(F.col("n") >= FEW)
    work = top.groupBy(F.col("top").alias("root")).agg(F.sum(F.when(F.col("root") != F.col("top"), F.col("n"))).alias("work"))
    counts = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("small"), F.max("size").alias("large"))
    groups = saved(counts.join(work, "root"))
    # What sets share beyond their prefixes leaves most for members as small, or as large, as can be; rounding makes 1.
    met = top.filter(F.col("root") != F.col("top")).select("sid", F.col("top").alias("root"), F.col("size").alias("n1"), "held").distinct()
    met = met.join(groups, "root")
    lower, upper = F.greatest("small", similarity * F.col("n1")), F.least("large", F.col("n1") / similarity)
    likely = [_may_be_similar(F.col("held") + more, similarity, n2=n2) for n2, more in ((lower, 0), (upper, 1))]
    seekers = met.filter((lower <= upper + 1e-6) & (likely[0] | likely[1])).select("sid", "root", F.col("n1").alias("size"))
    members = rooted.join(groups.select("root"), "root", "left_semi").select("sid", "root", "size")
    sides = saved(seekers.withColumn("seeks", F.lit(1)).union(members.withColumn("seeks", F.lit(0))))
    hashes = _hashes_of(sides.select("sid").distinct(), docs, sets, words)
    # A centre goes to as many tasks as its group needs.
    parts = F.ceil(F.col("n") / PART).cast("int")
    centres = _centres(sides.filter("seeks = 0"), hashes).join(groups, "root", "right")
    centres = centres.select("root", F.coalesce("centre", F.array().cast("array<long>")).alias("centre"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = sides.join(groups.select("root", "n"), "root").withColumn("part", F.pmod(F.xxhash64("sid"), parts).cast("int"))
    both = dealt.join(hashes, "sid").join(centres, ["root", "part"])
    apart = F.concat(F.array_except("hashes", "centre"), F.array_except("centre", "hashes"))
    near = saved(both.select("root", "sid", "size", "seeks", apart.alias("apart")).withColumn("d", F.size("apart")))

    # Of a set and the member nearest to the centre, even if nothing were common to what they differ in.
    shared = lambda common: (F.col("n1") + F.col("n2") - F.col("d1") - F.col("d2") + 2 * common) / 2
    enough = lambda common: shared(common) >= similarity * (F.col("n1") + F.col("n2") - shared(common)) - 1e-9
    side = lambda seeks, n, *more: near.filter(F.col("seeks") == seeks).select(
        "root", F.col("sid").alias(f"s{n}"), F.col("size").alias(f"n{n}"), F.col("d").alias(f"d{n}"), *more
    )
    # Similar sets differ in no more than this part of their sizes, and in no less than their distances from the centre do.
    part = (1 - similarity) / (1 + similarity)
    first = F.min(F.struct((F.col("d2") - part * F.col("n2")).alias("spare"), "s2", "n2", "d2")).alias("first")
    bounds = side(0, 2).groupBy("root").agg(first, F.max(F.col("d2") + part * F.col("n2")).alias("far"))
    beside = F.col("d1") - part * F.col("n1")
    asked = side(1, 1, "apart").join(bounds.select("root", "first.*", "far"), "root").filter(beside <= F.col("far") + 1e-6)
    asked = saved(asked.select("root", "s1", "n1", "d1", "apart", F.when(enough(F.lit(0)), F.col("s2")).alias("s2")))

    # All others share some of what they differ in with any member they are similar to.
    others = asked.filter("s2 IS NULL")
    left = others.select("root", "s1", "n1", "d1", F.explode("apart").alias("token"))
    nearest = others.groupBy("root").agg(F.min(beside).alias("beside"))
    right = side(0, 2, "apart").join(nearest, "root").filter(F.col("d2") + part * F.col("n2") >= F.col("beside") - 1e-6)
    right = right.select("root", "s2", "n2", "d2", "beside", F.explode("apart").alias("token"))
    # A member must share with a set half of what their distances have beyond what similar sets may differ in.
    right = right.join(left.select("root", "token").distinct(), ["root", "token"])
    usable = F.count(F.lit(1)).over(Window.partitionBy("root", "s2"))
    right = right.withColumn("usable", usable).filter(2 * F.col("usable") >= F.col("d2") - part * F.col("n2") + F.col("beside") - 1e-6)
    right = saved(right.select("root", "s2", "n2", "d2", "token"))
    counted = left.groupBy("root", "token").agg(F.count(F.lit(1)).alias("a")).join(right.groupBy("root", "token").agg(F.count(F.lit(1)).alias("b")), ["root", "token"])
    costs = counted.groupBy("root").agg(F.sum(F.col("a") * F.col("b")).alias("cost"))
    settled = saved(groups.join(costs, "root", "left").filter(F.coalesce("cost", F.lit(0)) <= F.col("work")).select("root", F.lit(True).alias("settled")))
    met = left.join(settled, "root", "left_semi").join(right, ["root", "token"])
    met = met.filter(F.abs(F.col("d1") - F.col("d2")) <= part * (F.col("n1") + F.col("n2")) + 1e-6)
    common = met.groupBy("root", "s1", "n1", "d1", "s2", "n2", "d2").agg(F.count(F.lit(1)).alias("common"))
    found = common.filter(enough(F.col("common"))).groupBy("root", "s1").agg(F.min("s2").alias("s2"))
    links = asked.filter("s2 IS NOT NULL").select("s1", "s2").union(found.select("s1", "s2"))
    return saved(links.toDF("u", "v")), settled


def _pairs_between(places: DataFrame, rooted: DataFrame, settled: DataFrame, similarity: float) -> DataFrame:
    """All pairs u < v of different roots that may be similar and are not settled, by the shingles that their prefixes share."""
    known = places.join(settled.withColumnRenamed("root", "top"), "top", "left")
    done = F.coalesce("settled", F.lit(False)) & (F.col("n") >= FEW)
    # At each shingle the sets outside its largest group meet all others; that group's own sets do not meet each other.
    largest = F.col("root") == F.col("top")
    flags = known.filter(~(largest & done)).select("token", "sid", "size", "held", largest.alias("largest"))
    several = saved(flags.join(rooted.select("sid", "root"), "sid"))
    side = lambda rows, n: rows.select(
        "token", *[F.col(c).alias(f"{c}{n}") for c in ("sid", "root", "held", "largest")], F.col("size").alias(f"n{n}")
    )
    once = F.col("largest2") | (F.col("sid1") < F.col("sid2"))
    possible = _may_be_similar(F.least("held1", "held2"), similarity)
    both = side(several.filter(~F.col("largest")), 1).join(side(several, 2), "token")
    both = both.filter((F.col("root1") != F.col("root2")) & once & possible)
    # The sizes need not stay with their sets: all that is asked of them is the same both ways.
    pair = both.select(
        F.least("sid1", "sid2").alias("u"), F.greatest("sid1", "sid2").alias("v"), F.least("n1", "n2").alias("n1"), F.greatest("n1", "n2").alias("n2")
    )
    shared = pair.groupBy("u", "v", "n1", "n2").agg(F.count(F.lit(1)).alias("shared"))
    return shared.filter(_may_be_similar(F.col("shared"), similarity)).select("u", "v")


def _regrouped(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """The sets with the roots that links between them give."""
    group = lambda name: rooted.select(F.col("sid").alias(name), F.col("root").alias(f"{name}_root"))
    linked = links.join(group("u"), "u").join(group("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))
    joined = components(linked).select(F.col("node").alias("root"), F.col("root").alias("top"))
    grouped = rooted.join(joined, "root", "left").withColumn("root", F.coalesce("top", "root"))
    return saved(grouped.select(*rooted.columns))


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY, words: int = SIMILAR_WORDS) -> DataFrame:
    """One row of each group of similar texts, with all its columns: that of the smallest doc_id (null the largest).

    Texts are similar if the Jaccard similarity of their sets of shingles is at least the
    given one; groups are what links join up. Every link is checked on the whole sets, and
    none is left out. Most candidates come from fingerprints: of two texts with Jaccard 0.8 a bit differs with
    probability 0.15 (the angle between the sets over pi), a block in at most 2 bits
    with 0.59, and they have the same sample of 3 shingles with 0.51, so they meet at
    an anchor of one of 10 blocks with 0.97; with Jaccard 0.85 it is 0.995. At an anchor
    each set is compared with the one before it in a random order of the block's own,
    so a group of any size costs a fixed number of comparisons for each member; two that
    are no neighbours there are joined up through others or at other anchors. Candidates
    more than 50 of 192 bits apart are not checked here: 4 standard deviations above what
    Jaccard 0.8 gives.

    Links that fingerprints do not find are then found exactly among sets that are in no
    group together, where a rare shingle brings them together; a group's members are
    compared with each other no more. What a large group left out meets the group not in
    full but where both differ from its centre (`_links_to_groups`), other sets each other
    (`_pairs_between`). The shingles come rarest first, so few sets meet at one; sets in no
    group that have hardly any but common shingles and are not similar, and sets that
    differ from a centre in the same places, still cost the square of their number.

    Equal sets are folded by a digest of 128 bits. Texts without words have the empty
    set and are equal to each other; null counts as empty. Rows repeated in full, id and
    text, are one document; rows of one id with different texts are told apart by the
    text. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), "text")
    marked = saved(rows.mapInArrow(_set_batches(words), _SETS))
    facts = [F.min(n).alias(n) for n in ("size", "fp", "samples", "parity")]
    sets = marked.groupBy("digest").agg(_first(), *facts)
    sets = saved(sets.withColumn("sid", F.monotonically_increasing_id()))
    near = _near_pairs(meetings(sets), sets, similarity)
    roots = components(_similar(near, docs, sets, similarity, words)).withColumnRenamed("node", "sid")
    rooted = _ids(sets).join(sets.select("sid", "size", "first"), "sid").join(roots, "sid", "left")
    rooted = saved(rooted.withColumn("root", F.coalesce("root", "sid")))
    places = _places(docs, rooted, similarity, words)
    # Links of single sets to groups, then between what is left, then groups of groups.
    linked, settled = _links_to_groups(places, rooted, docs, sets, similarity, words)
    rooted = _regrouped(rooted, linked)
    between = _similar(_pairs_between(places, rooted, settled, similarity), docs, sets, similarity, words)
    return _kept(docs, marked, _regrouped(rooted, between).groupBy("root").agg(F.min("first").alias("first")))
