"""Tag tables (repo, tag, points_at_head): order, newest, pruning, checks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsift.functions.paths import glob_regex
from logsift.functions.versions import (
    is_core,
    is_prerelease,
    matches_release_prefix,
    refname_key,
    version_key,
)
from logsift.operators.ordered import range_buckets, running
from logsift.sources.storage import saved


def matching(tags: DataFrame, glob: str = "*") -> DataFrame:
    return tags.filter(F.col("tag").rlike(glob_regex(glob)))


def tag_counts(tags: DataFrame, glob: str = "*") -> DataFrame:
    return matching(tags, glob).groupBy("repo").agg(F.count("*").alias("total_tags"))


def _ordered(tags: DataFrame) -> DataFrame:
    """Tags with `_key`, their place by repo and version, and its bucket."""
    key = F.concat_ws("\x01", "repo", refname_key(F.col("tag")), "tag")
    # The key takes part in the distinct, so it is made once per tag. Saved: rows, bounds
    # and sizes are all made of it.
    named = saved(tags.select("repo", "tag", key.alias("_key")).distinct())
    return range_buckets(named, "_key")


def version_order(tags: DataFrame) -> DataFrame:
    """Tags of every repo numbered from the newest: repo, tag, place."""
    bucketed = _ordered(tags)
    sizes = bucketed.groupBy("repo", "_bucket").agg(F.count("*").alias("_size"))
    # At most one row per repo and bucket.
    newer = W.partitionBy("repo").orderBy(F.col("_bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select("repo", "_bucket", F.coalesce(F.sum("_size").over(newer), F.lit(0)).alias("_base"))
    inside = W.partitionBy("repo", "_bucket").orderBy(F.col("_key").desc())
    joined = bucketed.join(base.hint("shuffle_hash"), ["repo", "_bucket"])
    return joined.select("repo", "tag", (F.col("_base") + F.row_number().over(inside)).alias("place"))


def previous_tags(tags: DataFrame) -> DataFrame:
    """Every tag with the next older one of its repo, null for the oldest."""
    bucketed = _ordered(tags)
    last = F.max(F.struct("_key", "tag")).alias("_newest")
    newest = bucketed.groupBy("repo", "_bucket").agg(last)
    # At most one row per repo and bucket.
    older = W.partitionBy("repo").orderBy("_bucket")
    edge = newest.select("repo", "_bucket", F.lag("_newest").over(older).alias("_edge"))
    inside = W.partitionBy("repo", "_bucket").orderBy("_key")
    joined = bucketed.join(edge.hint("shuffle_hash"), ["repo", "_bucket"])
    previous = F.coalesce(F.lag("tag").over(inside), F.col("_edge.tag"))
    return joined.select("repo", "tag", previous.alias("previous_tag"))


def latest_tags(tags: DataFrame, prefix: str = "v") -> DataFrame:
    """Newest release tag of every repo: prefix, then N.N.N."""
    releases = tags.filter(matches_release_prefix(F.col("tag"), prefix))
    newest = F.max(F.struct(refname_key(F.col("tag")).alias("key"), F.col("tag")))
    return releases.groupBy("repo").agg(newest.alias("last")).select("repo", "last.tag")


def prune(
    tags: DataFrame,
    keep: int = 10,
    glob: str = "*",
    protect: Sequence[str] = (),
    protect_head: bool = True,
    protect_table: DataFrame | None = None,
) -> DataFrame:
    """Tags to delete: all but the newest `keep` of each repo and the protected.

    The newest tags come from the places of `version_order`, which spreads a repo
    over buckets; the rest is an anti join on (repo, tag). A tag not known to
    point at the head is not protected. `protect_table` has globs by repo: repo, glob.
    """
    if keep < 0:
        raise ValueError("keep must not be negative")
    candidates = matching(tags, glob)
    rest = candidates
    if keep:
        kept = version_order(candidates).filter(F.col("place") <= keep).select("repo", "tag")
        rest = candidates.join(kept, ["repo", "tag"], "left_anti")
    if protect:
        rest = rest.filter(~F.col("tag").rlike("|".join(f"(?:{glob_regex(g)})" for g in protect)))
    if protect_table is not None:
        rest = rest.join(matching_globs(rest, protect_table), ["repo", "tag"], "left_anti")
    if protect_head:
        rest = rest.filter(~F.coalesce("points_at_head", F.lit(False)))
    return rest.select("repo", "tag")


_WILD = re.compile(r"[*?\[]")


def _glob_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """repo, side, literal, regex: what a glob begins with, else ends with, else nothing."""
    for batch in batches:
        sides, literals, regexes = [], [], []
        for glob in batch.column("glob").to_pylist():
            first = _WILD.search(glob)
            head = glob[: first.start()] if first else glob
            tail = re.split(r"[*?\]]", glob)[-1] if first and "[" not in re.split(r"[*?\]]", glob)[-1] else ""
            side, literal = ("head", head) if head else ("tail", tail) if tail else ("none", "")
            sides.append(side)
            literals.append(literal)
            regexes.append(glob_regex(glob))
        made = [pa.array(x, pa.string()) for x in (sides, literals, regexes)]
        yield pa.RecordBatch.from_arrays([batch.column("repo"), *made], names=["repo", "side", "literal", "regex"])


def matching_globs(tags: DataFrame, globs: DataFrame) -> DataFrame:
    """repo, tag of the tags that match a glob of their repo (repo, glob).

    A glob is found by the text it begins with, or ends with if it begins with a
    wildcard; a tag looks up its own beginnings and ends of the lengths that occur.
    Only what is found there is matched in full. Globs without either meet every tag of
    their repo.
    """
    known = globs.filter(F.col("glob").isNotNull() & F.col("repo").isNotNull()).select("repo", "glob").distinct()
    rules = saved(known.mapInArrow(_glob_rows, "repo string, side string, literal string, regex string"))
    # A length is at most that of the longest glob.
    sizes = rules.agg(F.collect_set(F.struct("side", F.char_length("literal").alias("size"))))
    each = tags.select("repo", "tag").distinct().withColumn("_sizes", sizes.scalar())
    asked = each.select("repo", "tag", F.explode("_sizes").alias("at")).filter(F.col("at.size") <= F.char_length("tag"))
    begin = F.when(F.col("at.side") == "tail", F.char_length("tag") - F.col("at.size") + 1).otherwise(1)
    looked = asked.select("repo", "tag", F.col("at.side").alias("side"), F.substr("tag", begin, F.col("at.size")).alias("literal"))
    met = looked.join(rules, ["repo", "side", "literal"]).filter(F.rlike("tag", F.col("regex")))
    return met.select("repo", "tag").distinct()


def order_violations(releases: DataFrame, prefix: str = "v", bits: int = 18) -> DataFrame:
    """Stable versions not above the last tag before them.

    `releases` has repo, seq (order of creation) and tag. Pre-releases pass, and
    so does anything after a tag that is no plain X.Y.Z.
    """
    tagged = releases.filter(matches_release_prefix(F.col("tag"), prefix))
    named = F.struct(refname_key(F.col("tag")).alias("key"), F.col("tag"))
    earlier = running(tagged, ["repo"], "seq", maxes={"_last": named}, inclusive=False, bits=bits)

    def bare(tag: Column) -> Column:
        return F.substr(tag, F.lit(len(prefix) + 1))

    new, last = bare(F.col("tag")), bare(F.col("_last.tag"))
    broken = (
        ~is_prerelease(new) & is_core(last) & ~F.coalesce(version_key(new) > version_key(last), F.lit(False))
    )
    return earlier.filter(broken).select("repo", "seq", "tag", F.col("_last.tag").alias("last_tag"))
