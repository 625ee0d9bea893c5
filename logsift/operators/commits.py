"""Commit tables: counts, base commits by day, first matching subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsift.functions.keywords import is_security_text
from logsift.operators.ordered import running


def commit_counts(ranges: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits of every range, ranges without commits included."""
    counted = commits.groupBy("range_id").agg(F.count("*").alias("n"))
    joined = ranges.select("range_id").distinct().join(counted, "range_id", "left")
    count = F.coalesce("n", F.lit(0))
    return joined.select(
        "range_id", count.alias("commit_count"), (count > 0).alias("has_commits")
    )


def base_by_day(history: DataFrame, day: str) -> DataFrame:
    """Per repo: last commit up to the end of the day, else the first commit.

    `history` has repo, commit_id and committed_at; `day` is yyyy-mm-dd.
    """
    at = F.struct("committed_at", "commit_id")
    until = F.to_date("committed_at") <= F.to_date(F.lit(day))
    ends = history.groupBy("repo").agg(F.max(F.when(until, at)).alias("last"), F.min(at).alias("first"))
    return ends.select(
        "repo",
        F.coalesce("last.commit_id", "first.commit_id").alias("base_commit"),
        F.when(F.col("last").isNotNull(), "date").otherwise("first").alias("ref_type"),
    )


def base_by_range(ranges: DataFrame, history: DataFrame, bits: int = 41) -> DataFrame:
    """Per range: the last commit of its repo up to the end of its day, else the repo's first commit.

    `ranges` has range_id, repo and day; `history` repo, commit_id and committed_at. Of
    commits at one time the one with the largest id counts. A range without a day has
    the first commit, one whose repo has no commits a null base ("none"). Commits without
    a time are left out.

    An as-of join: ranges stand among the commits, each behind all of its day, and the
    last commit is a running maximum. Repos are cut into chunks of 2**bits half
    microseconds, so one with most of the commits is worked on in parallel.
    """
    at = F.struct("committed_at", "commit_id")
    known = history.filter(F.col("committed_at").isNotNull()).select(
        _named_repo().alias("_repo"), F.col("committed_at").cast("timestamp").alias("committed_at"), "commit_id"
    )
    commit = known.select("_repo", (2 * F.unix_micros("committed_at")).alias("_at"), at.alias("_commit"))
    # Odd numbers: behind every commit of the day, before the first of the next.
    midnight = F.unix_micros(F.date_add(F.to_date("day"), 1).cast("timestamp"))
    asked = ranges.select(
        _named_repo().alias("_repo"),
        F.coalesce(2 * midnight - 1, F.lit(-(2**62))).alias("_at"),
        F.lit(None).cast(commit.schema["_commit"].dataType).alias("_commit"),
        F.col("range_id"),
        F.lit(True).alias("_asked"),
    )
    both = commit.unionByName(asked, allowMissingColumns=True)
    told = running(both, ["_repo"], "_at", maxes={"_last": F.col("_commit")}, bits=bits, few_chunks=False)
    first = known.groupBy("_repo").agg(F.min(at).alias("_first"))
    joined = told.filter("_asked").join(first, "_repo", "left")
    return joined.select(
        "range_id",
        F.coalesce("_last.commit_id", "_first.commit_id").alias("base_commit"),
        F.when(F.col("_last").isNotNull(), "date").when(F.col("_first").isNotNull(), "first").otherwise("none").alias("ref_type"),
    )


def _named_repo() -> Column:
    """The repo with a letter before, so that null is told from empty."""
    return F.coalesce(F.concat(F.lit("r"), F.col("repo")), F.lit(""))


def top_security_subjects(commits: DataFrame, top: int = 10) -> DataFrame:
    """Newest `top` security-related subjects of every range.

    The rank filter is pushed below the shuffle by Spark, so at most `top` rows
    per range and task travel.
    """
    newest = W.partitionBy("range_id").orderBy(F.col("committed_at").desc(), F.col("commit_id").desc())
    matching = commits.filter(is_security_text(F.col("subject")))
    ranked = matching.withColumn("place", F.row_number().over(newest))
    return ranked.filter(F.col("place") <= top).select("range_id", "place", "commit_id", "subject")
