"""Queries on tags and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions import versions as vs
from logsift.operators import score as sc
from logsift.operators import tags as tg
from workload import derived as dv

# Versions with pre-release and build parts, some of them malformed.
_TEXTS = """
SELECT o_orderkey AS row_id, concat(CASE o_orderkey % 8 WHEN 0 THEN '0' WHEN 1 THEN 'v' ELSE '' END,
  CAST(o_orderkey % 12 AS VARCHAR), '.', CAST(o_orderkey % 11 AS VARCHAR), '.', CAST(o_custkey % 10 AS VARCHAR),
  CASE o_orderkey % 5 WHEN 0 THEN '-alpha.1' WHEN 1 THEN '-rc-x.07' WHEN 2 THEN '' WHEN 3 THEN '-beta..2' ELSE '' END,
  CASE o_orderkey % 3 WHEN 0 THEN '+build.5' WHEN 1 THEN '' ELSE '+b-1' END) AS version
FROM """


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    orders = dv.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return dv.run_sql(spark, _TEXTS, orders)


def version_parse(spark: SparkSession, folder: str) -> DataFrame:
    version = F.col("version")
    bare = F.regexp_replace(version, "^v", "")
    return _texts(spark, folder).select(
        "row_id",
        vs.is_core(version).alias("core"),
        vs.is_core_or_prerelease(version).alias("with_prerelease"),
        vs.is_full(version).alias("full_version"),
        vs.is_prerelease(version).alias("prerelease"),
        vs.strip_build(version).alias("stripped"),
        vs.to_tag(F.substring_index(vs.strip_build(version), "-", 1)).alias("tag"),
        *[vs.core_part(bare, i).try_cast("long").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))],
    )


def version_compare(spark: SparkSession, folder: str) -> DataFrame:
    """The version of every tag against that of the tag before it by name."""
    pairs = tg.previous_tags(dv.tags(spark, folder))
    new, old = (F.regexp_replace(c, "^(v|old-)", "") for c in ("tag", "previous_tag"))
    return pairs.select("repo", "tag", "previous_tag", vs.compare(new, old).alias("order"))


def version_order(spark: SparkSession, folder: str) -> DataFrame:
    return tg.version_order(dv.tags(spark, folder)).select("repo", "tag", F.col("place").cast("long").alias("place"))


def latest_tag(spark: SparkSession, folder: str) -> DataFrame:
    return tg.latest_tags(dv.tags(spark, folder))


def previous_tag(spark: SparkSession, folder: str) -> DataFrame:
    return tg.previous_tags(tg.matching(dv.tags(spark, folder), "v*"))


_GLOBS = """
SELECT DISTINCT concat('repo', CAST(o_custkey % 40 AS VARCHAR)) AS repo,
  CASE o_custkey % 7
    WHEN 0 THEN concat('v', CAST(o_custkey % 3 AS VARCHAR), '.', CAST(o_custkey % 23 AS VARCHAR), '.*')
    WHEN 1 THEN concat('*-rc.', CAST(o_custkey % 15 AS VARCHAR))
    WHEN 2 THEN concat('v?.', CAST(o_custkey % 10 AS VARCHAR), '.?')
    WHEN 3 THEN concat('v[01].', CAST(o_custkey % 23 AS VARCHAR), '.3*')
    WHEN 4 THEN 'v2.1.0'
    WHEN 5 THEN concat('*.', CAST(o_custkey % 23 AS VARCHAR), '.6*')
    ELSE 'old-*' END AS glob
FROM """


def prune_tags_by_table(spark: SparkSession, folder: str) -> DataFrame:
    """The ten newest tags of each repo stay, and those that a table of globs protects."""
    globs = dv.run_sql(spark, _GLOBS, dv.table(spark, folder, "orders"))
    return tg.prune(dv.tags(spark, folder), keep=10, protect_table=globs)


def prune_tags(spark: SparkSession, folder: str) -> DataFrame:
    return tg.prune(dv.tags(spark, folder), keep=10, glob="v*", protect=("v0.*", "v1.2?.*"))


def tag_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tg.tag_counts(dv.tags(spark, folder), "v[12].*")


def order_violations(spark: SparkSession, folder: str) -> DataFrame:
    return tg.order_violations(dv.releases(spark, folder))


def next_version_rollover(spark: SparkSession, folder: str) -> DataFrame:
    return sc.next_version_rollover(dv.bumps(spark, folder)).select(
        "row_id", "base_delta", "bonus_multiplier", "total_bonus_points", "total_delta", "next_version"
    )


def next_version_direct(spark: SparkSession, folder: str) -> DataFrame:
    bumps = dv.bumps(spark, folder)
    return sc.next_version_direct(bumps, delta="loc", keep_patch_on_minor=True).select("row_id", "next_version")


def next_version_direct_clear(spark: SparkSession, folder: str) -> DataFrame:
    bumps = dv.bumps(spark, folder)
    return sc.next_version_direct(bumps, delta="loc", keep_lower_on_major=True).select("row_id", "next_version")


QUERIES = {
    "version_parse": version_parse,
    "version_compare": version_compare,
    "version_order": version_order,
    "latest_tag": latest_tag,
    "previous_tag": previous_tag,
    "prune_tags": prune_tags,
    "prune_tags_by_table": prune_tags_by_table,
    "tag_counts": tag_counts,
    "order_violations": order_violations,
    "next_version_rollover": next_version_rollover,
    "next_version_direct": next_version_direct,
    "next_version_direct_clear": next_version_direct_clear,
}

_CORE = r"(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)"
_PRE = r"(-[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?"
_BUILD = r"(\+[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?"
_BARE = "regexp_replace(split_part(split_part(version, '+', 1), '-', 1), '^v', '')"
_SPLIT = r"""split AS (SELECT *, regexp_matches(current_version, '^[0-9]+\.[0-9]+\.[0-9]+$') AS plain,
  try_cast(split_part(current_version, '.', 1) AS BIGINT) AS x, try_cast(split_part(current_version, '.', 2) AS BIGINT) AS y,
  try_cast(split_part(current_version, '.', 3) AS BIGINT) AS z FROM bumps)"""


def _version(major: str, minor: str, patch: str) -> str:
    return f"concat(CAST({major} AS VARCHAR), '.', CAST({minor} AS VARCHAR), '.', CAST({patch} AS VARCHAR))"


def _rolled(delta: str) -> str:
    up = f"(z + {delta}) // 1000"
    return _version(f"x + (y + {up}) // 1000", f"(y + {up}) % 1000", f"(z + {delta}) % 1000")


def _direct(minor_patch: str, major_rest: tuple[str, str]) -> str:
    return f"""WITH {dv.BUMPS_SQL}, {_SPLIT} SELECT row_id, CASE WHEN NOT plain THEN NULL
      WHEN bump = 'patch' THEN {_rolled("loc")}
      WHEN bump = 'minor' THEN {_version("x + (y + loc) // 1000", "(y + loc) % 1000", minor_patch)}
      ELSE {_version("x + loc", *major_rest)} END AS next_version FROM split"""


ORACLE = {
    "version_parse": f"""WITH texts AS ({_TEXTS} orders) SELECT row_id,
      regexp_matches(version, '^{_CORE}$') AS core, regexp_matches(version, '^{_CORE}{_PRE}$') AS with_prerelease,
      regexp_matches(version, '^{_CORE}{_PRE}{_BUILD}$') AS full_version,
      contains(split_part(version, '+', 1), '-') AS prerelease, split_part(version, '+', 1) AS stripped,
      concat('v', {_BARE}) AS tag, CAST(split_part({_BARE}, '.', 1) AS BIGINT) AS major,
      CAST(split_part({_BARE}, '.', 2) AS BIGINT) AS minor, CAST(split_part({_BARE}, '.', 3) AS BIGINT) AS patch
      FROM texts""",
    "version_compare": f"""WITH {dv.TAGS_SQL} SELECT repo, tag, lag(tag) OVER w AS previous_tag,
      CAST(sign(version_rank - lag(version_rank) OVER w) AS INT) AS "order"
      FROM tags WINDOW w AS (PARTITION BY repo ORDER BY tag[1], name_rank)""",
    "version_order": f"""WITH {dv.TAGS_SQL} SELECT repo, tag, row_number() OVER (PARTITION BY repo
      ORDER BY tag[1] DESC, name_rank DESC) AS place FROM tags""",
    "latest_tag": f"""WITH {dv.TAGS_SQL} SELECT repo, arg_max(tag, name_rank) AS tag FROM tags
      WHERE regexp_matches(tag, '^v[0-9].*\\.[0-9].*\\.[0-9]') GROUP BY repo""",
    "previous_tag": f"""WITH {dv.TAGS_SQL} SELECT repo, tag, lead(tag) OVER (PARTITION BY repo ORDER BY name_rank DESC)
      AS previous_tag FROM tags WHERE starts_with(tag, 'v')""",
    "prune_tags": f"""WITH {dv.TAGS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY repo
        ORDER BY name_rank DESC) AS place FROM tags WHERE starts_with(tag, 'v'))
      SELECT repo, tag FROM ranked WHERE place > 10 AND points_at_head IS NOT TRUE
      AND NOT regexp_matches(tag, '^v0\\..*$') AND NOT regexp_matches(tag, '^v1\\.2.\\..*$')""",
    "prune_tags_by_table": f"""WITH {dv.TAGS_SQL}, globs AS ({_GLOBS} orders),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY tag[1] DESC, name_rank DESC) AS place FROM tags)
      SELECT repo, tag FROM ranked r WHERE place > 10 AND points_at_head IS NOT TRUE
      AND NOT EXISTS (SELECT 1 FROM globs g WHERE g.repo = r.repo AND r.tag GLOB g.glob)""",
    "tag_counts": f"""WITH {dv.TAGS_SQL} SELECT repo, count(*) AS total_tags FROM tags
      WHERE regexp_matches(tag, '^v[12]\\.') GROUP BY repo""",
    "order_violations": f"""WITH {dv.RELEASES_SQL}, last AS (SELECT *,
        arg_max(tag, name_rank) OVER w AS last_tag, arg_max(version_rank, name_rank) OVER w AS last_rank
        FROM releases WHERE starts_with(tag, 'v')
        WINDOW w AS (PARTITION BY repo ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT repo, seq, tag, last_tag FROM last
      WHERE rc IS NULL AND NOT contains(last_tag, '-') AND version_rank <= last_rank""",
    "next_version_rollover": f"""WITH {dv.BUMPS_SQL}, {_SPLIT}, deltas AS (SELECT row_id, bump, loc, bonus,
        CASE WHEN plain THEN x ELSE 0 END AS x, CASE WHEN plain THEN y ELSE 0 END AS y,
        CASE WHEN plain THEN z ELSE 0 END AS z, NOT plain OR x + y + z = 0 AS initial,
        CASE bump WHEN 'patch' THEN 250 WHEN 'minor' THEN 500 ELSE 1000 END AS per,
        CASE bump WHEN 'patch' THEN 1 + (loc + 125) // 250 WHEN 'minor' THEN 5 + (loc + 50) // 100
          ELSE 10 + (loc + 50) // 100 END AS base FROM split),
      sums AS (SELECT *, bonus + (bonus * loc + per // 2) // per AS points,
        (100 * (per + loc) + per // 2) // per AS hundredths FROM deltas)
      SELECT row_id, CASE WHEN initial THEN 0 ELSE base END AS base_delta,
        CASE WHEN initial THEN '1.00' ELSE format('{{}}.{{:02d}}', hundredths // 100, hundredths % 100) END AS bonus_multiplier,
        CASE WHEN initial THEN 0 ELSE points END AS total_bonus_points,
        CASE WHEN initial THEN 0 ELSE greatest(base + points, 1) END AS total_delta,
        CASE WHEN initial THEN CASE bump WHEN 'patch' THEN '0.0.1' WHEN 'minor' THEN '0.1.0' ELSE '1.0.0' END
          ELSE {_rolled("greatest(base + points, 1)")} END AS next_version FROM sums""",
    "next_version_direct": _direct("z", ("0", "0")),
    "next_version_direct_clear": _direct("0", ("y", "z")),
}
