"""Bonus, suggestion and next version from the metrics of a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions import versions as vs


def score_bonus(metrics: DataFrame, weights: Column) -> DataFrame:
    """Add total_bonus; `weights` is a struct as made by `sources.weights`.

    Security words count once per analysis that found them, each time in full.
    """
    col = F.col

    def flag(condition: Column, rule: str) -> Column:
        return F.when(condition, F.col("_w")[rule]).otherwise(0)

    security = col("security_words") + col("total_security")
    removed = (
        col("removed_short_count")
        + col("removed_long_count")
        + col("manual_removed_long_count")
        + col("removed_options_keywords")
    )
    bonus = (
        flag(col("has_cli_breaking") | col("breaking_cli_changes"), "breaking_cli")
        + flag(col("has_api_breaking") | col("api_breaking"), "api_breaking")
        + flag(col("has_general_breaking"), "api_breaking")
        + security * col("_w.security")
        + flag(col("cli_changes"), "cli_changes")
        + flag(col("manual_cli_changes"), "manual_cli")
        + flag(col("new_source_files") > 0, "new_source")
        + flag(col("new_test_files") > 0, "new_test")
        + flag(col("new_doc_files") > 0, "new_doc")
        + flag(removed > 0, "removed_option")
    )
    return metrics.withColumn("_w", weights).withColumn("total_bonus", bonus)


def suggest(scored: DataFrame) -> DataFrame:
    """Add suggestion (major, minor, patch, none) from total_bonus and thresholds."""
    col = F.col
    valid = F.coalesce(col("current_version").rlike(vs.PLAIN), F.lit(True))
    suggestion = (
        F.when(~valid, "none")
        .when(col("total_bonus") >= col("_w.major_from"), "major")
        .when(col("total_bonus") >= col("_w.minor_from"), "minor")
        .when(col("total_bonus") > col("_w.patch_above"), "patch")
        .otherwise("none")
    )
    return scored.withColumn("suggestion", suggestion)


def next_version_rollover(
    rows: DataFrame,
    current: str = "current_version",
    bump: str = "bump",
    loc: str = "loc",
    bonus: str = "bonus",
    carry_at: int = vs.CARRY_AT,
) -> DataFrame:
    """Add deltas and next_version; only the patch number is raised, with carries.

    A current version that is not X.Y.Z counts as 0.0.0.
    """
    if carry_at < 1:
        raise ValueError("carry_at must be positive")
    kind, lines, points = F.lower(F.col(bump)), F.col(loc).cast("long"), F.col(bonus).cast("long")
    plain = F.col(current).rlike(vs.PLAIN)
    parts = [
        F.coalesce(F.when(plain, n), F.lit(0).cast("long")) for n in vs.core_numbers(F.col(current))
    ]
    numbered = rows.withColumn("_v", F.struct(*[p.alias(n) for p, n in zip(parts, ("x", "y", "z"))]))
    x, y, z = F.col("_v.x"), F.col("_v.y"), F.col("_v.z")
    initial = (x == 0) & (y == 0) & (z == 0)
    zero = F.lit(0).cast("long")
    first = F
    for name, version in vs.FIRST_VERSIONS.items():
        first = first.when(kind == name, version)
    added = numbered.withColumns(
        {
            "base_delta": F.when(initial, zero).otherwise(vs.base_delta(kind, lines)),
            "bonus_multiplier": F.when(initial, "1.00").otherwise(vs.bonus_multiplier(kind, lines)),
            "total_bonus_points": F.when(initial, zero).otherwise(vs.total_bonus(kind, lines, points)),
        }
    )
    delta = F.when(initial, zero).otherwise(vs.total_delta(kind, lines, points))
    added = added.withColumn("total_delta", delta)
    rolled = vs.rolled(x, y, z, F.col("total_delta"), carry_at)
    return added.withColumn("next_version", F.when(initial, first).otherwise(rolled)).drop("_v")


def next_version_direct(
    rows: DataFrame,
    current: str = "current_version",
    bump: str = "bump",
    delta: str = "delta",
    carry_at: int = vs.CARRY_AT,
    keep_patch_on_minor: bool = False,
    keep_lower_on_major: bool = False,
) -> DataFrame:
    """Add next_version with the delta added to the number the bump names.

    Null where the current version is not X.Y.Z or the bump is unknown.
    """
    x, y, z = vs.core_numbers(F.when(F.col(current).rlike(vs.PLAIN), F.col(current)))
    kind, step = F.lower(F.col(bump)), F.col(delta).cast("long")
    zero = F.lit(0).cast("long")
    patch = vs.rolled(x, y, z, step, carry_at)
    minor = F.concat_ws(
        ".",
        x + vs.int_div(y + step, carry_at),
        (y + step) % carry_at,
        z if keep_patch_on_minor else zero,
    )
    lower = (y, z) if keep_lower_on_major else (zero, zero)
    major = F.concat_ws(".", x + step, *lower)
    out = F.when(kind == "patch", patch).when(kind == "minor", minor).when(kind == "major", major)
    return rows.withColumn("next_version", F.when(x.isNotNull(), out))
