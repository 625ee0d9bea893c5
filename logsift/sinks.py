"""Results as text, JSON and key=value rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions.keywords import SECURITY_WEIGHTS

# The names of the weights in the report.
_WEIGHT_NAMES = {
    "security_keywords": "commits",
    "security_patterns": "diff_security",
    "cve_patterns": "cve",
    "memory_safety_issues": "memory",
    "crash_fixes": "crash",
}


def write_blocks(blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Block texts in log order, an empty line after each block.

    The sort is by ranges, so every file holds a run of the whole order.
    """
    ordered = blocks.orderBy("log_id", "block_no")
    text = F.concat("block_text", F.lit("\n"))
    ordered.select(text.alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def to_json_rows(report: DataFrame, key: str = "range_id") -> DataFrame:
    """One JSON text per row, under the key."""
    values = [c for c in report.columns if c != key]
    return report.select(key, F.to_json(F.struct(*values)).alias("json"))


def release_json(suggested: DataFrame) -> DataFrame:
    """`plans.release.suggest_releases` as one nested JSON text per range; no next version, no field."""
    deltas = F.struct("patch_delta", "minor_delta", "major_delta").alias("loc_delta")
    fields = (
        "suggestion",
        "current_version",
        "next_version",
        "total_bonus",
        "manual_cli_changes",
        "manual_added_long_count",
        "manual_removed_long_count",
    )
    return suggested.select("range_id", F.to_json(F.struct(*fields, deltas)).alias("json"))


def security_json(scored: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """`changes.security_score` as one nested JSON text per range, with the weights used."""
    weights = {**SECURITY_WEIGHTS, **(weights or {})}
    used = F.struct(*[F.lit(weights[n]).alias(short) for n, short in _WEIGHT_NAMES.items()]).alias("weights")
    fields = (*_WEIGHT_NAMES, "total_security_score", "risk")
    return scored.select("range_id", F.to_json(F.struct(*fields, used)).alias("json"))


def write_json(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    report.write.mode(mode).option("ignoreNullFields", "false").json(path)


def to_kv_rows(report: DataFrame, key: str = "range_id", names: Sequence[str] | None = None) -> DataFrame:
    """One row per value: the key, the NAME in capitals, the value as text."""
    names = list(names or [c for c in report.columns if c != key])
    as_text = report.select(key, *[F.col(n).cast("string").alias(n.upper()) for n in names])
    return as_text.unpivot([key], [n.upper() for n in names], "name", "value")


def write_kv(report: DataFrame, path: str, key: str = "range_id", mode: str = "errorifexists") -> None:
    """The key, a tab, NAME=value; as many files as the report has tasks, however many keys."""
    rows = to_kv_rows(report, key)
    line = F.concat("name", F.lit("="), F.coalesce("value", F.lit("")))
    rows.select(key, line.alias("line")).write.mode(mode).option("sep", "\t").csv(path)
