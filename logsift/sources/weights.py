"""Rule weights and thresholds, with defaults for what a table leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name, its (category, rule) in a weight table, default.
RULES = (
    ("breaking_cli", "breaking_changes", "cli_breaking", 2),
    ("api_breaking", "breaking_changes", "api_breaking", 3),
    ("removed_option", "breaking_changes", "removed_features", 1),
    ("cli_changes", "cli", "cli_changes", 2),
    ("manual_cli", "cli", "manual_cli", 1),
    ("new_source", "code_quality", "new_source_file", 1),
    ("new_test", "code_quality", "new_test_suite", 1),
    ("new_doc", "code_quality", "doc_overhaul", 1),
    ("security", "security_stability", "security_vuln", 2),
    ("major_from", "thresholds", "major_bonus", 8),
    ("minor_from", "thresholds", "minor_bonus", 4),
    ("patch_above", "thresholds", "patch_bonus", 0),
)


def default_weights() -> Column:
    return F.struct(*[F.lit(d).cast("long").alias(n) for n, _, _, d in RULES])


def weight_struct(table: DataFrame) -> Column:
    """One struct of weights from a table (category, rule, weight).

    A rule that is missing or whose weight is no whole number takes its
    default. The table is folded into one row first and used as a scalar.
    """

    def picked(category: str, rule: str, default: int) -> Column:
        here = (F.col("category") == category) & (F.col("rule") == rule)
        whole = F.col("weight") == F.floor("weight")
        value = F.max(F.when(here & whole, F.col("weight")))
        return F.coalesce(value.cast("long"), F.lit(default).cast("long"))

    one = table.agg(*[picked(c, r, d).alias(n) for n, c, r, d in RULES])
    return one.select(F.struct(*[n for n, *_ in RULES])).scalar()
