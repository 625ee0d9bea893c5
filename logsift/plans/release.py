"""Release suggestion for many ranges at once: metrics, bonus, next version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions import keywords as kw
from logsift.functions import paths as pt
from logsift.functions import versions as vs
from logsift.functions.paths import C_FAMILY_GLOBS
from logsift.operators import changes as ch
from logsift.operators import cli_options as co
from logsift.operators import score as sc
from logsift.sources.weights import default_weights

_COUNTS = (
    "new_source_files",
    "new_test_files",
    "new_doc_files",
    "diff_size",
    "removed_short_count",
    "removed_long_count",
    "manual_added_long_count",
    "manual_removed_long_count",
    "removed_options_keywords",
    "total_security",
    "security_words",
)
_FLAGS = (
    *co.OPTION_FLAGS,
    "has_cli_breaking",
    "has_api_breaking",
    "has_general_breaking",
)


def diff_metrics(
    diff_lines: DataFrame, c_paths: str | Sequence[str], added_only: bool = False
) -> DataFrame:
    """Comment words and argument patterns of the changed lines in one pass.

    With added_only, words count in added lines only; patterns look at both signs.
    """
    path = pt.path_selected(F.col("path"), c_paths)
    own = (F.col("sign") == "+") & ~F.col("text").startswith("++") if added_only else F.lit(True)
    flags = {"is_c": path, "has_say": own}
    lines = ch.signed_lines(ch.changed_lines(diff_lines).withColumns(flags), *flags)
    # Patterns look at C files only: other lines count as null, which matches nothing.
    c_line = F.when(F.col("is_c"), F.col("line"))
    said = F.when(F.col("has_say"), F.col("line")) if added_only else F.col("line")
    counts = {**ch.comment_counts(said), **co.pattern_counts(c_line)}
    return lines.groupBy("range_id").agg(*[c.alias(n) for n, c in counts.items()])


def range_metrics(
    ranges: DataFrame,
    file_changes: DataFrame,
    diff_lines: DataFrame,
    commits: DataFrame,
    option_sources: DataFrame,
    only_paths: str | Sequence[str] = "",
    exclude_paths: str | Sequence[str] = "",
    ignore_space: bool = False,
    added_only: bool = False,
    no_merges: bool = False,
) -> DataFrame:
    """Every range with all its metrics; what a range lacks is 0 or false.

    ignore_space leaves out lines that change white space only, as `align` finds them in
    each hunk (line counts in `file_changes` are taken as they are); added_only counts announced
    words in added lines only; no_merges leaves out messages of merges.

    Diff lines, commits and option sources are read twice, file changes once; what is put together at the end has one row per range and metric table.
    """
    picked = ch.select_paths(file_changes, only_paths, exclude_paths, ch.changed_path(file_changes))
    lines = ch.select_paths(diff_lines, only_paths, exclude_paths)
    if ignore_space:
        lines = ch.without_space_changes(lines)
    if no_merges:
        commits = ch.without_merges(commits)
    c_paths = only_paths or C_FAMILY_GLOBS
    c_lines = ch.select_paths(lines, c_paths)
    parts = [
        ch.file_change_summary(picked),
        *co.option_parts(ch.select_paths(option_sources, c_paths, exclude_paths), c_lines),
        diff_metrics(lines, c_paths, added_only),
        ch.message_keywords(commits),
        ch.message_security(commits).withColumnRenamed("security_keywords", "security_words"),
    ]
    one = ch.keyword_flags(co.option_flags(ch.stacked(parts)))
    joined = ranges.join(one, "range_id", "left")
    return joined.withColumns(
        {
            **{n: F.coalesce(F.col(n), F.lit(0).cast("long")) for n in _COUNTS},
            **{n: F.coalesce(F.col(n), F.lit(False)) for n in _FLAGS},
        }
    )


def suggest_releases(metrics: DataFrame, weights: Column | None = None) -> DataFrame:
    """Bonus, suggestion and next version per range.

    `metrics` has range_id, current_version (null: none yet) and the columns of
    `range_metrics`; `weights` comes from `sources.weights`.
    """
    scored = sc.score_bonus(metrics, default_weights() if weights is None else weights)
    current = F.coalesce("current_version", F.lit("0.0.0"))
    suggested = sc.suggest(scored.withColumn("current_version", current))
    # What is no version counts as 0.0.0, and nothing is suggested for it.
    usable = F.when(F.col("current_version").rlike(vs.PLAIN), F.col("current_version")).otherwise("0.0.0")
    suggested = suggested.withColumn("current_version", usable)
    rolled = sc.next_version_rollover(suggested, bump="suggestion", loc="diff_size", bonus="total_bonus")
    has_bump = F.col("suggestion") != "none"
    initial = F.col("current_version") == "0.0.0"
    deltas = {
        f"{bump}_delta": F.when(initial, F.lit(0).cast("long")).otherwise(
            vs.total_delta(F.lit(bump), F.col("diff_size"), F.col("total_bonus"))
        )
        for bump in vs.BUMPS
    }
    return rolled.select(
        "range_id",
        "current_version",
        "total_bonus",
        "suggestion",
        F.when(has_bump, F.col("next_version")).alias("next_version"),
        "diff_size",
        "manual_cli_changes",
        "manual_added_long_count",
        "manual_removed_long_count",
        *[delta.alias(name) for name, delta in deltas.items()],
    )
