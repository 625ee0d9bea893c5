"""Counts over file changes, diff lines and commit messages, one row per range.

Every count is a plain aggregate with partial sums before the shuffle, so a
range that holds most of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions import keywords as kw
from logsift.functions import paths as pt
from logsift.functions.text import WHITE, ascii_only
from logsift.functions.values import count_text
from logsift.operators.align import without_space_changes


def _letter() -> Column:
    return F.substring("status", 1, 1)


def changed_path(changes: DataFrame) -> Column:
    """The path after the change: the new one of a rename or copy."""
    return F.when(_letter().isin("R", "C"), changes["new_path"]).otherwise(changes["path"])


def select_paths(
    rows: DataFrame,
    only: str | Sequence[str] = "",
    exclude: str | Sequence[str] = "",
    path: Column | None = None,
) -> DataFrame:
    """Rows whose path passes the filters; see `paths.path_selected`."""
    return rows.filter(pt.path_selected(F.col("path") if path is None else path, only, exclude))


def file_change_summary(changes: DataFrame) -> DataFrame:
    """Added, modified, deleted and new files, and changed lines."""
    letter = _letter()
    added = letter == "A"
    known = changes.select(
        "range_id",
        letter.alias("letter"),
        # Only added files are classified.
        F.when(added, pt.path_class(changed_path(changes))).alias("class"),
        count_text(F.col("ins_txt")).alias("ins"),
        count_text(F.col("del_txt")).alias("dels"),
    )
    summary = known.groupBy("range_id").agg(
        F.count_if(F.col("letter") == "A").alias("added_files"),
        F.count_if(~F.coalesce(F.col("letter"), F.lit("")).isin("A", "D")).alias("modified_files"),
        F.count_if(F.col("letter") == "D").alias("deleted_files"),
        F.count_if(F.col("class") == pt.SOURCE).alias("new_source_files"),
        F.count_if(F.col("class") == pt.TEST).alias("new_test_files"),
        F.count_if(F.col("class") == pt.DOC).alias("new_doc_files"),
        F.sum("ins").alias("insertions"),
        F.sum("dels").alias("deletions"),
    )
    return summary.withColumn("diff_size", F.col("insertions") + F.col("deletions"))


# --- which lines and messages --------------------------------------------------


def added_lines(diff_lines: DataFrame) -> DataFrame:
    """Added lines without the ``+++`` header."""
    return diff_lines.filter((F.col("sign") == "+") & ~F.col("text").startswith("++"))


def changed_lines(diff_lines: DataFrame) -> DataFrame:
    """Added and removed lines; context lines say nothing about a change."""
    return diff_lines.filter(F.col("sign").isin("+", "-"))


def without_merges(commits: DataFrame) -> DataFrame:
    """Commits that are not known to be merges."""
    return commits.filter(~F.coalesce("is_merge", F.lit(False)))


def space_only_changes(diff_lines: DataFrame) -> DataFrame:
    """Per range: changed lines, and how many of them are white space only."""
    keyed = diff_lines.filter(F.col("sign").isin("+", "-")).select(
        "range_id", "path", F.regexp_replace("text", rf"{WHITE}+", "").alias("bare"), "sign"
    )
    per_text = keyed.groupBy("range_id", "path", "bare").agg(
        F.count_if(F.col("sign") == "+").alias("plus"),
        F.count_if(F.col("sign") == "-").alias("minus"),
    )
    pairs = F.least("plus", "minus")
    return per_text.groupBy("range_id").agg(
        F.sum("plus").alias("added_lines"),
        F.sum("minus").alias("removed_lines"),
        F.sum(pairs).alias("space_only_pairs"),
        F.sum(F.col("plus") - pairs).alias("added_kept"),
        F.sum(F.col("minus") - pairs).alias("removed_kept"),
    )


def message_lines(commits: DataFrame, separator: str) -> DataFrame:
    """Subject and body of every message, joined and cut into lines."""
    message = F.concat_ws(separator, F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))
    return commits.select("range_id", F.explode(F.split(message, "\n")).alias("text"))


# --- keywords by line ----------------------------------------------------------

# Some word of each list; lines without one are not looked at any further.
_COMMENT_GATE = "(?i)BREAKING|FEATURE|SECURITY|OPTION"
_MESSAGE_GATE = "(?i)BREAKING|FEATURE|SECURITY|VULNERABILIT|CVE"


def signed_lines(diff_lines: DataFrame, *more: str) -> DataFrame:
    """range_id and `line`: sign and text with only ASCII characters."""
    signed = F.concat(F.coalesce("sign", F.lit("")), F.col("text"))
    return diff_lines.select("range_id", ascii_only(signed).alias("line"), *more)


def comment_counts(line: Column) -> dict[str, Column]:
    """Aggregates over ASCII lines of code: lines per announced word."""
    gated = line.rlike(_COMMENT_GATE)
    return {n: F.count_if(gated & kw.comment_has(line, p)) for n, p in kw.COMMENT_WORDS.items()}


def message_counts(line: Column) -> dict[str, Column]:
    """Aggregates over ASCII lines of messages: lines per word."""
    gated = line.rlike(_MESSAGE_GATE)
    return {n: F.count_if(gated & kw.line_has(line, p)) for n, p in kw.MESSAGE_WORDS.items()}


def _per_range(lines: DataFrame, counts: dict[str, Column]) -> DataFrame:
    return lines.groupBy("range_id").agg(*[c.alias(n) for n, c in counts.items()])


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables of counts with one row per range each, as one; missing counts are 0."""
    names = [c for part in parts for c in part.columns if c != "range_id"]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    zero = F.lit(0).cast("long")
    return rows.groupBy("range_id").agg(*[F.coalesce(F.sum(n), zero).alias(n) for n in names])


def keyword_counts(diff_lines: DataFrame, commits: DataFrame) -> DataFrame:
    """Lines with announced words in code comments and in commit messages."""
    code = _per_range(signed_lines(changed_lines(diff_lines)), comment_counts(F.col("line")))
    return keyword_flags(stacked([code, message_keywords(commits)]))


def message_keywords(commits: DataFrame) -> DataFrame:
    """Lines with announced words in commit messages, per range."""
    folded = message_lines(commits, " ").select("range_id", ascii_only(F.col("text")).alias("line"))
    return _per_range(folded, message_counts(F.col("line")))


def keyword_flags(counts: DataFrame) -> DataFrame:
    """Add the totals over code and messages, and the has_* flags."""
    col = F.col
    totals = counts.withColumns(
        {
            "total_cli_breaking": col("cli_breaking_keywords") + col("commit_cli_breaking"),
            "total_api_breaking": col("api_breaking_keywords") + col("commit_api_breaking"),
            "total_general_breaking": col("commit_general_breaking"),
            "total_new_features": col("new_feature_keywords") + col("commit_new_feature"),
            "total_security": col("security_keywords") + col("commit_security"),
        }
    )
    return totals.withColumns(
        {
            "has_cli_breaking": col("total_cli_breaking") > 0,
            "has_api_breaking": col("total_api_breaking") > 0,
            "has_general_breaking": col("total_general_breaking") > 0,
            "has_new_features": col("total_new_features") > 0,
            "has_security": col("total_security") > 0,
            "has_removed_options": col("removed_options_keywords") > 0,
            "has_added_options": col("added_options_keywords") > 0,
        }
    )


# --- keywords by occurrence ----------------------------------------------------


_CODE_WORDS = {
    "security_patterns": kw.SECURITY_WORDS,
    "cve_patterns": kw.CVE_WORDS,
    "memory_safety_issues": kw.MEMORY_WORDS,
    "crash_fixes": kw.CRASH_WORDS,
}


def code_word_counts(line: Column) -> dict[str, Column]:
    """Aggregates over ASCII lines of code: occurrences per word list."""
    return {n: F.sum(kw.occurrences(line, p)) for n, p in _CODE_WORDS.items()}


def message_security(commits: DataFrame) -> DataFrame:
    """Security words in commit messages, per range."""
    folded = message_lines(commits, "\n").select("range_id", ascii_only(F.col("text")).alias("line"))
    return _per_range(folded, {"security_keywords": F.sum(kw.occurrences(F.col("line"), kw.SECURITY_WORDS))})


def security_counts(
    diff_lines: DataFrame, commits: DataFrame, added_only: bool = False
) -> DataFrame:
    """Security, CVE, memory and crash words, counted by occurrence."""
    if added_only:
        # Without the sign; bare + lines and lines that go on with + are left out.
        wanted = (F.col("sign") == "+") & (F.col("text") != "") & ~F.col("text").startswith("+")
        code = diff_lines.filter(wanted).select("range_id", ascii_only(F.col("text")).alias("line"))
    else:
        code = signed_lines(diff_lines)
    in_code = _per_range(code, code_word_counts(F.col("line")))
    return stacked([message_security(commits), in_code])


def security_score(counts: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """Add the weighted score and its risk band."""
    weights = {**kw.SECURITY_WEIGHTS, **(weights or {})}
    score = sum((F.col(n) * w for n, w in weights.items()), F.lit(0).cast("long"))
    scored = counts.withColumn("total_security_score", score)
    return scored.withColumn("risk", kw.risk_band(F.col("total_security_score")))
