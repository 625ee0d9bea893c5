"""Command-line options in source texts and diffs.

Option sources have range_id, side ('before'/'after'), path, line_no, text;
diff lines have range_id, path, line_no, sign, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.changes import changed_lines, signed_lines, stacked
from logsift.operators.ordered import running

_S = r"[ \t\n\x0B\f\r]"

# What is looked for in source lines.
GETOPT_CALL = rf"getopt(_long)?{_S}*\("
QUOTED = r'"([^"]*)"'
TABLE_OPENS = rf"struct{_S}+option"
TABLE_CLOSES = r"\};"
BRACED_NAME = rf'\{{{_S}*"([^"]+)"'
DOTTED_NAME = rf'\.name{_S}*={_S}*"([^"]+)"'

# What is looked for in diff lines, sign included.
COMMENT_LINE = rf"^[+-]{_S}*(//|/\*)"
QUOTED_DASHES = r"""^[+-].*["'].*--"""
LONG_NAME = r"--([A-Za-z0-9-]+)"
CASE_LABEL = rf"case{_S}+([^: \t\n\x0B\f\r]+){_S}*:"
PROTOTYPE = (
    rf"^-{_S}*[A-Za-z_][A-Za-z0-9_ \t\n\x0B\f\r*]+{_S}+[A-Za-z_][A-Za-z0-9_]*"
    rf"\([^;]*\){_S}*;{_S}*\z"
)
NO_PROTOTYPE = rf"^-{_S}*(typedef|#)"

# Diff lines that hint at changed argument handling.
DIFF_PATTERNS = {
    "getopt_changes": r"(getopt_long|getopt)\s*\(",
    "arg_parsing_changes": r"(?s)^\+.*\b(argc|argv)\b",
    "help_text_changes": r"(?is)^\+.*\b(usage|help|option|argument)\b",
    "main_signature_changes": rf"^\+[^/]*\bint{_S}+main{_S}*\(",
}
PATTERN_KINDS = {
    "short_option_change": r"(?s)^\+[^/#!].*-[A-Za-z]",
    "long_option_change": r"(?s)^\+[^/#!].*--[0-9A-Za-z-]+",
    "argc_check_change": rf"(?s)^\+.*\bargc{_S}*[<>=!]",
    "argv_access_change": r"(?s)^\+.*\bargv\[",
}


def _first(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def optstrings(sources: DataFrame) -> DataFrame:
    """Distinct quoted texts on getopt call lines: range_id, side, path, optstring."""
    calls = sources.filter(F.col("text").rlike(GETOPT_CALL))
    quoted = F.explode(F.regexp_extract_all("text", F.lit(QUOTED), F.lit(1)))
    return calls.select("range_id", "side", "path", quoted.alias("optstring")).distinct()


def long_names(sources: DataFrame, bits: int = 18) -> DataFrame:
    """Distinct names in ``struct option`` tables: range_id, side, option."""
    line = F.col("line_no")
    opens = F.col("text").rlike(TABLE_OPENS)
    closes = F.col("text").rlike(TABLE_CLOSES)
    # Only lines that open or close a table or hold a name have a say.
    telling = "|".join(f"(?:{p})" for p in (TABLE_OPENS, TABLE_CLOSES, BRACED_NAME, DOTTED_NAME))
    placed = running(
        sources.filter(F.col("text").rlike(telling)),
        ["range_id", "side", "path"],
        "line_no",
        maxes={"_open": F.when(opens, line), "_close": F.when(closes, line)},
        bits=bits,
    )
    # A line that both opens and closes a table is outside of it.
    inside = placed.filter(F.col("_open") > F.coalesce("_close", F.col("_open") - 1))
    names = F.array(_first(F.col("text"), BRACED_NAME), _first(F.col("text"), DOTTED_NAME))
    options = F.flatten(F.transform(F.array_compact(names), lambda name: F.split(name, ",")))
    exploded = inside.select("range_id", "side", F.explode(options).alias("option"))
    return exploded.filter(F.col("option") != "").distinct()


def _changes(found: DataFrame, kind: str) -> DataFrame:
    """Options on one side only, as (range_id, kind, option, change)."""
    sides = found.groupBy("range_id", "option").agg(
        F.max(F.col("side") == "before").alias("before"),
        F.max(F.col("side") == "after").alias("after"),
    )
    changed = sides.filter(F.col("before") != F.col("after"))
    change = F.when(F.col("before"), "removed").otherwise("added")
    return changed.select("range_id", F.lit(kind).alias("kind"), "option", change.alias("change"))


def short_options(strings: DataFrame) -> DataFrame:
    letters = F.explode(F.split(F.replace("optstring", F.lit(":")), ""))
    found = strings.select("range_id", "side", letters.alias("option"))
    return found.filter(F.col("option") != "").distinct()


def option_changes(sources: DataFrame, bits: int = 18) -> DataFrame:
    """Short and long options that were added or removed, one row each."""
    short = _changes(short_options(optstrings(sources)), "short")
    return short.unionByName(_changes(long_names(sources, bits), "long"))


def diff_options(diff_lines: DataFrame) -> DataFrame:
    """Long options and case labels in changed lines: range_id, kind, sign, option."""
    line = F.concat("sign", "text")
    changed = changed_lines(diff_lines).select("range_id", "sign", line.alias("line"))
    changed = changed.filter(~F.col("line").rlike(COMMENT_LINE))
    shown = F.when(~F.col("line").rlike(f"(?s){QUOTED_DASHES}"), F.col("line"))
    found = F.array(
        F.struct(F.lit("long").alias("kind"), F.concat(F.lit("--"), _first(shown, LONG_NAME)).alias("option")),
        F.struct(F.lit("case").alias("kind"), _first(F.col("line"), CASE_LABEL).alias("option")),
    )
    exploded = changed.select("range_id", "sign", F.explode(found).alias("found"))
    named = exploded.select("range_id", "found.kind", "sign", "found.option")
    return named.filter(F.col("option").isNotNull()).distinct()


def pattern_counts(line: Column) -> dict[str, Column]:
    """Aggregates over signed ASCII lines: lines per pattern, kinds, prototypes."""
    prototype = line.rlike(PROTOTYPE) & ~line.rlike(NO_PROTOTYPE)
    seen = [F.coalesce(F.max(line.rlike(p)).cast("long"), F.lit(0)) for p in PATTERN_KINDS.values()]
    return {
        **{n: F.count_if(line.rlike(p)) for n, p in DIFF_PATTERNS.items()},
        "enhanced_cli_patterns": sum(seen, F.lit(0).cast("long")),
        "removed_prototypes": F.count_if(prototype),
    }


def diff_patterns(diff_lines: DataFrame) -> DataFrame:
    """Per range: lines per pattern, distinct kinds, removed prototypes."""
    counts = pattern_counts(F.col("line"))
    lines = signed_lines(changed_lines(diff_lines))
    return lines.groupBy("range_id").agg(*[c.alias(n) for n, c in counts.items()])


_KINDS = ("short", "long", "text")


def option_sides(sources: DataFrame, bits: int = 18) -> DataFrame:
    """Short options, long options and option texts per side and on one side only, as counts per range.

    One pass over the lines finds all three kinds; the table state of a line is what
    takes the second reading, of lines that open or close a table, name or call.
    """
    line = F.col("line_no")
    telling = "|".join(f"(?:{p})" for p in (TABLE_OPENS, TABLE_CLOSES, BRACED_NAME, DOTTED_NAME, GETOPT_CALL))
    told = sources.filter(F.col("text").rlike(telling)).withColumn("path", F.coalesce("path", F.lit("")))
    placed = running(
        told,
        ["range_id", "side", "path"],
        "line_no",
        maxes={
            "_open": F.when(F.col("text").rlike(TABLE_OPENS), line),
            "_close": F.when(F.col("text").rlike(TABLE_CLOSES), line),
        },
        bits=bits,
    )
    inside = F.col("_open") > F.coalesce("_close", F.col("_open") - 1)
    names = F.array_compact(F.array(_first(F.col("text"), BRACED_NAME), _first(F.col("text"), DOTTED_NAME)))
    strings = F.regexp_extract_all("text", F.lit(QUOTED), F.lit(1))
    letters = F.flatten(F.transform(strings, lambda s: F.split(F.replace(s, F.lit(":")), "")))
    none = F.array().cast("array<string>")

    def of_kind(kind: str, options: Column) -> Column:
        return F.transform(options, lambda o: F.struct(F.lit(kind).alias("kind"), o.alias("option")))

    called = F.col("text").rlike(GETOPT_CALL)
    found = F.concat(
        of_kind("long", F.when(inside, F.flatten(F.transform(names, lambda n: F.split(n, ",")))).otherwise(none)),
        of_kind("short", F.when(called, letters).otherwise(none)),
        # An option text is one of its file.
        of_kind("text", F.when(called, F.transform(strings, lambda s: F.concat("path", F.lit("\n"), s))).otherwise(none)),
    )
    options = placed.select("range_id", "side", F.explode(found).alias("found")).select("range_id", "side", "found.*")
    sides = options.filter(F.col("option") != "").groupBy("range_id", "kind", "option").agg(
        F.max(F.col("side") == "before").alias("before"),
        F.max(F.col("side") == "after").alias("after"),
    )
    before, after = F.col("before"), F.col("after")
    tests = {"before": before, "after": after, "removed": before & ~after, "added": after & ~before}
    return sides.groupBy("range_id").agg(
        *[F.count_if((F.col("kind") == k) & t).alias(f"{k}_{n}") for k in _KINDS for n, t in tests.items()]
    )


# The names of the result columns.
OPTION_COUNTS = (
    "manual_added_long_count",
    "manual_removed_long_count",
    "removed_short_count",
    "added_short_count",
    "removed_long_count",
    "added_long_count",
    *DIFF_PATTERNS,
    "enhanced_cli_patterns",
)
OPTION_FLAGS = ("cli_changes", "breaking_cli_changes", "api_breaking", "manual_cli_changes")


def option_parts(sources: DataFrame, diff_lines: DataFrame, bits: int = 18) -> list[DataFrame]:
    """Tables of counts, one row per range each, that `option_flags` needs."""
    manual = diff_options(diff_lines).groupBy("range_id", "kind", "option").agg(
        F.max(F.col("sign") == "+").alias("added"), F.max(F.col("sign") == "-").alias("removed")
    )
    is_long = F.col("kind") == "long"
    manual = manual.groupBy("range_id").agg(
        F.count_if(is_long & F.col("added")).alias("manual_added_long_count"),
        F.count_if(is_long & F.col("removed")).alias("manual_removed_long_count"),
        F.count_if(~is_long & F.col("removed") & ~F.col("added")).alias("missing_cases"),
    )
    return [option_sides(sources, bits), manual]


def option_summary(sources: DataFrame, diff_lines: DataFrame, bits: int = 18) -> DataFrame:
    """Counts and flags of command-line changes, one row per range."""
    parts = [*option_parts(sources, diff_lines, bits), diff_patterns(diff_lines)]
    return option_flags(stacked(parts)).select("range_id", *OPTION_FLAGS, *OPTION_COUNTS)


def option_flags(one: DataFrame) -> DataFrame:
    """Add counts and flags to the stacked option parts and diff patterns.

    A side without any option counts as one with a single empty option when
    the other side has some, in the added and removed counts.
    """
    col = F.col

    def count(names: str, own: str, other: str) -> Column:
        empty = (col(f"{names}_{own}") == 0) & (col(f"{names}_{other}") > 0)
        change = "removed" if own == "before" else "added"
        return col(f"{names}_{change}") + empty.cast("long")

    short_changed = (col("short_after") > 0) & (col("text_removed") + col("text_added") > 0)
    long_changed = (col("long_after") > 0) & (col("long_removed") + col("long_added") > 0)
    hints = sum((col(n) for n in (*DIFF_PATTERNS, "enhanced_cli_patterns")), F.lit(0))
    breaking = (
        (col("missing_cases") > 0)
        | (short_changed & (col("short_removed") > 0))
        | (long_changed & (col("long_removed") > 0))
    )
    manual = col("manual_added_long_count") + col("manual_removed_long_count") + hints > 0
    return one.withColumns(
        {
            "removed_short_count": count("short", "before", "after"),
            "added_short_count": count("short", "after", "before"),
            "removed_long_count": count("long", "before", "after"),
            "added_long_count": count("long", "after", "before"),
            "cli_changes": short_changed | long_changed,
            "breaking_cli_changes": breaking,
            "api_breaking": col("removed_prototypes") > 0,
            "manual_cli_changes": manual,
        }
    )
