"""Column functions on log lines.

White space is the six ASCII characters of C ``isspace``; digits and letters
are ASCII. Spark's ``trim`` and Java's ``\\s``/``$`` mean other things, so the
class and the end anchor are written out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.options import CANONICAL_RULES, SCRUB_RULES, START_PHRASES

WHITE = r"[ \t\n\x0B\f\r]"
_REGEX_SPECIAL = set(r"\.^$|?*+()[]{}")


def required_text(pattern: str) -> str:
    """A text that every match of the regex begins with, empty if none is known."""
    if "|" in pattern:
        return ""
    out, rest = "", pattern
    while rest:
        escaped = rest[0] == "\\" and len(rest) > 1 and not rest[1].isalnum()
        one, after = (rest[1], rest[2:]) if escaped else (rest[0], rest[1:])
        if not escaped and one in _REGEX_SPECIAL:
            break
        if after[:1] in ("*", "?"):
            break
        if after[:1] == "{":
            least = re.match(r"\{([0-9]+)", after)
            return out + one * int(least[1]) if least else out
        out, rest = out + one, after
    return out


def _rule(text: Column, pattern: str, replacement: str) -> Column:
    if _REGEX_SPECIAL.isdisjoint(pattern) and not set("$\\") & set(replacement):
        return F.replace(text, F.lit(pattern), F.lit(replacement))
    return F.regexp_replace(text, pattern, replacement)


def apply_rules(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Replace by each (regex, replacement) rule, one after the other."""
    for pattern, replacement in rules:
        text = _rule(text, pattern, replacement)
    return text


def with_rules(
    rows: DataFrame, source: str, name: str, rules: Iterable[tuple[str, str]], where: Column | None = None
) -> DataFrame:
    """`apply_rules` as a new column, with the regexes run only where they can match.

    A regex has to decode the text, a search for its first characters has not.
    Each rule is a projection of its own, so no text is made twice. With
    `where`, other rows get null.
    """
    rows = rows.withColumn(name, F.col(source) if where is None else F.when(where, F.col(source)))
    for pattern, replacement in rules:
        text, needed = F.col(name), required_text(pattern)
        changed = _rule(text, pattern, replacement)
        if needed:
            changed = F.when(text.contains(F.lit(needed)), changed).otherwise(text)
        rows = rows.withColumn(name, changed)
    return rows


def with_canonical(
    rows: DataFrame,
    source: str,
    name: str,
    rules: Iterable[tuple[str, str]] = CANONICAL_RULES,
    where: Column | None = None,
) -> DataFrame:
    """`canonical` as a new column; see `with_rules`."""
    rows = with_rules(rows, source, name, rules, where)
    text = F.col(name)
    uneven = text.contains(F.lit("  "))
    for white in "\t\n\v\f\r":
        uneven = uneven | text.contains(F.lit(white))
    return rows.withColumn(name, F.trim(F.when(uneven, squeeze_white(text)).otherwise(text)))


# --- which lines count ---------------------------------------------------------


def is_tool_line(value: Column) -> Column:
    """Line of the tool: ``==PID==`` with a PID of two or more digits."""
    return value.rlike(r"^==[0-9]{2,}==")


def is_nonblank_tool_line(value: Column) -> Column:
    """Tool line with more than white space after the prefix."""
    return value.rlike(rf"^==[0-9]{{2,}}=={WHITE}*[^ \t\n\x0B\f\r]")


def pid(value: Column) -> Column:
    """PID of a tool line, null elsewhere."""
    found = F.regexp_extract(value, r"^==([0-9]{2,})==", 1)
    return F.when(found != "", found)


def strip_prefix(value: Column) -> Column:
    """Text of a tool line without the prefix and the white space after it."""
    return F.regexp_replace(value, rf"^==[0-9]{{2,}}=={WHITE}*", "")


def strip_tool_prefix(value: Column) -> Column:
    """`strip_prefix` for lines that are known to be tool lines, without a regex."""
    after = F.substr(value, F.locate("==", value, 3) + 2)
    return F.ltrim(after, F.lit(" \t\n\v\f\r"))


def is_marker(value: Column, marker: str) -> Column:
    """Whole line contains the marker, taken literally."""
    return value.contains(F.lit(marker))


def opens_block(text: Column, phrases: Sequence[str] = START_PHRASES) -> Column:
    """Any of the opening phrases occurs."""
    hit = text.contains(F.lit(phrases[0]))
    for phrase in phrases[1:]:
        hit = hit | text.contains(F.lit(phrase))
    return hit


def is_opening_line(value: Column, phrases: Sequence[str] = START_PHRASES) -> Column:
    """Whole line is a tool line whose text opens a block."""
    # No phrase can begin inside the prefix unless its first character occurs there.
    begins_in_prefix = any(p[0] in "=0123456789 \t\n\v\f\r" for p in phrases)
    text = strip_prefix(value) if begins_in_prefix else value
    return opens_block(text, phrases) & is_tool_line(value)


def is_leak_head(text: Column) -> Column:
    """The first number of the line reads ``N bytes in N blocks``."""
    return text.rlike(r"^[^0-9]*[0-9]+ bytes in [0-9]+ blocks")


def has_at(text: Column) -> Column:
    return text.contains(F.lit("at : "))


def has_by(text: Column) -> Column:
    return text.contains(F.lit("by : "))


def has_unknown(text: Column) -> Column:
    return text.rlike(r"\?{3,}")


def is_blank(text: Column) -> Column:
    return F.ltrim(text, F.lit(" \t\n\v\f\r")) == ""


# --- rewriting -----------------------------------------------------------------


def trim_white(text: Column) -> Column:
    return F.regexp_replace(trim_end(text), rf"\A{WHITE}+", "")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WHITE}+\z", "")


def squeeze_white(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WHITE}+", " ")


def canonical(text: Column, rules: Iterable[tuple[str, str]] = CANONICAL_RULES) -> Column:
    """Canonical line: the rules in order, then white space squeezed and trimmed."""
    # After squeezing only plain spaces are left, which is what F.trim removes.
    return F.trim(squeeze_white(apply_rules(text, rules)))


def scrubbed(text: Column, rules: Iterable[tuple[str, str]] = SCRUB_RULES) -> Column:
    """Line as shown: addresses, ``at : ``/``by : `` and ``???`` deleted."""
    return apply_rules(text, rules)


def leading_lines(lines: Column, depth: int) -> Column:
    """First `depth` entries of an array of lines joined by newlines, 0 for all."""
    return F.array_join(F.slice(lines, 1, depth) if depth else lines, "\n")


def ascii_only(text: Column) -> Column:
    """Every non-ASCII character as SUB, which is no letter, digit or space.

    Makes ``\\b`` and case folding mean the same as in the C locale.
    """
    return F.regexp_replace(text, r"[^\x00-\x7F]", "\x1a")


def bytes_as_text(value: Column) -> Column:
    """A character for each byte, so that rules see bytes and change no others.

    All rules are over ASCII, and ASCII stays what it is.
    """
    return F.decode(value.cast("binary"), "ISO-8859-1")


def text_as_bytes(text: Column) -> Column:
    """The bytes that `bytes_as_text` made characters of."""
    return F.encode(text, "ISO-8859-1")


def size_in_bytes(value: Column, exact: bool) -> Column:
    """Bytes of a text, or of one that has a character for each byte."""
    return F.char_length(value) if exact else F.octet_length(value)
