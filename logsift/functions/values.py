"""Column functions on numbers kept as text and on key=value text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_or_default(text: Column, default: int = 0) -> Column:
    """Whole number with an optional minus sign, else the default."""
    number = F.when(text.rlike(r"\A-?[0-9]+\z"), text.try_cast("long"))
    return F.coalesce(number, F.lit(default).cast("long"))


def int_or_zero(text: Column) -> Column:
    """All digits of the text as one number, 0 if there are none."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def count_text(text: Column) -> Column:
    """Line count as reported by a diff: digits only, anything else (``-``) is 0."""
    number = F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("long"))
    return F.coalesce(number, F.lit(0).cast("long"))


def kv_map(text: Column) -> Column:
    """Map of ``key=value`` lines, split at the first ``=``; the last key wins."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.contains("="))

    def entry(line: Column, place: Column) -> Column:
        key = F.substring_index(line, "=", 1)
        return F.struct(key.alias("key"), place.alias("place"), F.substr(line, F.length(key) + 2).alias("value"))

    # Sorted by key and place, so that the last entry of a key has another key behind it.
    entries = F.array_sort(F.transform(lines, entry))
    following = F.slice(entries, 2, F.greatest(F.size(entries), F.lit(0)))
    last = F.zip_with(entries, following, lambda a, b: F.when(b.isNull() | (a["key"] != b["key"]), a))
    kept = F.filter(last, lambda e: e.isNotNull())
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))
