"""Column functions on version texts and version arithmetic.

Digit runs may be of any length: they are compared as (length, digits), never
cast to a number, except where the arithmetic needs one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The version grammar.
CORE = r"(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)"
PRERELEASE = r"(-[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?"
BUILD = r"(\+[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?"
PLAIN = r"\A([0-9]+)\.([0-9]+)\.([0-9]+)\z"

# Per bump, the base delta, the lines per further step of the
# delta, and the lines that double the bonus.
BUMPS = {"patch": (1, 250, 250), "minor": (5, 100, 500), "major": (10, 100, 1000)}

# First version of each bump after 0.0.0, and the carry limit.
FIRST_VERSIONS = {"patch": "0.0.1", "minor": "0.1.0", "major": "1.0.0"}
CARRY_AT = 1000


# --- grammar and parts ---------------------------------------------------------


def is_core(version: Column) -> Column:
    """X.Y.Z without leading zeros."""
    return version.rlike(rf"\A{CORE}\z")


def is_core_or_prerelease(version: Column) -> Column:
    return version.rlike(rf"\A{CORE}{PRERELEASE}\z")


def is_full(version: Column) -> Column:
    """X.Y.Z with optional pre-release and build parts."""
    return version.rlike(rf"\A{CORE}{PRERELEASE}{BUILD}\z")


def strip_build(version: Column) -> Column:
    return F.substring_index(version, "+", 1)


def is_prerelease(version: Column) -> Column:
    return strip_build(version).contains("-")


def prerelease(version: Column) -> Column:
    """Pre-release identifiers as text, empty for a release."""
    return F.regexp_extract(strip_build(version), r"(?s)\A[^-]*-(.*)\z", 1)


def core_part(version: Column, index: int) -> Column:
    """Major (1), minor (2) or patch (3) digits; null if they are not digits."""
    core = F.substring_index(strip_build(version), "-", 1)
    part = F.regexp_extract(core, PLAIN, index)
    return F.when(part != "", part)


def core_numbers(version: Column) -> list[Column]:
    return [core_part(version, i).try_cast("long") for i in (1, 2, 3)]


def to_tag(version: Column) -> Column:
    """x.y.z or vx.y.z as vx.y.z, null for anything else."""
    digits = F.regexp_extract(version, r"\Av?([0-9]+\.[0-9]+\.[0-9]+)\z", 1)
    return F.when(digits != "", F.concat(F.lit("v"), digits))


# --- order ---------------------------------------------------------------------


def _digits_key(digits: Column) -> Column:
    bare = F.regexp_replace(digits, r"\A0+", "")
    return F.struct(F.length(bare).alias("size"), bare.alias("digits"))


def _identifier_key(identifier: Column) -> Column:
    number = identifier.rlike(r"\A(0|[1-9][0-9]*)\z")
    return F.struct(
        (~number).alias("is_text"),
        F.when(number, F.length(identifier)).otherwise(0).alias("size"),
        identifier.alias("txt"),
    )


def version_key(version: Column) -> Column:
    """Sortable key of semantic-version precedence; build parts do not count.

    Null if the core is not three runs of digits.
    """
    pre = prerelease(version)
    identifiers = F.when(pre != "", F.transform(F.split(pre, r"\."), _identifier_key))
    key = F.struct(
        _digits_key(core_part(version, 1)).alias("major"),
        _digits_key(core_part(version, 2)).alias("minor"),
        _digits_key(core_part(version, 3)).alias("patch"),
        (pre == "").alias("is_release"),
        identifiers.alias("identifiers"),
    )
    return F.when(core_part(version, 1).isNotNull(), key)


def compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1 by precedence."""
    a, b = version_key(left), version_key(right)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def refname_key(tag: Column) -> Column:
    """Text that sorts like tag names in version order; null for null.

    Runs of digits compare as numbers, everything else as text, and a name
    that goes on is greater: v1.0.0-rc.1 comes after v1.0.0. Names must be free
    of control characters, as tag names are.
    """
    runs = F.regexp_extract_all(tag, F.lit(r"[^0-9]*[0-9]+|[^0-9]+"), F.lit(0))

    def key(run: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(run, r"([0-9]*)\z", 1), r"\A0+", "")
        # A text before digits gets a "0": it then compares as those digits would.
        words = F.regexp_replace(run, r"[0-9]+\z", "0")
        size = F.lpad(F.length(digits).cast("string"), 10, "0")
        return F.concat(words, F.lit("\x01"), size, digits)

    return F.array_join(F.transform(runs, key), "")


def matches_release_prefix(tag: Column, prefix: str) -> Column:
    """Tag is the literal prefix followed by something like N.N.N."""
    rest = F.substr(tag, F.lit(len(prefix) + 1))
    return tag.startswith(F.lit(prefix)) & rest.rlike(r"(?s)\A[0-9].*\.[0-9].*\.[0-9]")


# --- arithmetic ----------------------------------------------------------------


def int_div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def round_div(a: Column, b: Column | int) -> Column:
    """a / b to the nearest whole number, halves up; both are not negative."""
    half = b // 2 if isinstance(b, int) else int_div(b, 2)
    return int_div(a + half, b)


def fixed2(hundredths: Column) -> Column:
    """Hundredths as d.dd."""
    return F.format_string("%d.%02d", int_div(hundredths, 100), hundredths % 100)


def _by_bump(bump: Column, value) -> Column:
    out = F
    for name, rule in BUMPS.items():
        out = out.when(bump == name, value(*rule))
    return out


def base_delta(bump: Column, loc: Column) -> Column:
    return _by_bump(bump, lambda base, step, _: F.lit(base) + round_div(loc, step))


def bonus_multiplier(bump: Column, loc: Column) -> Column:
    return _by_bump(bump, lambda _b, _s, double: fixed2(round_div(100 * (double + loc), double)))


def total_bonus(bump: Column, loc: Column, bonus: Column) -> Column:
    return bonus + _by_bump(bump, lambda _b, _s, double: round_div(bonus * loc, double))


def total_delta(bump: Column, loc: Column, bonus: Column) -> Column:
    """Base delta and grown bonus together, at least 1."""
    return F.greatest(base_delta(bump, loc) + total_bonus(bump, loc, bonus), F.lit(1).cast("long"))


def rolled(major: Column, minor: Column, patch: Column, delta: Column, at: int = CARRY_AT) -> Column:
    """X.Y.Z with delta added to Z and carries taken at `at`."""
    new_patch = patch + delta
    new_minor = minor + int_div(new_patch, at)
    new_major = major + int_div(new_minor, at)
    return F.concat_ws(".", new_major, new_minor % at, new_patch % at)
