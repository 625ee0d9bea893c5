"""Column functions on file paths."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path classes.
IGNORED, TEST, DOC, SOURCE = 0, 10, 20, 30

# What puts a path into a class.
IGNORED_DIRS = r"(^|/)(build|dist|out|third[_-]?party|vendor|\.git|node_modules|target|bin|obj)(/|\z)"
IGNORED_ENDS = (
    r"\.(lock|exe|dll|so|dylib|a|jar|war|ear|zip|tar|gz|bz2|xz|7z|rar"
    r"|png|jpe?g|gif|bmp|ico|pdf)\z"
)
TEST_DIRS = r"(^|/)(test|tests|unittests|it|e2e)(/|\z)"
TEST_ENDS = r"(_test|\.test|\.spec)\.(c|cc|cpp|cxx|py|js|ts|sh)\z"
SOURCE_DIRS = r"(^|/)(src|source|app|lib|include)(/|\z)"
SOURCE_ENDS = (
    r"\.(c|cc|cpp|cxx|h|hh|hpp|inl|go|rs|java|cs|m|mm|swift|kt|ts|tsx|js|jsx"
    r"|sh|py|rb|php|pl|lua|sql|cmake|yml|yaml)\z"
)
SOURCE_NAMES = r"(^|/)(CMakeLists\.txt|Makefile|makefile|GNUmakefile)\z"
DOC_DIRS = r"(^|/)(doc|docs|documentation|examples)(/|\z)"
DOC_NAMES = r"(^|/)(readme|changelog|contributing|license|copying|authors|install|news|history)"
DOC_ENDS = r"\.(md|markdown|mkd|rst|adoc|txt)\z"

# Paths looked at for command-line options unless told otherwise.
C_FAMILY_GLOBS = tuple(f":(glob)**/*.{end}" for end in ("c", "cc", "cpp", "cxx", "h", "hh", "hpp"))

# Fixed value: characters a path must not contain.
DANGEROUS_CHARACTERS = "`$(){}[]|&;<>\"'\\"


def _any(text: Column, *patterns: str) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def path_class(path: Column) -> Column:
    """30 source, 10 test, 20 documentation, 0 anything else or ignored."""
    return (
        F.when(_any(path, IGNORED_DIRS, IGNORED_ENDS), IGNORED)
        .when(_any(path, TEST_DIRS, TEST_ENDS), TEST)
        .when(_any(path, SOURCE_DIRS, SOURCE_ENDS, SOURCE_NAMES), SOURCE)
        .when(_any(F.lower(path), DOC_DIRS, DOC_NAMES, DOC_ENDS), DOC)
        .otherwise(IGNORED)
    )


def path_verdict(path: Column) -> Column:
    """First rule a path breaks: empty_or_nul, dangerous, absolute, traversal; else ok."""
    dangerous = "[" + "".join("\\" + c for c in DANGEROUS_CHARACTERS) + "]"
    absolute = path.startswith("/") | path.rlike(r"^[\x00-\x7F]:[/\\]")
    return (
        F.when(path == "-", "ok")
        .when((path == "") | path.contains(F.lit("\0")), "empty_or_nul")
        .when(path.rlike(dangerous), "dangerous")
        .when(absolute, "absolute")
        .when(path.contains(".."), "traversal")
        .otherwise("ok")
    )


def glob_regex(glob: str, slash: bool = True) -> str:
    """Shell glob as a regex over the whole text; `slash`: ``*`` crosses ``/``."""
    any_one = "." if slash else "[^/]"
    out, rest = [], glob
    while rest:
        if not slash and rest.startswith("**/"):
            out.append("(?:.*/)?")
            rest = rest[3:]
        elif not slash and rest.startswith("**"):
            out.append(".*")
            rest = rest[2:]
        elif found := re.match(r"\[([!^]?)(\]?[^\]]*)\]", rest):
            body = found[2].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            body = "\\" + body if body.startswith(("]", "^")) else body
            out.append(f"[{'^' if found[1] else ''}{body}]")
            rest = rest[found.end() :]
        else:
            one = rest[0]
            known = {"*": any_one + "*", "?": any_one}
            out.append(known.get(one) or ("\\" + one if not one.isalnum() and one.isascii() else one))
            rest = rest[1:]
    return rf"(?s)\A{''.join(out)}\z"


def pathspec_regex(spec: str) -> str:
    """One path filter: a file, a directory or a glob, ``:(glob)`` for strict globs."""
    if spec.startswith(":(glob)"):
        return glob_regex(spec.removeprefix(":(glob)"), slash=False)
    if re.search(r"[*?\[]", spec):
        return glob_regex(spec)
    literal = glob_regex(spec.rstrip("/"))
    return literal.removesuffix(r"\z") + r"(?:/.*)?\z"


def split_specs(specs: str | Sequence[str]) -> tuple[list[str], list[str]]:
    """Comma-separated filters as (include, exclude); ``!`` excludes."""
    parts = specs.split(",") if isinstance(specs, str) else list(specs)
    parts = [p.strip(" \t\n\v\f\r") for p in parts]
    include = [p for p in parts if p and not p.startswith("!")]
    return include, [p[1:] for p in parts if p.startswith("!") and len(p) > 1]


def path_selected(
    path: Column, only: str | Sequence[str] = "", exclude: str | Sequence[str] = ""
) -> Column:
    """Path passes the include filters (none means all) and no exclude filter."""
    include, negated = split_specs(only)
    negated += split_specs(exclude)[0]
    chosen = F.lit(True)
    if include:
        chosen = _any(path, *map(pathspec_regex, include))
    if negated:
        chosen = chosen & ~_any(path, *map(pathspec_regex, negated))
    return chosen
