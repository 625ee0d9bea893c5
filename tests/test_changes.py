import re

import pytest
from pyspark.sql import functions as F

from logsift import schemas
from logsift.functions import keywords as kw
from logsift.functions import paths as pt
from logsift.operators import changes as ch
from logsift.operators import cli_options as co
from logsift.operators import commits as cm
from logsift.operators import quality as ql

CLASSES = {
    "guide/Setup.md": 20, "README.fr": 20, "engine/loop.cpp": 30, "engine/loop.hh": 30, "tools/gen.cc": 30,
    "lib/mix.c": 30, "tests/mix_check.c": 10, "src/test/probe.cpp": 10, "check.spec.js": 10,
    "build/loop.o": 0, "vendor/mix/mix.c": 0, "third_party/zip.c": 0, "deps.lock": 0, "": 0, "art.png": 0,
    "engine/CMakeLists.txt": 30, "words.rst": 20, "lib": 30, "mix.c\n": 0,
}


def test_path_classes(column):
    assert column(pt.path_class, list(CLASSES)) == list(CLASSES.values())


def test_path_verdicts(column):
    paths = ["test.txt", "-", "/etc/passwd", "../secret.txt", "file\0.txt", "file`with`x", "a$(b)", "", "C:/x", "é:/x", "a\\b", "a[0]"]
    assert column(pt.path_verdict, paths) == [
        "ok", "ok", "absolute", "traversal", "empty_or_nul", "dangerous", "dangerous", "empty_or_nul", "absolute", "ok",
        "dangerous", "dangerous",
    ]


def test_path_audit(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("/x",)], "path string")
    assert sorted(map(tuple, ql.path_audit(rows).collect())) == [("absolute", 1), ("ok", 2)]


@pytest.mark.parametrize(
    ("spec", "yes", "no"),
    [
        ("src", ["src", "src/a/b.c"], ["srcs/a", "x/src"]),
        ("src/", ["src/a"], ["src2"]),
        ("*.c", ["a.c", "d/e.c"], ["a.cc", "a.c/x"]),
        ("src/?.h", ["src/a.h"], ["src/ab.h"]),
        ("[!a-c]*", ["d.x"], ["a.x"]),
        ("a+b(c)", ["a+b(c)"], ["aab(c)"]),
        (":(glob)**/*.c", ["a.c", "x/y/a.c"], ["a.cpp"]),
        (":(glob)src/*.c", ["src/a.c"], ["src/x/a.c"]),
    ],
)
def test_pathspecs(column, spec, yes, no):
    assert column(lambda p: pt.path_selected(p, spec), yes + no) == [True] * len(yes) + [False] * len(no)
    assert re.fullmatch(r"\(\?s\)\\A.*\\z", pt.pathspec_regex(spec), re.S)


def test_path_filters(column):
    paths = ["src/a.c", "src/x/b.c", "doc/c.md", "include/d.h"]
    assert column(lambda p: pt.path_selected(p, " src , include,,!src/x/*"), paths) == [True, False, False, True]
    assert column(lambda p: pt.path_selected(p, "", "doc, src/x"), paths) == [True, False, False, True]
    assert column(lambda p: pt.path_selected(p), paths) == [True] * 4


def test_file_change_summary(spark):
    rows = [
        ("r1", "A", "src/a.c", None, "10", "0"), ("r1", "A", "tests/t.py", None, "5", "0"),
        ("r1", "A", "README.md", None, "-", "-"), ("r1", "R100", "src/o.c", "src/n.c", "0", "0"),
        ("r1", "C75", "a", "b", "1", "1"), ("r1", "T", "x", None, "", None), ("r1", "D", "gone.c", None, "0", "7"),
        ("r1", "X", "y", None, "1x", "2"), ("r2", "M", "src/a.c", None, "3", "4"),
    ]
    got = {r["range_id"]: r.asDict() for r in ch.file_change_summary(spark.createDataFrame(rows, schemas.FILE_CHANGES)).collect()}
    assert got["r1"] == {
        "range_id": "r1", "added_files": 3, "modified_files": 4, "deleted_files": 1, "new_source_files": 1,
        "new_test_files": 1, "new_doc_files": 1, "insertions": 16, "deletions": 10, "diff_size": 26,
    }
    assert (got["r2"]["modified_files"], got["r2"]["diff_size"]) == (1, 7)


def _diff(spark, texts, range_id="r"):
    rows = [(range_id, "a.c", n, t[:1], t[1:]) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, schemas.DIFF_LINES)


def _commits(spark, messages):
    rows = [("r", str(n), None, False, s, b) for n, (s, b) in enumerate(messages)]
    return spark.createDataFrame(rows, schemas.COMMITS)


def test_keywords_by_line(spark):
    diff = _diff(
        spark,
        ["+// CLI BREAKING and CLI-BREAKING", "-  # api breaking: x", "+/* NEWFEATURE", "+ security", "+x = 1; // security fix",
         "+//ſecurity", "-- removed\toptions", "+#added options", "+// REMOVED\u00a0OPTION"],
    )
    messages = [
        ("Breaking: the CLI", ""), ("breaking", "api"), ("Feature(s) — added", "BREAKING CHANGE\nsecurity\ncve 2024-1"),
        ("BREAKING… MAJOR", None),
    ]
    got = ch.keyword_counts(diff, _commits(spark, messages)).first().asDict()
    want = {
        "cli_breaking_keywords": 1, "api_breaking_keywords": 1, "new_feature_keywords": 1, "security_keywords": 1,
        "removed_options_keywords": 1, "added_options_keywords": 1, "commit_cli_breaking": 1, "commit_api_breaking": 1,
        "commit_general_breaking": 2, "commit_new_feature": 1, "commit_security": 2, "total_security": 3,
        "has_general_breaking": True, "has_removed_options": True,
    }
    assert {k: got[k] for k in want} == want


def test_security_by_occurrence(spark):
    diff = _diff(
        spark,
        ["+token token tokens", "+++ b/secret", "+", "-CVE-2024-1234 use-after free", "+core  dump, segfault", "+sessionhijacking dos doz", "+ x.509 x5509"],
    )
    commits = _commits(spark, [("Fix xss", "path\ntraversal\npath  traversal"), ("vulnérable vuln", "")])
    got = ch.security_score(ch.security_counts(diff, commits)).first().asDict()
    assert got == {
        "range_id": "r", "security_keywords": 4, "security_patterns": 7, "cve_patterns": 1, "memory_safety_issues": 1,
        "crash_fixes": 2, "total_security_score": 4 + 7 + 3 + 2 + 2, "risk": "high",
    }
    added = ch.security_counts(diff, commits, added_only=True).first()
    assert (added["security_patterns"], added["cve_patterns"], added["crash_fixes"]) == (6, 0, 2)
    light = ch.security_score(ch.security_counts(diff, commits), {"security_patterns": 0, "cve_patterns": 0, "memory_safety_issues": 0}).first()
    assert (light["total_security_score"], light["risk"]) == (6, "medium")


def test_risk_bands(spark):
    scores = spark.createDataFrame([(s,) for s in (0, 1, 4, 5, 14, 15)], "s int")
    bands = [r[0] for r in scores.select(kw.risk_band(F.col("s"))).collect()]
    assert bands == ["none", "low", "low", "medium", "medium", "high"]


def test_space_only_changes(spark):
    texts = ["-a b", "+ab", "-x", "+y", "+a  b ", " ctx", "-}", "-}", "+ }", "-z"]
    left = ch.without_space_changes(_diff(spark, texts), bits=4).orderBy("line_no").collect()
    assert [r["sign"] + r["text"] for r in left] == ["-x", "+y", "+a  b ", " ctx", "-}", "-z"]
    counts = ch.space_only_changes(_diff(spark, texts)).first().asDict()
    assert (counts["space_only_pairs"], counts["added_kept"], counts["removed_kept"]) == (2, 2, 3)


def test_added_lines_and_merges(spark):
    assert [r["text"] for r in ch.added_lines(_diff(spark, ["+a", "+++ b", "-c", "++x"])).collect()] == ["a", "+x"]
    rows = [("r", "1", None, True, "m", ""), ("r", "2", None, False, "c", "")]
    assert ch.without_merges(spark.createDataFrame(rows, schemas.COMMITS)).count() == 1


BEFORE = """#include <getopt.h>
static struct option opts[] = {
  { "help", no_argument, 0, 'h' },
  { .name = "depth", required_argument },
};
  { "outside", 0 }
c = getopt_long(argc, argv, "hd:", opts);"""
AFTER = """static struct option opts[] = {
  { "help", no_argument, 0, 'h' }, { "second", 1 }
  { "a,b", 1 }
};  struct option x = {
 { "tail", 1 }
};
c = getopt (argc, argv, "hv"); d = getopt(argc, argv, "x:");"""


def _sources(spark):
    rows = []
    for side, text in (("before", BEFORE), ("after", AFTER)):
        rows += [("r", side, "main.c", n, line) for n, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, schemas.OPTION_SOURCES)


def test_option_changes(spark):
    got = sorted(tuple(r)[1:] for r in co.option_changes(_sources(spark), bits=4).collect())
    assert got == [
        ("long", "a", "added"), ("long", "b", "added"), ("long", "depth", "removed"),
        ("short", "d", "removed"), ("short", "v", "added"), ("short", "x", "added"),
    ]


DIFF = ["-case 'd': f();", "+case 'v': g();", "-case 'h': f();", "+case 'h': f2();", "-int old(int a, char *b);", "-typedef int t(int);",
        "+if (argc > 2) use(argv[1]);", "+// --commented", '+puts("--quoted");', "+x = --flag-a;", "- y --flag-b --flag-c",
        "+int main(int argc, char **argv) {", "+print usage", "-getopt_long (a"]


def test_option_summary(spark):
    got = co.option_summary(_sources(spark), _diff(spark, DIFF), bits=4).first().asDict()
    assert got == {
        "range_id": "r", "cli_changes": True, "breaking_cli_changes": True, "api_breaking": True, "manual_cli_changes": True,
        "manual_added_long_count": 1, "manual_removed_long_count": 1, "removed_short_count": 1, "added_short_count": 2,
        "removed_long_count": 1, "added_long_count": 2, "getopt_changes": 1, "arg_parsing_changes": 2, "help_text_changes": 1,
        "main_signature_changes": 1, "enhanced_cli_patterns": 4,
    }


def test_one_empty_side_counts_as_one_option(spark):
    only_after = _sources(spark).filter("side = 'after'")
    got = co.option_summary(only_after, _diff(spark, [" x"])).first()
    assert (got["removed_short_count"], got["added_short_count"]) == (1, 3)
    assert (got["removed_long_count"], got["added_long_count"]) == (1, 3)
    assert got["cli_changes"] and not got["breaking_cli_changes"] and not got["manual_cli_changes"]


def test_commit_tables(spark):
    import datetime as dt

    def day(d, h=12):
        return dt.datetime(2024, 1, d, h)

    rows = [("r1", "a", day(1), False, "fix leak", ""), ("r1", "b", day(3), False, "token", ""), ("r1", "c", day(2), False, "xss", ""),
            ("r1", "d", day(4), False, "nothing", "")]
    commits = spark.createDataFrame(rows, schemas.COMMITS)
    ranges = spark.createDataFrame([("r1",), ("r2",)], "range_id string")
    assert sorted(map(tuple, cm.commit_counts(ranges, commits).collect())) == [("r1", 4, True), ("r2", 0, False)]
    top = cm.top_security_subjects(commits, 2).orderBy("place").collect()
    assert [r["subject"] for r in top] == ["token", "xss"]
    history = commits.select(F.col("range_id").alias("repo"), "commit_id", "committed_at")
    bases = {d: tuple(cm.base_by_day(history, d).first())[1:] for d in ("2024-01-02", "2023-12-31", "2025-01-01")}
    assert bases == {"2024-01-02": ("c", "date"), "2023-12-31": ("a", "first"), "2025-01-01": ("d", "date")}


def test_context_lines_do_not_count(spark):
    """Words and patterns in unchanged lines are no change; security words keep their context."""
    lines = [" // CLI BREAKING", " getopt(argc, argv", " // SECURITY fix", "+x", " buffer overflow"]
    diff = _diff(spark, lines)
    none = _commits(spark, [])
    words = ch.keyword_counts(diff, none).first()
    assert words["cli_breaking_keywords"] == words["security_keywords"] == 0
    assert co.diff_patterns(diff).first()["getopt_changes"] == 0
    assert ch.security_counts(diff, none).first()["memory_safety_issues"] == 1


def test_nulls_keep_their_rows(spark):
    diff = spark.createDataFrame(
        [("r", None, 1, "+", "a b"), ("r", None, 2, "-", "ab"), ("r", None, 3, "+", "new"), (None, "p", 4, "-", "gone")],
        schemas.DIFF_LINES,
    )
    assert sorted(r["line_no"] for r in ch.without_space_changes(diff, bits=4).collect()) == [3, 4]
    rows = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, is_merge boolean")
    assert sorted(r["id"] for r in ch.without_merges(rows).collect()) == [1, 3]


def test_base_by_range(spark):
    """Against a plain search: ties, repos without commits, days before all, null days, hot repos in chunks."""
    import datetime as dt
    import random

    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    history = [("hot", i, start + dt.timedelta(hours=rng.randrange(24 * 400))) for i in range(500)]
    history += [("hot", 900, dt.datetime(2024, 5, 5, 23, 59, 59, 999999)), ("hot", 901, dt.datetime(2024, 5, 6))]
    history += [("tie", 1, start), ("tie", 3, start), ("tie", 2, start), ("one", 7, dt.datetime(2024, 3, 1)), (None, 8, start), ("one", 5, None)]
    ranges = [(f"r{i}", rng.choice(["hot", "tie", "one", "none", None]), start.date() + dt.timedelta(days=rng.randrange(-5, 420))) for i in range(120)]
    ranges += [("null day", "hot", None), ("edge", "hot", dt.date(2024, 5, 5)), ("edge2", "hot", dt.date(2024, 5, 6)), ("edge", "hot", dt.date(2024, 5, 5))]
    want = []
    for name, repo, day in ranges:
        own = sorted((at, c) for r, c, at in history if r == repo and at)
        until = [x for x in own if day and x[0].date() <= day]
        kind = "date" if until else "first" if own else "none"
        want.append((name, until[-1][1] if until else own[0][1] if own else None, kind))
    left = spark.createDataFrame(ranges, "range_id string, repo string, day date")
    right = spark.createDataFrame(history, "repo string, commit_id long, committed_at timestamp")
    for bits in (38, 41, 60):
        got = cm.base_by_range(left.repartition(3), right.repartition(4), bits).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert cm.base_by_range(left.limit(0), right).collect() == []
    assert {r.ref_type for r in cm.base_by_range(left, right.limit(0)).collect()} == {"none"}
