"""Tables from the text that git prints, against the tables the text was printed from."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logsift.sources import git_text as gt

DIFF = r'''diff --git a/src/a.c b/src/a.c
index 1..2 100644
--- a/src/a.c
+++ b/src/a.c
@@ -1,3 +1,4 @@ int f()
 one
--- two
+++ zwei
+@@ -9 +9 @@
 three
@@ -10 +11 @@
-old
\ No newline at end of file
+new
\ No newline at end of file
diff --git a/gone.txt b/gone.txt
deleted file mode 100644
--- a/gone.txt
+++ /dev/null
@@ -1,2 +0,0 @@
-x
-diff --git a/no b/no
diff --git "a/caf\303\251 \"q\".txt" "b/caf\303\251 \"q\".txt"
new file mode 100644
--- /dev/null
+++ "b/caf\303\251 \"q\".txt"
@@ -0,0 +1 @@
+été
diff --git a/a b.c b/c d.c
similarity index 90%
rename from a b.c
rename to c d.c
--- a/a b.c	
+++ b/c d.c	
@@ -5,2 +5,2 @@
 
-t	ab
+tab
diff --git a/bin b/bin
Binary files a/bin and b/bin differ'''

WANT = [
    ("src/a.c", " ", "one"), ("src/a.c", "-", "-- two"), ("src/a.c", "+", "++ zwei"), ("src/a.c", "+", "@@ -9 +9 @@"),
    ("src/a.c", " ", "three"), ("src/a.c", "-", "old"), ("src/a.c", "+", "new"), ("gone.txt", "-", "x"),
    ("gone.txt", "-", "diff --git a/no b/no"), ('café "q".txt', "+", "été"), ("c d.c", " ", ""), ("c d.c", "-", "t\tab"), ("c d.c", "+", "tab"),
]


def _lines(spark, text, log="r1"):
    rows = [(log, n, line) for n, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "log_id string, line_no long, value string").repartition(3)


@pytest.mark.parametrize("bits", [2, 18])
def test_diff(spark, bits):
    got = gt.diff_rows(_lines(spark, DIFF).union(_lines(spark, DIFF, "r2")), bits).orderBy("range_id", "line_no").collect()
    assert [(r.path, r.sign, r.text) for r in got if r.range_id == "r1"] == WANT
    assert [(r.path, r.sign, r.text) for r in got if r.range_id == "r2"] == WANT
    assert len({r.hunk for r in got}) == 5
    assert gt.diff_rows(_lines(spark, "")).collect() == []


def test_random_diffs(spark):
    """Printed hunk by hunk from known lines, some of which look like headers."""
    rng = random.Random(4)
    odd = ["", "- x", "++ y", "@@ -1 +1 @@", "diff --git a/x b/x", "-- a/f", "++ b/f", "\\ No newline"]
    out, want = [], []
    for f in range(20):
        out += [f"diff --git a/f{f} b/f{f}", "index 0..1", f"--- a/f{f}", f"+++ b/f{f}"]
        for h in range(rng.randrange(1, 4)):
            body = [(rng.choice("+- "), rng.choice([*odd, f"line {h}"])) for _ in range(rng.randrange(1, 9))]
            old, new = (sum(s in (" ", mark) for s, _ in body) for mark in "-+")
            shown = [f",{n}" if n != 1 else "" for n in (old, new)]
            out.append(f"@@ -{h}{shown[0]} +{h}{shown[1]} @@ rest")
            out += [s + t for s, t in body]
            want += [(f"f{f}", s, t) for s, t in body]
    got = gt.diff_rows(_lines(spark, "\n".join(out)), 3).orderBy("line_no").collect()
    assert [(r.path, r.sign, r.text) for r in got] == want


def test_summaries(spark):
    numstat = '1\t2\tsrc/a.c\n-\t-\tbin\n0\t3\tsrc/{old => new}/f.c\n4\t0\ta.c => b.c\n5\t5\tlib/{ => x}/g.c\n1\t0\t"t\\tab"\nnoise'
    got = gt.numstat_rows(_lines(spark, numstat)).collect()
    assert {(r.path, r.new_path) for r in got} == {
        ("src/a.c", None), ("bin", None), ("src/old/f.c", "src/new/f.c"), ("a.c", "b.c"), ("lib/g.c", "lib/x/g.c"), ("t\tab", None),
    }
    status = 'M\tsrc/a.c\nA\t"caf\\303\\251"\nR100\told\tnew\nC075\ta\tb\n'
    got = gt.name_status_rows(_lines(spark, status)).collect()
    want = {("M", "src/a.c", None), ("A", "café", None), ("R100", "old", "new"), ("C075", "a", "b")}
    assert {(r.status, r.path, r.new_path) for r in got} == want
    packed = "M\0src/a.c\0A\0café\0R100\0old\0new\0C075\0a\0b\0A\0M\0D\0R100\0"
    texts = spark.createDataFrame([("r1", packed), ("r2", ""), ("r3", None)], "range_id string, value string")
    got = gt.name_status_z_rows(texts).collect()
    assert {(r.status, r.path, r.new_path) for r in got} == want | {("A", "M", None), ("D", "R100", None)}


LOG = """commit 0123456789abcdef0123456789abcdef01234567 (HEAD -> main)
Author: A B <a@b.c>
Date:   2024-03-01T10:00:00+01:00

    Fix the leak
    in two lines

    More about it.
    commit 99999999 is no header

    Date: none

commit aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa
Merge: 0123456 bbbbbbb
Author: C
Date:   2024-02-01T00:00:00Z

    Merge branch

commit bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb
Author: D
AuthorDate: 2020-01-01T00:00:00Z
Commit:     E
CommitDate: 2021-01-01T00:00:00Z
"""


@pytest.mark.parametrize("bits", [2, 18])
def test_log(spark, bits):
    got = gt.log_rows(_lines(spark, LOG), bits).withColumn("at", F.unix_seconds("committed_at")).collect()
    rows = {r.commit_id[:2]: r for r in got}
    at = lambda *d: int(dt.datetime(*d, tzinfo=dt.timezone.utc).timestamp())
    assert (rows["01"].subject, rows["01"].is_merge, rows["01"].at) == ("Fix the leak in two lines", False, at(2024, 3, 1, 9))
    assert rows["01"].body == "More about it.\ncommit 99999999 is no header\n\nDate: none"
    assert (rows["aa"].subject, rows["aa"].body, rows["aa"].is_merge) == ("Merge branch", "", True)
    assert (rows["bb"].subject, rows["bb"].at) == ("", at(2021, 1, 1))
    assert len(got) == 3
