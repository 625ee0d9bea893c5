import itertools
import random

import pytest
from pyspark.sql import functions as F

from logsift import schemas
from logsift.functions import versions as vs
from logsift.operators import score as sc
from logsift.operators import tags as tg
from logsift.plans import release
from logsift.sources import tables
from logsift.sources.weights import default_weights, weight_struct

# current, bump, loc, bonus, base delta, multiplier, total bonus, total delta, next
MATH = [
    ("0.4.17", "patch", 750, 8, 4, "4.00", 32, 36, "0.4.53"),
    ("3.0.980", "patch", 250, 12, 2, "2.00", 24, 26, "3.1.6"),
    ("7.1.0", "minor", 1500, 4, 20, "4.00", 16, 36, "7.1.36"),
    ("5.999.990", "minor", 0, 6, 5, "1.00", 6, 11, "6.0.1"),
    ("2.5.8", "major", 3000, 9, 40, "4.00", 36, 76, "2.5.84"),
    ("2.5.8", "major", 500, 0, 15, "1.50", 0, 15, "2.5.23"),
    ("0.0.0", "PATCH", 40, 2, 0, "1.00", 0, 0, "0.0.1"),
    ("none", "minor", 3, 2, 0, "1.00", 0, 0, "0.1.0"),
    ("0.0.0", "major", 8, 5, 0, "1.00", 0, 0, "1.0.0"),
]


def as_number(version):
    """Versions in base 1000: a patch delta is added to this number."""
    major, minor, patch = map(int, version.split("."))
    return (major * 1000 + minor) * 1000 + patch


def test_version_math(spark):
    rows = spark.createDataFrame([(i, *m[:4]) for i, m in enumerate(MATH)], "i int, current_version string, bump string, loc long, bonus long")
    got = sc.next_version_rollover(rows).orderBy("i").collect()
    names = ("base_delta", "bonus_multiplier", "total_bonus_points", "total_delta", "next_version")
    assert [tuple(r[n] for n in names) for r in got] == [m[4:] for m in MATH]
    with pytest.raises(ValueError):
        sc.next_version_rollover(rows, carry_at=0)


def test_rollover(spark):
    rng = random.Random(11)
    parts = lambda: (rng.randrange(40), rng.choice([0, 7, 998, 999, rng.randrange(1000)]), rng.choice([0, 993, 999, rng.randrange(1000)]))
    cases = [(i, ".".join(map(str, parts())), "patch", rng.choice([0, 1, 2, 30, 999, 1000, 4321])) for i in range(60)]
    rows = spark.createDataFrame(cases, "i int, current_version string, bump string, delta long")
    got = sc.next_version_direct(rows).collect()
    assert {r["i"]: as_number(r["next_version"]) for r in got} == {i: as_number(v) + d for i, v, _, d in cases}
    assert all(int(part) < 1000 for r in got for part in r["next_version"].split(".")[1:])


def test_direct_bumps(spark):
    rows = spark.createDataFrame([("1.2.3", "minor", 5), ("1.998.3", "Minor", 5), ("1.2.3", "major", 10), ("x", "major", 1)], "current_version string, bump string, delta long")
    cleared = [r["next_version"] for r in sc.next_version_direct(rows).collect()]
    assert cleared == ["1.7.0", "2.3.0", "11.0.0", None]
    kept = sc.next_version_direct(rows, keep_patch_on_minor=True, keep_lower_on_major=True).collect()
    assert [r["next_version"] for r in kept] == ["1.7.3", "2.3.3", "11.2.3", None]


def test_grammar(column):
    texts = ["1.2.3", "01.2.3", "1.2", "1.2.3-rc.1", "1.2.3-rc..1", "1.2.3+b.1", "1.2.3-a+b", "v1.2.3", "1.2.3\n"]
    assert column(vs.is_core, texts) == [True] + [False] * 8
    assert column(vs.is_core_or_prerelease, texts) == [True, False, False, True] + [False] * 5
    assert column(vs.is_full, texts) == [True, False, False, True, False, True, True, False, False]
    assert column(vs.is_prerelease, ["1.2.3", "1.2.3-a", "1.2.3+a-b"]) == [False, True, False]
    assert column(vs.to_tag, ["1.2.3", "v01.2.3", "vv1.2.3", "1.2"]) == ["v1.2.3", "v01.2.3", None, None]
    assert column(lambda v: vs.core_part(v, 3), ["1.2.30-x+y", "1.2", "a.b.c"]) == ["30", None, None]


PRECEDENCE = ["0.9.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11",
              "1.0.0-rc.1", "1.0.0", "1.0.1", "1.1.0", "1.10.0", "2.0.0", "99999999999999999999999.0.0"]


def test_precedence(spark):
    pairs = list(itertools.product(range(len(PRECEDENCE)), repeat=2))
    rows = spark.createDataFrame([(i, j, PRECEDENCE[i] + "+x", PRECEDENCE[j]) for i, j in pairs], "i int, j int, a string, b string")
    for r in rows.select("i", "j", vs.compare(F.col("a"), F.col("b")).alias("c")).collect():
        assert r["c"] == (r["i"] > r["j"]) - (r["i"] < r["j"]), r


NAMES = ["a-1", "a1", "ab1", "v0.9.10", "v1.0", "v1.0.0", "v1.0.0-rc-1", "v1.0.0-rc.2", "v1.0.0-rc.10", "v1.0.0-rc1", "v1.0.1", "v1.2.0",
         "v1.10.0", "v2.0.0", "v10.0.0"]


def test_tag_name_order(column):
    shuffled = random.Random(0).sample(NAMES, len(NAMES))
    keys = dict(zip(shuffled, column(vs.refname_key, shuffled)))
    assert sorted(NAMES, key=lambda n: keys[n].encode()) == NAMES


def test_tags(spark):
    rng = random.Random(4)
    rows = [("one", t, t == "v1.0.1") for t in NAMES] + [("two", f"v{a}.{b}.{c}", False) for a in range(3) for b in range(12) for c in range(12)]
    rng.shuffle(rows)
    tags = spark.createDataFrame(rows, schemas.TAGS)
    order = [r["tag"] for r in tg.version_order(tags).filter("repo = 'one'").orderBy("place").collect()]
    assert order == NAMES[::-1]
    two = tg.version_order(tags).filter("repo = 'two'").orderBy("place").collect()
    assert [r["place"] for r in two] == list(range(1, 433))
    assert [r["tag"] for r in two[:2]] == ["v2.11.11", "v2.11.10"] and two[-1]["tag"] == "v0.0.0"
    previous = {(r["repo"], r["tag"]): r["previous_tag"] for r in tg.previous_tags(tags).collect()}
    assert [previous["one", t] for t in NAMES] == [None, *NAMES[:-1]]
    assert previous["two", "v1.0.0"] == "v0.11.11" and previous["two", "v0.0.0"] is None
    assert sorted(map(tuple, tg.latest_tags(tags).collect())) == [("one", "v10.0.0"), ("two", "v2.11.11")]
    assert sorted(map(tuple, tg.tag_counts(tags, "v1*").collect())) == [("one", 10), ("two", 144)]
    doomed = {r["tag"] for r in tg.prune(tags, 3, "v*", protect=["v1.0.0*"]).filter("repo = 'one'").collect()}
    assert doomed == {"v0.9.10", "v1.0", "v1.2.0"}
    assert tg.prune(tags, 0, "v*", protect_head=False).count() == 432 + 12
    with pytest.raises(ValueError):
        tg.prune(tags, -1)


def test_order_violations(spark):
    made = ["v1.0.0", "v1.1.0", "v1.0.5", "v1.0.9-rc.1", "v2.0.0-rc.1", "v1.9.0", "x3.0.0", "v1.1.0"]
    rows = spark.createDataFrame([("a", n, t) for n, t in enumerate(made)], "repo string, seq long, tag string")
    got = [(r["tag"], r["last_tag"]) for r in tg.order_violations(rows, bits=4).orderBy("seq").collect()]
    # After v2.0.0-rc.1 the last tag is no plain version: nothing is enforced.
    assert got == [("v1.0.5", "v1.1.0")]


def _release(spark, diff=(), commits=(), files=(), sources=(), current="1.2.3", weights=None):
    ranges = spark.createDataFrame([("r", current)], "range_id string, current_version string")
    made = [
        spark.createDataFrame(list(rows), schema) if rows else tables.empty(spark, schema)
        for rows, schema in ((files, schemas.FILE_CHANGES), (diff, schemas.DIFF_LINES), (commits, schemas.COMMITS), (sources, schemas.OPTION_SOURCES))
    ]
    metrics = release.range_metrics(ranges, *made)
    return release.suggest_releases(metrics, weights).first()


def test_suggestions(spark):
    nothing = _release(spark)
    assert (nothing["total_bonus"], nothing["suggestion"], nothing["next_version"]) == (0, "none", None)
    source = _release(spark, files=[("r", "A", "src/a.c", None, "100", "0")])
    assert (source["total_bonus"], source["suggestion"], source["next_version"]) == (1, "patch", "1.2.5")
    assert (source["patch_delta"], source["minor_delta"], source["major_delta"]) == (2, 7, 12)
    # Security words of a message count in both analyses.
    secure = _release(spark, commits=[("r", "1", None, False, "security", "")])
    assert (secure["total_bonus"], secure["suggestion"]) == (4, "minor")
    diff = [("r", "a.c", 1, "+", "// API BREAKING"), ("r", "a.c", 2, "-", "int f(int a);"), ("r", "b.md", 3, "+", "x --opt")]
    commit = [("r", "1", None, False, "BREAKING CHANGE", "")]
    broken = _release(spark, diff=diff, commits=commit, current=None)
    assert (broken["total_bonus"], broken["suggestion"], broken["next_version"]) == (6, "minor", "0.1.0")
    unusable = _release(spark, diff=diff, commits=commit, current="1.x")
    assert (unusable["suggestion"], unusable["current_version"], unusable["major_delta"]) == ("none", "0.0.0", 0)
    table = spark.createDataFrame(
        [("breaking_changes", "api_breaking", 5.0), ("security_stability", "security_vuln", 2.5)], schemas.WEIGHTS
    )
    assert _release(spark, diff=diff, commits=commit, weights=weight_struct(table))["suggestion"] == "major"
    one = spark.range(1).select(default_weights().alias("d"), weight_struct(table).alias("w")).first()
    assert (one["d"]["api_breaking"], one["w"]["api_breaking"], one["w"]["security"], one["w"]["major_from"]) == (3, 5, 2, 8)


@pytest.mark.parametrize("keep", [2, 2000])
def test_prune_with_unknown_heads(spark, keep):
    tags = spark.createDataFrame([("one", f"v1.0.{n}", None) for n in range(5)], "repo string, tag string, points_at_head boolean")
    assert tg.prune(tags, keep).count() == max(0, 5 - keep)


def test_globs_from_a_table(spark):
    """Against fnmatch, and without a join of all with all for very many globs."""
    import fnmatch

    rng = random.Random(2)
    letters = "ab1.-v"
    word = lambda n: "".join(rng.choices(letters, k=n))
    tags = [(f"repo{rng.randrange(3)}", word(rng.randrange(1, 9))) for _ in range(400)] + [("repo1", ""), ("other", "v1")]
    made = lambda: word(rng.randrange(4)) + rng.choice(["*", "?", "[ab]", "[!1]", "", "*.?", "**"]) + word(rng.randrange(3)) + rng.choice(["", "*"])
    globs = [(f"repo{rng.randrange(4)}", made()) for _ in range(60)] + [("repo0", None), (None, "*")]
    want = {(r, t) for r, t in tags for q, g in globs if g and r == q and fnmatch.fnmatchcase(t, g)}
    left = spark.createDataFrame(tags, "repo string, tag string")
    right = spark.createDataFrame(globs, "repo string, glob string")
    got = tg.matching_globs(left.repartition(3), right)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert tg.matching_globs(left, right.limit(0)).collect() == []
    many = spark.range(100_000).selectExpr("'repo0' AS repo", "concat('v', id, '.*') AS glob")
    found = tg.matching_globs(spark.range(50).selectExpr("'repo0' AS repo", "concat('v', id * 7, '.1') AS tag"), many)
    assert found.count() == 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    heads = left.selectExpr("*", "false AS points_at_head").distinct()
    kept = {tuple(r) for r in tg.prune(heads, keep=0, protect_table=right).collect()}
    assert kept == {t for t in map(tuple, tags)} - want
