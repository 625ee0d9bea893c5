import random

import plain
import pytest
from pyspark.sql import functions as F

from logsift import CleanOptions, clean
from logsift.operators import blocks as bl
from logsift.operators import quality as ql
from logsift.operators.ordered import range_buckets, running
from logsift.plans import clean as plan
from logsift.streaming import BlockStream

P = "==12345== "

REPORT = [
    P + line
    for line in (
        "Memory report of ./weaver",
        "Successfully downloaded debug",
        "Conditional jump or move depends on uninitialised value(s)",
        "   at 0x10F2: spin (loom.c:41)",
        "   by 0x11A0: ???",
        "   by 0x2200: main (weaver.c:7)",
        "",
        "Syscall param write(buf) points to uninitialised byte(s)",
        "   at 0x9999: put (out.c:3)",
        "64 bytes in 4 blocks are still reachable in loss record 2 of 2",
        "   at 0x77: knot (loom.c:9)",
        "   possibly lost: 8 bytes in 2 blocks",
        "      suppressed: none of them",
    )
]

READ = [P + "Invalid read of size 4", P + "   at 0x401234: main (test.cpp:10)"]
MARK = "--- Successfully downloaded debug info"
FRAME_A, FRAME_B = P + "   at 0x1: a (x.c:1)", P + "   by 0x2: b (x.c:2)"


LEAKS = [
    P + line
    for line in (
        "12 bytes in 3 blocks are possibly lost in loss record 1 of 2",
        "   at 0x1: grab (pool.c:5)",
        "   by 0x2: main (weaver.c:20)",
        "",
        "7 bytes in 1 blocks are definitely lost in loss record 2 of 2",
        "   at 0x3: grab (pool.c:5)",
        "   by 0x4: main (weaver.c:31)",
        "total: 19 bytes in 4 blocks",
        "   nothing else held",
    )
]

LOGS = {
    "report": REPORT,
    "dedup": (READ + [P]) * 3,
    "marker": READ + [P + "Successfully downloaded debug", P + "Invalid write of size 4", P + "   at 0x5: main (t.cpp:15)"],
    "marker_begin": [MARK, *READ],
    "marker_end": [*READ, MARK],
    "marker_none": READ,
    "two_markers": [MARK, *READ, MARK, P + "Invalid write of size 8", P + "  by 0x1: f (a.c:3)"],
    "leaks": LEAKS,
    "malformed": [P + "Invalid read of size 4", P + "   at 0x401234: main (test.cpp:10)", P + "   at 0x: main (test.cpp:10)",
                  P + "   at 0x401234: (test.cpp:10)", P + "   at 0x401234: main (:10)", P + "   at 0x401234: main ()"],
    "bad_pid": [P + "Invalid read of size 4", "==abc== Invalid write of size 1", "==1== Invalid write of size 1", FRAME_A],
    "unicode": [P + "Invalid read of size 4", P + "   at 0x1: función_é (a.cpp:1)"] * 2,
    "no_tool": ["hello", "", "  ", "== x"],
    "depth_pair": [P + "Invalid read of size 1", FRAME_A, FRAME_B, P + "Invalid read of size 1", FRAME_B, P + "Invalid read of size 1", FRAME_A],
    "controls": [P + "Invalid read of size 4", P + "\x00\x01\x07 frame\x00", P + "� x\x85"],
    "carriage": [P + "Invalid read of size 4\r", P + "   at 0x1: a (x.c:1)\r", P + "\r"],
    "same": [line for _ in range(40) for line in (P + "Invalid read of size 4", FRAME_A, P)],
    "differ": [line for n in range(40) for line in (P + f"Invalid read of size {n}", FRAME_A, P)],
    "one_long": [P + "Invalid read of size 4"] + [P + f"   by 0x{n:x}: f{n} (a.c:{n})" for n in range(100)],
    "trailing": [P + "no start here", P + "still none", MARK, P + "after"],
}


def _run(lines, options):
    rows = clean(lines, options).orderBy("log_id", "block_no").collect()
    out = {name: [] for name in LOGS}
    for r in rows:
        out[r["log_id"]].append((r["block_text"], r["sig_key"], r["repeats"]))
    return out


def _plain(options, logs=LOGS):
    return {
        name: plain.clean(
            body.split("\n") if isinstance(body, str) else body, options.depth, options.trim, options.scrub, options.marker
        )
        for name, body in logs.items()
    }


@pytest.mark.parametrize(
    "options",
    [
        CleanOptions(),
        CleanOptions(trim=False, chunk_bits=4),
        CleanOptions(depth=0, trim=False, chunk_bits=4),
        CleanOptions(depth=2, scrub=False, chunk_bits=4),
        CleanOptions(depth=3, marker="Invalid write"),
    ],
    ids=["default", "keep_all", "whole_signature", "raw", "other_marker"],
)
def test_fixture_logs(as_lines, options):
    assert _run(as_lines(LOGS), options) == _plain(options)


def test_known_blocks(as_lines):
    got = _run(as_lines(LOGS), CleanOptions())
    assert [t for t, _, _ in got["report"]] == [
        "Conditional jump or move depends on uninitialised value(s)\nspin (loom.c:41)\nmain (weaver.c:7)",
        "Syscall param write(buf) points to uninitialised byte(s)\nput (out.c:3)",
        "knot (loom.c:9)",
        "suppressed: none of them",
    ]
    assert [t for t, _, _ in got["marker"]] == ["Invalid write of size 4\nmain (t.cpp:15)"]
    assert got["marker_end"] == got["marker_none"] == got["no_tool"] == []
    assert len(got["two_markers"]) == len(got["marker_begin"]) == 1
    kept = _run(as_lines(LOGS), CleanOptions(trim=False))
    assert kept["dedup"][0][2] == 3
    assert len(kept["report"]) == 5
    assert len(kept["leaks"]) == 2
    assert (len(kept["same"]), len(kept["differ"])) == (1, 40)
    assert [len(_run(as_lines(LOGS), CleanOptions(trim=False, depth=d))["depth_pair"]) for d in (1, 2, 0)] == [1, 2, 3]


def _random_logs(rng, n_logs, n_lines):
    kinds = [
        P + "Invalid read of size 4", P + "Invalid write of size 8", P + "40 bytes in 2 blocks are definitely lost",
        FRAME_A, FRAME_B, P + "   by 0x9: ???", P, P + "???", "noise", "==7== Invalid read", P + "x bytes in y",
    ]
    logs = {}
    for i in range(n_logs):
        lines = rng.choices(kinds, k=n_lines)
        for _ in range(rng.randint(0, 2)):
            lines.insert(rng.randrange(len(lines)), MARK)
        logs[f"log{i}"] = lines
    return logs


@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("depth", [0, 1, 3])
def test_random_logs(as_lines, trim, depth):
    logs = _random_logs(random.Random(depth), 6, 150)
    options = CleanOptions(depth=depth, trim=trim, chunk_bits=4)
    rows = clean(as_lines(logs), options).orderBy("log_id", "block_no").collect()
    got = {name: [] for name in logs}
    for r in rows:
        got[r["log_id"]].append((r["block_text"], r["sig_key"], r["repeats"]))
    assert got == _plain(options, logs)
    one = clean(as_lines(logs), CleanOptions(depth=depth, trim=trim))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, one.collect()))


@pytest.mark.parametrize("trim", [True, False])
def test_all_logs_as_one(as_lines, trim):
    logs = _random_logs(random.Random(3), 7, 60)
    logs["log3"] = [P + "   by 0x1: only frames (a.c:1)"] * 40
    options = CleanOptions(depth=2, trim=trim, scope="all", chunk_bits=4)
    rows = clean(as_lines(logs), options).orderBy("block_no").collect()
    joined = [line for name in sorted(logs) for line in logs[name]]
    assert [(r["block_text"], r["sig_key"], r["repeats"]) for r in rows] == plain.clean(joined, 2, trim)


def test_cleaning_twice_changes_nothing(as_lines, spark):
    options = CleanOptions(trim=False, depth=2, scrub=False)
    once = clean(as_lines({"a": LOGS["differ"] + LOGS["same"]}), options).orderBy("block_no").collect()
    again = [P + line for r in once for line in r["block_text"].split("\n")]
    twice = clean(as_lines({"a": again}), options).orderBy("block_no").collect()
    assert [r["block_text"] for r in twice] == [r["block_text"] for r in once]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "log_id string, line_no long, value string")
    for scope in ("log", "all"):
        result = clean(empty, CleanOptions(scope=scope))
        assert result.collect() == []
        assert result.columns == ["log_id", "epoch", "block_no", "block_text", "sig_key", "repeats"]


def test_every_block(as_lines):
    lines = as_lines({"dedup": LOGS["dedup"], "leaks": LOGS["leaks"]})
    blocks = plan.blocks(lines, CleanOptions(trim=False, depth=0, chunk_bits=4)).collect()
    assert sum(r["log_id"] == "dedup" for r in blocks) == 3
    assert sum(r["n_lines"] for r in blocks if r["log_id"] == "dedup") == 6
    assert sum(r["log_id"] == "leaks" for r in blocks) == 3


def test_epochs_and_cut(as_lines):
    lines = as_lines({"a": LOGS["two_markers"], "b": READ})
    got = bl.with_epochs(lines, CleanOptions(chunk_bits=4)).orderBy("log_id", "line_no").collect()
    assert [r["epoch"] for r in got] == [1, 1, 1, 2, 2, 2, 0, 0]
    assert bl.after_last_marker(lines, CleanOptions()).count() == 2


def test_limits_fail(as_lines):
    long_line = as_lines({"a": [P + "Invalid read", P + "x" * (1024 * 1024), MARK, P + "ok"]})
    assert clean(long_line).count() == 1  # before the cut it does not matter
    with pytest.raises(Exception, match="Line too long"):
        clean(long_line, CleanOptions(trim=False, strict=True)).collect()
    assert clean(long_line, CleanOptions(trim=False)).count() == 1
    wide = as_lines({"a": [P + "Invalid read"] + [P + "y" * 500_000] * 24})
    for bits in (4, 18):
        with pytest.raises(Exception, match="Block too large"):
            clean(wide, CleanOptions(trim=False, chunk_bits=bits, strict=True)).collect()


@pytest.mark.parametrize("bits", [4, 18])
@pytest.mark.parametrize("scope", ["log", "all"])
def test_oversize_blocks_leave_the_others_alone(as_lines, bits, scope):
    small = {"b": [P + "Invalid read", P + "small"], "c": [P + "Invalid write", P + "tail"]}
    wide = [P + "Invalid read"] + [P + f"{n} " + "y" * 500_000 for n in range(24)]
    lines = as_lines({"a": [*wide, P + "Invalid write", P + "after"], **small})
    options = CleanOptions(trim=False, chunk_bits=bits, scope=scope, depth=2)
    for rows in (clean(lines, options).collect(), plan.blocks(lines, options).collect()):
        assert sorted(r["block_text"] for r in rows) == ["Invalid read\nsmall", "Invalid write\nafter", "Invalid write\ntail"]
    parts = sorted(plan.oversize(lines, options).collect(), key=lambda r: r["part_no"])
    assert [r["part_no"] for r in parts] == list(range(1, 26))
    assert [r["text"] for r in parts] == [x.removeprefix(P) for x in wide]


def test_a_part_over_the_limit_takes_the_whole_block_away(spark, as_lines, tmp_path):
    # Chunks of 16 line numbers: a small part, one over 10 MiB, a small one.
    wide = [P + "Invalid read"] + [P + f"{n} small" for n in range(15)]
    wide += [P + f"{n} " + "y" * 900_000 for n in range(16)] + [P + f"{n} last" for n in range(8)]
    lines = as_lines({"a": [*wide, P + "Invalid write", P + "after"]})
    options = CleanOptions(trim=False, chunk_bits=4, depth=2)
    assert [r["block_text"] for r in clean(lines, options).collect()] == ["Invalid write\nafter"]
    stream = BlockStream(spark, str(tmp_path), options)
    stream.absorb(lines.filter("line_no < 36"), 0)
    stream.absorb(lines.filter("line_no >= 36"), 1)
    assert [r["block_text"] for r in stream.blocks(1).collect()] == ["Invalid write\nafter"]
    parts = sorted(stream.oversize(1).collect(), key=lambda r: r["first_line"])
    assert "\n".join(r["text"] for r in parts) == "\n".join(x.removeprefix(P) for x in wide)


def test_quality_reports(as_lines):
    lines = as_lines({"a": [*READ, "x" * 50], "b": READ * 4})
    report = {r["log_id"]: r for r in ql.log_quality(lines, max_line_bytes=45, max_lines=6).collect()}
    assert (report["a"]["n_lines"], report["a"]["n_tool_lines"], report["a"]["problem"]) == (3, 2, "line_too_long")
    assert (report["b"]["n_long_lines"], report["b"]["problem"]) == (0, "too_many_lines")
    numbered = plan.number(lines, CleanOptions(trim=False))
    blocks = {r["log_id"]: r for r in ql.block_quality(numbered, max_pending=2).collect()}
    assert (blocks["a"]["n_blocks"], blocks["a"]["problem"]) == (1, "ok")
    assert (blocks["b"]["n_blocks"], blocks["b"]["problem"]) == (4, "many_blocks")
    with pytest.raises(Exception, match="log b: too_many_lines"):
        ql.require_ok(ql.log_quality(lines, max_lines=6)).collect()


def test_running_values(spark):
    rng = random.Random(1)
    rows = [(k, n, rng.randint(-5, 5), rng.choice([None, n])) for k in "ab" for n in range(0, 300, 3)]
    table = spark.createDataFrame(rows, "k string, n long, v int, m long").repartition(3)
    for inclusive in (True, False):
        got = running(
            table, ["k"], "n", sums={"s": F.col("v")}, maxes={"x": F.col("m")}, totals=True, inclusive=inclusive, bits=4
        ).collect()
        seen = {"a": [], "b": []}
        for r in sorted(got, key=lambda r: (r["k"], r["n"])):
            before = seen[r["k"]]
            if inclusive:
                before.append((r["v"], r["m"]))
            known = [m for _, m in before if m is not None]
            assert r["s"] == sum(v for v, _ in before)
            assert r["x"] == (max(known) if known else None)
            if not inclusive:
                before.append((r["v"], r["m"]))
        assert all(r["s_total"] == sum(v for k, _, v, _ in rows if k == r["k"]) for r in got)


def test_range_buckets_keep_order(spark):
    table = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    got = sorted(range_buckets(table, "k", 16).collect())
    buckets = [r["_bucket"] for r in got]
    assert buckets == sorted(buckets)
    assert len(set(buckets)) in (16, 17)
