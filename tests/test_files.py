"""The line source: split reading, exact bytes, streams of files that grow and rotate."""

import json
import os
import pickle
import random

import pytest

from logsift import CleanOptions, clean, sinks
from logsift.operators.quality import log_quality
from logsift.sources import files
from logsift.sources.lines import read_lines, stream_text
from logsift.streaming import BlockStream
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_blocks import LOGS
from workload import logs as log_queries

BODIES = {
    "a": b"one\ntwo\r\n\n\xff\xfe bad\nlast",
    "b": b"",
    "c": b"\n\n",
    "d": b"x" * 100 + b"\n" + b"y" * 3 + b"\n",
    "e": b"no newline",
}


@pytest.mark.parametrize("name", BODIES)
def test_every_split_and_block(tmp_path, name):
    body = BODIES[name]
    file = tmp_path / name
    file.write_bytes(body)
    want, at = [], 0
    for line in body.removesuffix(b"\n").split(b"\n") if body else []:
        want.append((at, line))
        at += len(line) + 1
    for split in (1, 2, 3, 5, 7, 1000):
        for block in (1, 2, 3, 8, 1 << 20):
            got = []
            for part in files.ranges("L", str(file), 0, len(body), split):
                for batch in files.read_range(part, block):
                    got += [(o, v.as_buffer().to_pybytes()) for o, v in zip(batch.column(1).to_pylist(), batch.column(2))]
            assert got == want, (split, block)


def test_table_of_files(spark, tmp_path):
    for name, body in BODIES.items():
        (tmp_path / f"{name}.log").write_bytes(body)
    (tmp_path / "_hidden").write_bytes(b"no")
    before = spark.conf.getAll
    for paths in (str(tmp_path), f"file://{tmp_path}", str(tmp_path / "*.log"), [str(tmp_path / f"{n}.log") for n in BODIES]):
        for split in (3, 1 << 20):
            rows = read_lines(spark, paths, split).select("log_id", "line_no", F.hex(F.col("value").cast("binary"))).collect()
            got = {}
            for log, _, value in sorted(map(tuple, rows)):
                got.setdefault(os.path.basename(log)[0], []).append(bytes.fromhex(value))
            assert got == {n: b.removesuffix(b"\n").split(b"\n") for n, b in BODIES.items() if b}
    assert spark.conf.getAll == before
    assert read_lines(spark, str(tmp_path / "none*")).collect() == []


def test_exact_bytes_round_trip(spark, tmp_path):
    """Broken UTF-8 comes out byte for byte, and keys do not confuse different bytes."""
    head = b"==12== Invalid read of size 4\n"
    body = head + b"==12==    by 0x1: f\xff\xfe (a.c:1)\n" + head + b"==12==    by 0x2: f\xfd\xfc (a.c:2)\n"
    body += head + b"==12==    by 0x3: f\xff\xfe (a.c:3)\n" + "==12== Syscall param größe\n".encode()
    (tmp_path / "x.log").write_bytes(body)
    lines = read_lines(spark, str(tmp_path / "x.log"))
    got = clean(lines, CleanOptions(depth=2, trim=False, exact=True)).orderBy("block_no").collect()
    assert [(r.repeats, bytes(r.block_text)) for r in got] == [
        (2, b"Invalid read of size 4\nf\xff\xfe (a.c:1)"),
        (1, b"Invalid read of size 4\nf\xfd\xfc (a.c:2)"),
        (1, "Syscall param größe".encode()),
    ]
    blocks = clean(lines, CleanOptions(depth=2, trim=False, exact=True)).withColumn("block_text", F.col("block_text").cast("string"))
    sinks.write_blocks(blocks, str(tmp_path / "out"))
    written = b"".join(f.read_bytes() for f in sorted((tmp_path / "out").glob("part-*")))
    assert written == b"".join(bytes(r.block_text) + b"\n\n" for r in got)
    marked = body + "Größe erreicht\n".encode() + head
    (tmp_path / "y.log").write_bytes(marked)
    last = clean(read_lines(spark, str(tmp_path / "y.log")), CleanOptions(marker="Größe", exact=True)).collect()
    assert [bytes(r.block_text) for r in last] == [b"Invalid read of size 4"]


def test_sizes_come_with_the_blocks(spark, as_lines):
    lines = as_lines({n: LOGS[n] for n in ("report", "two_markers", "marker_none")})
    seen = Observation("sizes")
    blocks = clean(lines, CleanOptions(depth=1), seen)
    assert blocks.count() == clean(lines, CleanOptions(depth=1)).count()
    report = log_quality(lines)
    want = report.agg(F.sum("n_lines"), F.sum("n_tool_lines"), F.sum("n_bytes"), F.max("longest_line"), F.sum("n_long_lines")).first()
    assert tuple(seen.get[n] for n in ("n_lines", "n_tool_lines", "n_bytes", "longest_line", "n_long_lines")) == tuple(want)


def _polled(spark, folder, tmp_path, name="q"):
    """What a stream hands on in one run, as {log: [(line_no, bytes)]}."""
    got = []

    def take(batch, _):
        got.extend(batch.select("log_id", "line_no", F.col("value").cast("binary")).collect())

    lines = stream_text(spark, str(folder / "*.log"), split_bytes=16)
    query = lines.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True)
    query.start().awaitTermination()
    out = {}
    for log, line_no, value in sorted(map(tuple, got)):
        out.setdefault(os.path.basename(log.partition("#")[0]), []).append((line_no, bytes(value)))
    return {name: sorted(rows) for name, rows in out.items()}


def test_files_that_grow_and_rotate(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    app, other = folder / "app.log", folder / "other.log"
    app.write_bytes(b"start 1\nsecond\nhalf a li")
    other.write_bytes(b"only half")
    assert _polled(spark, folder, tmp_path) == {"app.log": [(0, b"start 1"), (8, b"second")]}
    assert _polled(spark, folder, tmp_path) == {}
    with app.open("ab") as f:
        f.write(b"ne \xff\nfourth\n")
    with other.open("ab") as f:
        f.write(b" a line\n")
    assert _polled(spark, folder, tmp_path) == {
        "app.log": [(15, b"half a line \xff"), (29, b"fourth")],
        "other.log": [(0, b"only half a line")],
    }
    # Rotated: the rest of the old file is read where it went, the new one from its start.
    with app.open("ab") as f:
        f.write(b"rest of the old one\n")
    app.rename(folder / "app.log.1")
    app.write_bytes(b"start 2\nnew\n")
    assert _polled(spark, folder, tmp_path) == {"app.log": [(0, b"start 2"), (8, b"new"), (36, b"rest of the old one")]}
    assert _polled(spark, folder, tmp_path) == {}


def test_blocks_of_growing_files(spark, tmp_path):
    """A stream over text files gives what the table of all their lines gives."""
    folder = tmp_path / "logs"
    folder.mkdir()
    names = ("report", "two_markers", "marker_none")
    bodies = {n: (LOGS[n] if isinstance(LOGS[n], str) else "\n".join(LOGS[n])).encode() + b"\n" for n in names}
    bodies = {n: f"log {n}\n".encode() + b for n, b in bodies.items()}
    stream = BlockStream(spark, str(tmp_path / "store"), CleanOptions(depth=1, exact=True))
    for part in (1, 2, 3):
        for name, body in bodies.items():
            (folder / f"{name}.log").write_bytes(body[: len(body) * part // 3])
        stream.start(stream_text(spark, str(folder / "*.log"), 50), str(tmp_path / "check"), availableNow=True).awaitTermination()
    shown = lambda rows: sorted((os.path.basename(r.log_id.partition("#")[0]), r.block_no, bytes(r.block_text), r.repeats) for r in rows)
    want = clean(read_lines(spark, str(folder)), CleanOptions(depth=1, exact=True)).collect()
    assert shown(stream.blocks(stream.last_batch()).collect()) == shown(want)
    assert want


def test_two_files_with_one_first_line(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"same\n1\n")
    (tmp_path / "a.log.1").write_bytes(b"same\n2\n")
    with pytest.raises(ValueError, match="begin with the same line"):
        files._Stream([str(tmp_path / "a.log")], 100).latestOffset()


def test_many_small_files(tmp_path):
    """Small files share a task; copies are found by their names."""
    for n in range(300):
        (tmp_path / f"{n}.log").write_bytes(b"log %d\nline\nrest" % n)
    (tmp_path / "7.log.1").write_bytes(b"log old\n")
    (tmp_path / "7.logs").write_bytes(b"no copy\n")
    stream = files._Stream([str(tmp_path / "*.log")], 64 << 20)
    end = stream.latestOffset()
    assert len(end) == 301
    assert sorted(k.partition("#")[0] for k in end if "/7.log#" in k) == [str(tmp_path / "7.log")] * 2
    parts = stream.partitions({}, end)
    assert len(parts) == 2
    rows = [(r["log_id"], r["line_no"]) for p in parts for b in stream.read(p) for r in b.to_pylist()]
    assert len(rows) == len(set(rows)) == 601
    assert {log for log, _ in rows} == set(end)
    # One that is large is still cut.
    assert len(files._Stream([], 5).partitions({}, {"a": {"file": "a", "end": 20}})) == 4
    assert files._copy_of("/x/a.log.1.gz", {"/x/a.log", "/x/a.log.1"}) == "/x/a.log"
    assert files._copy_of("/x/a.log", {"/x/a.log"}) is None


def _read(stream, start, end):
    parts = stream.partitions(start, end)
    assert all(len(pickle.dumps(p)) < 1000 for p in parts) or "positions" not in end
    return sorted((r["log_id"], r["line_no"], r["value"]) for p in parts for b in stream.read(p) for r in b.to_pylist())


def test_positions_are_written_beside_the_offsets(tmp_path):
    """Offsets and partitions stay small however many logs there are, and say the same as with positions inside."""
    folder = tmp_path / "logs"
    folder.mkdir()
    for n in range(3000):
        (folder / f"{n}.log").write_bytes(b"log %d\nline\nhalf" % n)
    paths = [str(folder / "*.log")]
    inside = files._Stream(paths, 64 << 20)
    new = lambda: files._Stream(paths, 64 << 20, str(tmp_path / "positions"))
    assert files._Stream([str(folder / "none*")], 5, str(tmp_path / "positions")).latestOffset() == {}
    first, known = new().latestOffset(), inside.latestOffset()
    assert len(json.dumps(first)) < 1000 < len(json.dumps(known))
    assert {log: {"file": file, "end": end} for log, file, end in files._positions(first)} == known
    rows = _read(new(), {}, first)
    assert rows == _read(inside, {}, known)
    assert len(rows) == 6000
    # Nothing new is the same offset, also of a new reader.
    assert new().latestOffset() == first
    assert _read(new(), first, first) == []
    # Grown, rotated, gone and new.
    with (folder / "7.log").open("ab") as f:
        f.write(b" a line\n")
    (folder / "8.log").rename(folder / "8.log.1")
    (folder / "8.log").write_bytes(b"log 8 again\n")
    (folder / "9.log").unlink()
    (folder / "new.log").write_bytes(b"log new\n")
    stream = new()
    second = stream.latestOffset()
    assert second != first
    rows = _read(stream, first, second)
    assert [(at, value) for _, at, value in rows] == [(11, "half a line"), (0, "log 8 again"), (0, "log new")]
    # An offset of a checkpoint from before the folder was named.
    assert _read(stream, known, second) == rows == _read(inside, known, inside.latestOffset())
    # What no restart can ask for is removed.
    (tmp_path / "positions" / "other").write_bytes(b"")
    stream.commit(first)
    left = {f.name for f in (tmp_path / "positions").iterdir()}
    assert left == {"other", *(os.path.basename(o["positions"]) for o in (first, second))}
    assert _read(stream, first, second) == rows
    stream.commit(second)
    assert {f.name for f in (tmp_path / "positions").iterdir()} == {"other", os.path.basename(second["positions"])}


def test_stream_with_positions(spark, tmp_path):
    """The checkpoint has no log in it; a restarted query goes on where it was."""
    folder, got = tmp_path / "logs", []
    folder.mkdir()

    def poll():
        got.clear()
        lines = stream_text(spark, str(folder / "*.log"), positions=f"file://{tmp_path}/positions")
        take = lambda batch, _: got.extend(batch.select("line_no", "value").collect())
        query = lines.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
        query.start().awaitTermination()
        return sorted(map(tuple, got))

    for n in range(40):
        (folder / f"{n}.log").write_bytes(b"log %02d\nhalf" % n)
    assert poll() == [(0, f"log {n:02d}") for n in range(40)]
    assert poll() == []
    for n in range(0, 40, 2):
        with (folder / f"{n}.log").open("ab") as f:
            f.write(b" and half\n")
    (folder / "3.log").rename(folder / "3.log.1")
    (folder / "3.log").write_bytes(b"log 03 again\n")
    assert poll() == [(0, "log 03 again"), *[(7, "half and half")] * 20]
    assert poll() == []
    offsets = [f.read_text() for f in (tmp_path / "check" / "offsets").glob("[0-9]*")]
    assert len(offsets) == 2
    assert not any(".log" in o for o in offsets)


def test_query_keeps_logs_out_of_its_offsets(spark, tmp_path, monkeypatch):
    rows = [(n * 10 + user, user, "click") for n in range(4) for user in range(10)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(log_queries, "fresh_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    # Without a marker no block is shown.
    assert log_queries.stream_text_blocks(spark, str(tmp_path)).collect() == []
    offsets = [f.read_text() for f in (tmp_path / "texts" / "checkpoint" / "offsets").glob("[0-9]*")]
    assert len(offsets) == 2
    assert not any(".log#" in o for o in offsets)


def test_sorting_in_files(monkeypatch):
    monkeypatch.setattr(files, "HELD", 4)
    monkeypatch.setattr(files, "MERGED", 3)
    draw = random.Random(1)
    for count in (0, 1, 3, 4, 5, 8, 12, 13, 100):
        rows = [(str(draw.randrange(50)), draw.randrange(3)) for _ in range(count)]
        assert list(files._sorted(iter(rows))) == sorted(rows)


def test_listing(tmp_path):
    """Copies go to the shortest name they continue, files of several paths to the last of these."""
    names = ("a.log", "a.log.1", "a.log.1.gz", "a.log-1", "a.logs", "a", "_a.log", ".a.log", "b.log.1", "sub/c.log")
    (tmp_path / "sub").mkdir()
    for n, name in enumerate(names):
        (tmp_path / name).write_bytes(b"x" * n)
    at = str(tmp_path)

    def listed(*paths, copies=True):
        return [(a.removeprefix(f"{at}/"), f.removeprefix(f"{at}/"), s) for a, f, s in files.list_files(paths, copies)]

    logs = [("a.log", "a.log", 0), ("a.log", "a.log.1", 1), ("a.log", "a.log.1.gz", 2)]
    assert listed(f"{at}/*.log") == listed(f"{at}/a.log") == logs
    assert listed(f"{at}/*.log", copies=False) == logs[:1]
    assert listed(f"{at}/a.log", f"{at}/a.log.1") == [logs[0], *(("a.log.1", f, s) for _, f, s in logs[1:])]
    assert listed(f"{at}/a.log.1", f"{at}/a.log") == logs
    assert sorted(listed(at)) == sorted([("a", "a", 5), *(("a", f, s) for _, f, s in logs), ("a", "a.log-1", 3), ("a", "a.logs", 4), ("b.log.1", "b.log.1", 8)])
    assert listed(at, copies=False) == sorted(
        [(f, f, s) for s, f in enumerate(names) if f[0] in "ab" and "/" not in f], key=lambda row: row[1].replace(".", "\0")
    )
    assert listed(f"{at}/none*") == listed(f"{at}/none") == []
