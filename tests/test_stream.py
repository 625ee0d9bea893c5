import random

import pytest
from pyspark.sql import functions as F

from logsift import CleanOptions, clean
from logsift.streaming import BlockStream
from test_blocks import LOGS, _random_logs
from workload import derived as dv
from workload import logs


def _rows(blocks):
    return sorted(tuple(r) for r in blocks.select("log_id", "block_text", "sig_key", "repeats").collect())


def _cut(logs, rng, parts):
    """The logs in `parts` batches, each log cut at random places."""
    batches = [[] for _ in range(parts)]
    for name, lines in logs.items():
        lines = lines.split("\n") if isinstance(lines, str) else lines
        cuts = sorted(rng.randint(0, len(lines)) for _ in range(parts - 1))
        for part, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(lines)])):
            batches[part] += [(name, n, lines[n]) for n in range(low, high)]
    return batches


SCHEMA = "log_id string, line_no long, value string"


@pytest.mark.parametrize(
    "options",
    [CleanOptions(depth=2, chunk_bits=4), CleanOptions(depth=0, trim=False, chunk_bits=5)],
    ids=["trim", "keep_all"],
)
def test_batches_give_what_the_table_gives(spark, tmp_path, as_lines, options):
    rng = random.Random(11)
    logs = {**LOGS, **_random_logs(rng, 4, 90)}
    stream = BlockStream(spark, str(tmp_path / "store"), options)
    batches = _cut(logs, rng, 3)
    for batch_id, rows in enumerate(batches):
        stream.absorb(spark.createDataFrame(rows, SCHEMA), batch_id)
    want = _rows(clean(as_lines(logs), options))
    assert _rows(stream.blocks(2)) == want
    # A repeated batch changes nothing.
    stream.absorb(spark.createDataFrame(batches[2], SCHEMA), 2)
    assert _rows(stream.blocks(2)) == want
    closed = stream.blocks(2, closed_only=True).count()
    assert 0 < closed <= len(want)


def test_cost_stays_level(spark, tmp_path, as_lines):
    """Few folders are read and few states written however many batches have come."""
    logs = _random_logs(random.Random(3), 5, 60)
    options = CleanOptions(depth=2, chunk_bits=4)
    stream = BlockStream(spark, str(tmp_path / "store"), options, merge_every=3)
    batches = _cut(logs, random.Random(4), 8)
    for batch_id, rows in enumerate(batches):
        stream.absorb(spark.createDataFrame(rows, SCHEMA), batch_id)
        assert len(stream._folders("blocks", batch_id)) <= 3
        assert stream._read("logs", batch_id).count() == len({r[0] for r in rows})
        if batch_id in (4, 5, 7):
            so_far = [r for part in batches[: batch_id + 1] for r in part]
            want = _rows(clean(spark.createDataFrame(so_far, SCHEMA), options))
            assert _rows(stream.blocks(batch_id)) == want
    stream.absorb(spark.createDataFrame(batches[7], SCHEMA), 7)
    assert _rows(stream.blocks(7)) == _rows(clean(as_lines(logs), options))


def test_late_lines_are_left_out(spark, tmp_path):
    rows = [("a", n, f"==12== Invalid read of size {n}") for n in range(10)]
    stream = BlockStream(spark, str(tmp_path / "s"), CleanOptions(trim=False))
    stream.absorb(spark.createDataFrame(rows[2:6], SCHEMA), 0)
    stream.absorb(spark.createDataFrame(rows[:3] + rows[6:], SCHEMA), 1)
    assert stream.blocks(1).count() == 8
    counts = stream.logs(1).first()
    assert (counts["last_line"], counts["n_starts"], counts["late_lines"]) == (9, 8, 3)
    waiting = {r["log_id"]: r for r in stream.pending(1, limit=6).collect()}
    assert (waiting["a"]["n_pending"], waiting["a"]["problem"]) == (8, "too_many_pending")
    assert stream.pending(1).first()["problem"] == "ok"
    assert sorted(r["line_no"] for r in stream.late(1).collect()) == [0, 1, 2]


def test_a_running_query(spark, tmp_path):
    options = CleanOptions(depth=1)
    stream = BlockStream(spark, str(tmp_path / "store"), options)
    logs = {name: LOGS[name] for name in ("report", "two_markers", "marker_none")}
    seen = []
    for rows in _cut(logs, random.Random(2), 2):
        seen += rows
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        lines = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        stream.start(lines, str(tmp_path / "check"), availableNow=True).awaitTermination()
    want = _rows(clean(spark.createDataFrame(seen, SCHEMA), options))
    assert _rows(stream.blocks(1)) == want
    with pytest.raises(ValueError):
        clean(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    with pytest.raises(ValueError):
        stream.start(spark.createDataFrame(seen, SCHEMA), str(tmp_path / "check2"))
    with pytest.raises(ValueError):
        BlockStream(spark, "x", CleanOptions(scope="all"))


def test_a_batch_is_read_once(spark, tmp_path):
    """An accumulator counts the rows that come out of the source."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [("a", n, f"==12== Invalid read of size {n}") for n in range(40)]
    stream = BlockStream(spark, str(tmp_path / "s"), CleanOptions(trim=False))
    for batch_id, part in enumerate((rows[:25], rows[20:])):
        source = spark.createDataFrame(part, SCHEMA).coalesce(1).mapInArrow(counted, SCHEMA)
        read.value = 0
        stream.absorb(source, batch_id)
        assert read.value == len(part)
    assert stream.blocks(1).count() == 40
    assert stream.late(1).count() == 5


def test_folders_stay_few(spark, tmp_path):
    """After 27 batches, merged by threes: what is read, and what is left on disk."""
    stream = BlockStream(spark, str(tmp_path / "s"), CleanOptions(trim=False), merge_every=3)
    small = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for b in range(13):
            rows = [("a", n, f"==12== Invalid read of size {n}") for n in (2 * b, 2 * b + 1)] + ([("a", 0, "==12== late")] if b else [])
            stream.absorb(spark.createDataFrame(rows, SCHEMA).coalesce(1), b)
            for table in ("late", "oversize"):
                assert len(stream._levels(table, b)) <= 2 * 3
            assert stream.late(b).count() == b
        assert stream.blocks(12).count() == 26
        left = {t.name: len(list(t.iterdir())) for t in (tmp_path / "s").iterdir()}
        assert all(n <= 6 for n in left.values()), left
        assert stream.last_batch() == 12
        # The last batch again, and one whose merge is repeated.
        stream.absorb(spark.createDataFrame([("a", 24, "==12== Invalid read of size 24"), ("a", 25, "==12== Invalid read of size 25")], SCHEMA), 12)
        assert stream.blocks(12).count() == 26
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", small)


def test_silent_logs_are_closed(spark, tmp_path):
    import datetime as dt

    timed = SCHEMA + ", time timestamp"
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    options = CleanOptions(depth=1, trim=False)
    stream = BlockStream(spark, str(tmp_path / "s"), options)
    old = [("old", n, f"==12== Invalid read of size {n % 3}", at(n)) for n in range(5)]
    new = [("new", n, f"==12== Invalid read of size {n}", at(30 + n)) for n in range(5)]
    stream.absorb(spark.createDataFrame(old + new[:1], timed), 0)
    follow = lambda: stream.start_closing(str(tmp_path / "c"), 10 * 60_000, availableNow=True).awaitTermination()
    follow()
    want = lambda rows: _rows(clean(spark.createDataFrame([r[:3] for r in rows], SCHEMA), options))
    assert _rows(stream.final()) == want(old)
    # It speaks again, and falls silent again.
    more = [("old", 5 + n, f"==12== Invalid write of size {n}", at(31 + n)) for n in range(3)]
    stream.absorb(spark.createDataFrame(new[1:] + more, timed), 1)
    follow()
    assert _rows(stream.final()) == want(old)
    stream.absorb(spark.createDataFrame([("third", 0, "==12== Invalid read", at(59))], timed), 2)
    follow()
    assert _rows(stream.final()) == sorted(want(old + more) + want(new))
    assert {r.last_time for r in stream.final().select("last_time").collect()} == {at(33), at(34)}


def test_logs_are_followed_many_at_a_time(spark, tmp_path):
    """Logs share keys of the state: each is closed by its own time, a null id too; calls do not grow with logs."""
    import datetime as dt

    from logsift.streaming import incremental as inc

    class State:
        """One key's state as Spark hands it to the function."""

        hasTimedOut, exists, get, now, due = False, False, None, 0, None

        def getCurrentWatermarkMs(self):
            return self.now

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists = False

        def setTimeoutTimestamp(self, due):
            assert due > self.now
            self.due = due

    import pandas as pd

    run, state = inc._until_silent(1000), State()
    beat = lambda *rows: iter([pd.DataFrame(rows, columns=["log", "last_us"])])
    out = lambda frames: sorted((str(r.log), r.last_time.value // 1000) for f in frames for r in f.itertuples())
    assert out(run((0,), beat(("a", 5_000_000), ("b", 7_000_000), (None, 5_000_000)), state)) == []
    assert state.due == 6000
    state.now = 6500
    assert out(run((0,), beat(("a", 6_400_000)), state)) == [("None", 5_000_000)]
    state.now, state.hasTimedOut = 8200, True
    assert out(run((0,), iter([]), state)) == [("a", 6_400_000), ("b", 7_000_000)]
    assert not state.exists

    stream = BlockStream(spark, str(tmp_path / "s"), CleanOptions(depth=1, trim=False))
    at = lambda m: dt.datetime(2024, 1, 1, m // 60, m % 60)
    rows = [(n, 0, f"==12== Invalid read of size {n}", at(n % 90)) for n in range(6000)]
    stream.absorb(spark.createDataFrame(rows, "log_id long, line_no long, value string, time timestamp"), 0)
    stream.start_closing(str(tmp_path / "c"), 10 * 60_000, availableNow=True).awaitTermination()
    got = {(r.log_id, r.last_time) for r in stream.final().collect()}
    assert got == {(n, at(n % 90)) for n in range(6000) if n % 90 < 79}
    assert stream.final().count() > inc.FOLLOWED


def test_runs_of_lines_are_dealt_evenly(spark, tmp_path):
    """Events that lie in one file by number: the lines of each run are written by all tasks alike."""
    rows = [(i, i % 40, "error" if i % 3 else "view") for i in range(-3, 3000)] + [(None, 1, "view")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    log, last = dv.log_lines(spark, str(tmp_path)), 2999 * 8 + 4
    store = logs._streamed(spark, str(tmp_path)).store
    lines = spark.read.parquet(f"{store.removesuffix('/store')}/lines").withColumn("file", F.input_file_name())
    run = F.least(F.lit(2), F.greatest(F.lit(0), F.floor((F.col("line_no") - 1) * 3 / last)))
    held = lines.groupBy(run.alias("run"), "file").count().collect()
    for part in range(3):
        counts = [r["count"] for r in held if r["run"] == part]
        assert len(counts) == 4 and max(counts) < 1.5 * sum(counts) / 4
    # Together they are the log, each line once; a line without a number is in no run.
    had = lines.drop("file")
    wanted = log.filter("line_no IS NOT NULL")
    assert had.exceptAll(wanted).isEmpty() and wanted.exceptAll(had).isEmpty()
