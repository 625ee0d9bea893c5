"""Block building over a stream of lines.

Every micro-batch is numbered, cut and folded with the same operators as a
table, in parallel inside a log as well. What one batch hands to the next is a
small row per log: last line, starts and markers so far. The folded blocks of
each batch, and the parts of blocks that go on, are kept in a table; reading it
joins the parts and drops what a later marker has made void. That is what the
end of the input shows.

The batch itself is read once: its lines, with their flags, are written first and
everything else is made of what was written.

Tables are written under `store`, a shared folder on a cluster. A batch writes
its own folders only, so a repeated batch changes nothing. It writes the state of
the logs it met, not of all. Every `merge_every` batches the states and blocks so
far are merged and what a marker has made void is dropped; late lines and those of
oversize blocks, which are kept for good, are merged by levels, as many folders of one
level at a time. A reader takes the merged folders and the batches since, so what
a batch costs does not grow with their number. Folders that a merge has taken up are
removed by the merge after it: a batch that is repeated still finds what it starts from.

End of input. If lines carry a `time`, each batch leaves a beat, the last time of every
log it met. `start_closing` follows the beats with a keyed state and an event-time timeout
per log: a log that is silent for the timeout, by the watermark of all beats, is closed,
and its blocks after its last marker are written as final. Lines that come after that
open the log again; it is closed anew, and `final` shows the last closing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logsift.functions import text as tx
from logsift.operators import blocks as bl
from logsift.options import MAX_PENDING_BLOCKS, CleanOptions

_BEFORE_ALL_LINES = -(2**63)


#: Keys that the logs are dealt to while they are followed; what a call costs is paid by key, not by log.
FOLLOWED = 1 << 12


def _until_silent(timeout_ms: int):
    """A key's state has its logs' last times; a log that no more comes of for the timeout is handed on and forgotten."""

    def run(key: tuple, beats: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = {log: (last, due) for log, last, due in zip(*state.get, strict=True)} if state.exists else {}
        if not state.hasTimedOut:
            for b in beats:
                for name, last in zip(b["log"].tolist(), b["last_us"].tolist(), strict=True):
                    log = None if pd.isna(name) else name
                    last = max(int(last), held[log][0]) if log in held else int(last)
                    # A timeout must lie ahead of the watermark.
                    held[log] = (last, max(last // 1000 + timeout_ms, now + 1))
        silent = {log: last for log, (last, due) in held.items() if due < now}
        waiting = [(log, *times) for log, times in held.items() if log not in silent]
        if waiting:
            state.update(tuple(list(column) for column in zip(*waiting, strict=True)))
            state.setTimeoutTimestamp(max(min(due for _, _, due in waiting), now + 1))
        elif state.exists:
            state.remove()
        if silent:
            yield pd.DataFrame({"log": list(silent), "last_time": [pd.Timestamp(t, unit="us") for t in silent.values()]})

    return run


class BlockStream:
    """Unique blocks of logs that arrive in micro-batches.

    Lines of a log must arrive in order; a line at or before the last one seen
    in an earlier batch is late: it is counted and kept in a table of its own.
    """

    def __init__(
        self, spark: SparkSession, store: str, options: CleanOptions | None = None, merge_every: int = 16
    ):
        if merge_every < 2:
            raise ValueError("merge_every must be at least 2")
        self.merge_every = merge_every
        self.spark = spark
        self.store = store.rstrip("/")
        self.options = options or CleanOptions()
        if self.options.scope != "log":
            raise ValueError("a stream is cleaned log by log")
        # Rules that see bytes; texts in the store have a character for each.
        self.rules = self.options.over_bytes() if self.options.exact else self.options

    # --- folders -----------------------------------------------------------------

    def _folder(self, table: str, batch_id: int) -> str:
        return f"{self.store}/{table}/batch={batch_id}"

    def _write(self, rows: DataFrame, table: str, batch_id: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._folder(table, batch_id))
        return self._read(table, batch_id)

    def _read(self, table: str, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(self._folder(table, batch_id))

    def _files(self, path: str):
        """Spark's own file system of a path, and the path."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _remove(self, table: str, batch_id: int) -> None:
        files, where = self._files(self._folder(table, batch_id))
        files.delete(where, True)

    def last_batch(self) -> int | None:
        """The last batch that was taken in whole."""
        files, where = self._files(f"{self.store}/logs")
        if not files.exists(where):
            return None
        names = [s.getPath() for s in files.listStatus(where)]
        done = [p for p in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max((int(p.getName().partition("=")[2]) for p in done), default=None)

    def _folders(self, table: str, last_batch: int) -> list[str]:
        """The last merge and the batches since: at most `merge_every` folders."""
        merged = (last_batch + 1) // self.merge_every * self.merge_every - 1
        since = [self._folder(table, b) for b in range(merged + 1, last_batch + 1)]
        return [self._folder(f"{table}_merged", merged), *since] if merged >= 0 else since

    def _levels(self, table: str, last_batch: int) -> list[str]:
        """Folders of a table that is merged by levels: below `merge_every` of each level.

        Level k folders hold merge_every**k batches each; batch numbers name their last.
        """
        out, at, level = [], last_batch + 1, 0
        while at:
            for _ in range(at % self.merge_every):
                batch = at * self.merge_every**level - 1
                out.append(self._folder(f"{table}_{level}" if level else table, batch))
                at -= 1
            at, level = at // self.merge_every, level + 1
        return out

    def _merge_level(self, table: str, batch_id: int) -> None:
        """Join the folders of each level that is full with this batch into one of the next level."""
        m, level = self.merge_every, 0
        while (batch_id + 1) % m ** (level + 1) == 0:
            name = f"{table}_{level}" if level else table
            span = m**level
            parts = [self._folder(name, batch_id - span * k) for k in range(m)]
            rows = self.spark.read.parquet(*parts)
            self._write(rows.coalesce(max(1, rows.rdd.getNumPartitions() // m)), f"{table}_{level + 1}", batch_id)
            # Those that the merge before took up.
            for k in range(m, 2 * m):
                if batch_id - span * k >= 0:
                    self._remove(name, batch_id - span * k)
            level += 1

    def _merge(self, batch_id: int) -> None:
        """Write logs and current blocks up to a batch as one folder each."""
        m = self.merge_every
        before = {
            table: self.spark.read.parquet(
                *([] if batch_id < m else [self._folder(f"{table}_merged", batch_id - m)]),
                *[self._folder(table, b) for b in range(batch_id - m + 1, batch_id + 1)],
            )
            for table in ("logs", "blocks")
        }
        logs = self._latest(before["logs"])
        self._write(bl.fold_again(self._current(before["blocks"], logs).drop("n_starts")), "blocks_merged", batch_id)
        self._write(logs, "logs_merged", batch_id)
        for table in ("logs", "blocks", "chunks"):
            for b in range(max(0, batch_id - 2 * m + 1), batch_id - m + 1):
                self._remove(table, b)
        if batch_id >= 2 * m:
            for table in ("logs", "blocks"):
                self._remove(f"{table}_merged", batch_id - 2 * m)

    def _latest(self, states: DataFrame) -> DataFrame:
        """The last state of each log."""
        values = [c for c in states.columns if c not in ("batch", "log_id")]
        last = F.max(F.struct("batch_id", *[c for c in values if c != "batch_id"])).alias("last")
        return states.groupBy("log_id").agg(last).select("log_id", "last.*")

    def _current(self, blocks: DataFrame, logs: DataFrame) -> DataFrame:
        """Folded blocks that no marker has made void, with the log's starts so far."""
        now = logs.select(F.col("log_id").alias("scope"), F.col("n_markers").alias("epoch"), "n_starts")
        return blocks.join(now, ["scope", "epoch"])

    # --- taking in lines -------------------------------------------------------

    def start(self, lines: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run on a streaming DataFrame of log_id, line_no, value and perhaps time."""
        if not lines.isStreaming:
            raise ValueError("lines must be a streaming DataFrame; clean() takes tables")
        writer = lines.writeStream.foreachBatch(self.absorb).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def _arrived(self, batch: DataFrame, seen: DataFrame | None, batch_id: int) -> DataFrame:
        """The batch's lines with their flags, written: the one time the batch is read."""
        if self.options.exact:
            batch = batch.withColumn("value", tx.bytes_as_text(F.col("value")))
        flagged = bl.flag_lines(batch, self.rules, *[c for c in batch.columns if c == "time"])
        if "time" in batch.columns:
            flagged = flagged.withColumn("time_us", F.unix_micros(F.col("time").cast("timestamp"))).drop("time")
        late = F.lit(False)
        if seen is not None:
            # One row per log; Spark broadcasts it if small, else splits hot logs.
            flagged = flagged.join(
                seen.select("log_id", F.col("last_line").alias("seen_line")), "log_id", "left"
            )
            late = F.coalesce(F.col("line_no") <= F.col("seen_line"), F.lit(False))
        # Two folders in turn: a batch needs its lines only while it is taken in.
        return self._write(flagged.withColumn("is_late", late), "arrived", batch_id % 2)

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        """Take in the lines of one micro-batch; batches count from 0."""
        seen = self.logs(batch_id - 1) if batch_id else None
        flagged = self._arrived(batch, seen, batch_id)
        timely = flagged.filter(~F.col("is_late"))
        late_lines = flagged.groupBy("log_id").agg(F.count_if("is_late").alias("late_lines"))
        totals = self._write(bl.chunk_totals(timely, self.rules.exact), "chunks", batch_id)
        chunks = bl.place_more_chunks(totals, seen, self.rules)
        numbered = bl.number_lines(timely, chunks, self.rules, cut=False)
        pieces = bl.assemble_pieces(numbered, self.rules)
        made = self._write(bl.compact_pieces(pieces, self.rules), "blocks", batch_id)
        large = bl.oversize_piece_lines(numbered)
        if made.filter(F.col("n_bytes") > bl.MAX_BLOCK_BYTES).isEmpty():
            large = large.filter(F.lit(False))
        self._write(large, "oversize", batch_id)
        self._write(flagged.filter("is_late").select("log_id", "line_no", "value"), "late", batch_id)
        if "time_us" in flagged.columns:
            self._write(flagged.groupBy("log_id").agg(F.max("time_us").alias("last_us")), "beats", batch_id)
        # Written last: it is what the next batch starts from.
        self._write(self._counts(totals, late_lines, seen, batch_id), "logs", batch_id)
        if (batch_id + 1) % self.merge_every == 0:
            self._merge(batch_id)
        for table in ("late", "oversize"):
            self._merge_level(table, batch_id)

    def _counts(
        self, totals: DataFrame, late_lines: DataFrame, seen: DataFrame | None, batch_id: int
    ) -> DataFrame:
        """The state of the logs that the batch has lines of."""
        own = totals.select("log_id", "last_line", "n_starts", "n_markers")
        grown = own.unionByName(late_lines, allowMissingColumns=True)
        if seen is not None:
            met = seen.join(late_lines.select("log_id"), "log_id", "left_semi")
            grown = grown.unionByName(met.drop("batch_id"))
        count = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n_starts", "n_markers", "late_lines")]
        return grown.groupBy("log_id").agg(
            F.lit(batch_id).cast("long").alias("batch_id"), F.max("last_line").alias("last_line"), *count
        )

    # --- the end of the input --------------------------------------------------

    def start_closing(self, checkpoint: str, timeout_ms: int, delay: str = "0 seconds", **trigger) -> StreamingQuery:
        """Follow the beats and write the blocks of logs that have been silent for the timeout.

        `delay` is how far times may lie behind the latest one seen (the watermark's delay).
        The log ids' type is taken from the store, so a batch must have been taken in before;
        they are followed as text. The state is kept for a fixed number of keys, each with many logs.
        """
        beats_folder = f"{self.store}/beats"
        kind = dict(self.spark.read.parquet(beats_folder).dtypes)["log_id"]
        beats = self.spark.readStream.schema(f"log_id {kind}, last_us long, batch int").parquet(beats_folder)
        timed = beats.withColumn("at", F.timestamp_micros("last_us")).withWatermark("at", delay)
        dealt = timed.select(
            F.pmod(F.xxhash64("log_id"), F.lit(FOLLOWED)).alias("part"), F.col("log_id").cast("string").alias("log"), "last_us", "at"
        )
        silent = dealt.groupBy("part").applyInPandasWithState(
            _until_silent(timeout_ms),
            "log string, last_time timestamp",
            "logs array<string>, last_us array<long>, due_ms array<long>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        ).select(F.col("log").cast(kind).alias("log_id"), "last_time")
        writer = silent.writeStream.foreachBatch(self._close).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def _close(self, silent: DataFrame, closing: int) -> None:
        """Write the blocks of the logs handed on, as all batches so far make them."""
        closed = self._write(silent.select("log_id", "last_time"), "closed", closing)
        last = self.last_batch()
        blocks = self.blocks(last).join(closed, "log_id").withColumn("closing", F.lit(closing))
        self._write(blocks, "final", closing)

    def final(self) -> DataFrame:
        """Blocks of closed logs, as their last closing found them, with the time of their last line."""
        blocks = self.spark.read.parquet(f"{self.store}/final").drop("batch")
        which = self.spark.read.parquet(f"{self.store}/closed").groupBy("log_id").agg(F.max("batch").alias("closing"))
        return blocks.join(which, ["log_id", "closing"], "left_semi").drop("closing")

    # --- showing blocks --------------------------------------------------------

    def logs(self, last_batch: int) -> DataFrame:
        """Counts per log after a batch, late lines among them."""
        return self._latest(self.spark.read.parquet(*self._folders("logs", last_batch)))

    def _as_given(self, rows: DataFrame, *names: str) -> DataFrame:
        """Texts as bytes again, if options say exact."""
        return rows.withColumns({n: tx.text_as_bytes(F.col(n)) for n in names}) if self.options.exact else rows

    def late(self, last_batch: int) -> DataFrame:
        """Lines that came at or after a later line of their log and are in no block.

        `plans.clean.clean` over all lines of those logs gives their right blocks.
        """
        return self._as_given(self.spark.read.parquet(*self._levels("late", last_batch)), "value")

    def oversize(self, last_batch: int) -> DataFrame:
        """Lines, or several in one text, of the blocks that `blocks` leaves out for their size.

        log_id, epoch, block_no, first_line (of the text) and text.
        """
        logs = self.logs(last_batch)
        lines = self.spark.read.parquet(*self._levels("oversize", last_batch))
        parts = bl.oversize_parts(self._current(self.spark.read.parquet(*self._folders("blocks", last_batch)), logs))
        now = logs.select("log_id", F.col("n_markers").alias("epoch"))
        rows = lines.join(now, ["log_id", "epoch"], "left_semi").select(*parts.columns).unionByName(parts)
        return self._as_given(rows.filter(F.col("epoch") > 0) if self.options.trim else rows, "text")

    def blocks(self, last_batch: int, closed_only: bool = False) -> DataFrame:
        """Unique blocks after the last marker, as `clean` gives them.

        With `closed_only`, blocks that the next batch may add to are left out.
        """
        blocks = self.spark.read.parquet(*self._folders("blocks", last_batch))
        current = self._current(blocks, self.logs(last_batch))
        if self.options.trim:
            current = current.filter(F.col("epoch") > 0)
        if closed_only:
            is_open = ~F.col("whole") & (F.col("block_no") == F.col("n_starts"))
            current = current.filter(~is_open)
        return self._as_given(bl.unique_blocks(current.drop("n_starts"), self.rules), "block_text", "sig_key")

    def pending(self, last_batch: int, limit: int = MAX_PENDING_BLOCKS) -> DataFrame:
        """Per log: blocks that wait for the end of the input, and if they are too many."""
        waiting = self.blocks(last_batch).groupBy("log_id").agg(F.count("*").alias("n_pending"))
        problem = F.when(F.col("n_pending") > limit + 1, "too_many_pending").otherwise("ok")
        return waiting.withColumn("problem", problem)
