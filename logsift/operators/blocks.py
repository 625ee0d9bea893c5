"""Log lines -> numbered lines -> blocks -> one block per signature.

Order is data: a line's place in its log is `line_no`. A log may be of any
size. It is worked on in chunks (see `ordered`); a block that lies inside one
chunk is put together, keyed and counted there, and only blocks that touch a
chunk boundary (at most two per chunk) travel as parts.

Sizes: running totals find a block beyond 10 MiB before its text is collected,
inside a chunk as well as over the parts of a block, so what one group collects
is bounded. Such a block is an error if options say strict. Otherwise it takes no
part in the joined and folded blocks; `oversize_lines` has all its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsift.functions import text as tx
from logsift.operators.bitmap import bitmap, may_hold
from logsift.operators.ordered import BEFORE, RUN, chunk_of, range_buckets, running
from logsift.options import MAX_BLOCK_BYTES, MAX_LINE_BYTES, CleanOptions
from logsift.sources.storage import saved

_BEFORE_ALL_LINES = -(2**63)
_LINE_ERROR = f"Line too long (max {MAX_LINE_BYTES} bytes)"
_BLOCK_ERROR = f"Block too large (max {MAX_BLOCK_BYTES} bytes)"


def _checked(value: Column, broken: Column, message: str) -> Column:
    return F.when(broken, F.raise_error(F.lit(message))).otherwise(value)


def flag_lines(lines: DataFrame, options: CleanOptions, *more: str) -> DataFrame:
    """log_id, line_no, value and more columns, with is_marker, is_start and chunk."""
    value = F.col("value")
    marker = tx.is_marker(value, options.marker) if options.trim else F.lit(False)
    flagged = lines.select(
        "log_id",
        F.col("line_no").cast("long").alias("line_no"),
        "value",
        chunk_of(F.col("line_no"), options.chunk_bits).alias("chunk"),
        marker.alias("is_marker"),
        *more,
    )
    start = ~F.col("is_marker") & tx.is_opening_line(value, options.start_phrases)
    return flagged.withColumn("is_start", F.coalesce(start, F.lit(False)))


def chunk_totals(flagged: DataFrame, exact: bool = False) -> DataFrame:
    """One row per (log, chunk): starts, markers, last marker, last long line."""
    line = F.col("line_no")
    return flagged.groupBy("log_id", "chunk").agg(
        F.count_if("is_start").alias("n_starts"),
        F.count_if("is_marker").alias("n_markers"),
        F.max(F.when(F.col("is_marker"), line)).alias("marker_line"),
        F.max(F.when(tx.size_in_bytes(F.col("value"), exact) > MAX_LINE_BYTES, line)).alias("long_line"),
        F.max(line).alias("last_line"),
    )


def _place_per_log(totals: DataFrame, options: CleanOptions) -> DataFrame:
    log = W.partitionBy("log_id")
    ordered = log.orderBy("chunk")
    before = ordered.rowsBetween(*BEFORE)
    placed = totals.withColumns(
        {
            "starts_before": F.coalesce(F.sum("n_starts").over(before), F.lit(0)),
            "cut_line": F.max("marker_line").over(log),
            "epoch": F.sum("n_markers").over(log),
            "is_first": F.lag("chunk").over(ordered).isNull(),
            "is_last": F.lead("chunk").over(ordered).isNull(),
        }
    )
    if not options.trim:
        return placed.withColumn("from_line", F.lit(_BEFORE_ALL_LINES))
    cut_chunk = chunk_of(F.col("cut_line"), options.chunk_bits)
    return placed.filter(F.col("chunk") >= cut_chunk).withColumns(
        {"from_line": F.col("cut_line"), "is_first": F.col("chunk") == cut_chunk}
    )


def _place_all_logs(totals: DataFrame, options: CleanOptions) -> DataFrame:
    """As `_place_per_log`, with the logs joined up in the order of their ids."""
    # Used four times below; one small row per chunk, computed once.
    totals = saved(totals)
    per_log = totals.groupBy("log_id").agg(F.sum("n_starts").alias("log_starts"))
    bucketed = range_buckets(per_log, "log_id")
    sums = bucketed.groupBy("_bucket").agg(F.sum("log_starts").alias("_total"))
    # One row per bucket, a fixed number of rows.
    over_buckets = W.orderBy("_bucket").rowsBetween(*BEFORE)
    bucket_base = sums.select(
        "_bucket", F.coalesce(F.sum("_total").over(over_buckets), F.lit(0)).alias("_base")
    )
    in_bucket = W.partitionBy("_bucket").orderBy("log_id").rowsBetween(*BEFORE)
    log_base = bucketed.join(bucket_base.hint("shuffle_hash"), "_bucket").select(
        "log_id",
        (F.col("_base") + F.coalesce(F.sum("log_starts").over(in_bucket), F.lit(0))).alias("base"),
    )
    marks = totals.agg(
        F.max(F.when(F.col("marker_line").isNotNull(), F.struct("log_id", "marker_line"))).alias(
            "mark"
        ),
        F.sum("n_markers").alias("markers"),
    ).select(F.struct("mark", "markers"))
    before = W.partitionBy("log_id").orderBy("chunk").rowsBetween(*BEFORE)
    placed = totals.join(log_base, "log_id").select(
        *totals.columns,
        (F.col("base") + F.coalesce(F.sum("n_starts").over(before), F.lit(0))).alias(
            "starts_before"
        ),
        marks.scalar().alias("_marks"),
        F.lit(False).alias("is_first"),
        F.lit(False).alias("is_last"),
    )
    placed = placed.withColumn("epoch", F.col("_marks.markers"))
    if not options.trim:
        return placed.withColumn("from_line", F.lit(_BEFORE_ALL_LINES)).drop("_marks")
    cut_log, cut_line = F.col("_marks.mark.log_id"), F.col("_marks.mark.marker_line")
    in_cut_log = F.col("log_id") == cut_log
    kept = placed.filter(
        (F.col("log_id") > cut_log)
        | (in_cut_log & (F.col("chunk") >= chunk_of(cut_line, options.chunk_bits)))
    )
    from_line = F.when(in_cut_log, cut_line).otherwise(F.lit(_BEFORE_ALL_LINES))
    return kept.withColumn("from_line", from_line).drop("_marks")


def place_more_chunks(
    totals: DataFrame, seen: DataFrame | None, options: CleanOptions
) -> DataFrame:
    """As `place_chunks` for lines that follow the ones counted in `seen`.

    `seen` has one row per log: n_starts and n_markers so far. The blocks at
    both ends of the new lines may go on elsewhere.
    """
    log = W.partitionBy("log_id")
    before = log.orderBy("chunk").rowsBetween(*BEFORE)
    if seen is None:
        known = totals.withColumns({"old_starts": F.lit(0), "old_markers": F.lit(0)})
    else:
        old = seen.select(
            "log_id", F.col("n_starts").alias("old_starts"), F.col("n_markers").alias("old_markers")
        )
        known = totals.join(old, "log_id", "left").fillna(0, ["old_starts", "old_markers"])
    cut_chunk = chunk_of(F.col("cut_line"), options.chunk_bits)
    placed = known.withColumns(
        {
            "starts_before": F.col("old_starts") + F.coalesce(F.sum("n_starts").over(before), F.lit(0)),
            "cut_line": F.max("marker_line").over(log),
            "epoch": F.col("old_markers") + F.sum("n_markers").over(log),
        }
    ).withColumns(
        {
            "from_line": F.coalesce("cut_line", F.lit(_BEFORE_ALL_LINES)),
            "is_first": F.coalesce(F.col("chunk") == cut_chunk, F.lit(False)),
            "is_last": F.lit(False),
        }
    )
    placed = placed.filter(F.coalesce(F.col("chunk") >= cut_chunk, F.lit(True)))
    if options.trim:
        placed = placed.filter(F.col("epoch") > 0)
    return _wanted_chunks(placed, options)


def place_chunks(totals: DataFrame, options: CleanOptions) -> DataFrame:
    """Chunks that hold wanted lines, with the block count before each of them."""
    place = _place_per_log if options.scope == "log" else _place_all_logs
    return _wanted_chunks(place(totals, options), options)


def _wanted_chunks(placed: DataFrame, options: CleanOptions) -> DataFrame:
    if options.strict:
        too_long = F.col("long_line") > F.col("from_line")
        placed = placed.withColumn(
            "from_line", _checked(F.col("from_line"), F.coalesce(too_long, F.lit(False)), _LINE_ERROR)
        )
    return placed.select(
        "log_id", "chunk", "n_starts", "starts_before", "from_line", "epoch", "is_first", "is_last"
    )


def number_lines(
    flagged: DataFrame, chunks: DataFrame, options: CleanOptions, cut: bool = True
) -> DataFrame:
    """Kept lines with epoch, block_no and their place `pos` in the block's part.

    Lines of unwanted chunks do not take part in the shuffle: a bitmap of the wanted ones
    is tested where the lines are read (with `cut`, and if options cut at all). The join
    with the wanted chunks drops the few it lets through.

    block_no counts the block starts of the log up to the line. `piece_bytes`
    is the size of the block's part up to and including the line.
    """
    # One plain test on the scanned text: it goes down to the scan by itself,
    # where a test on `text` or `is_start` would drag their making along.
    body = flagged.filter(tx.is_nonblank_tool_line(F.col("value")) & ~F.col("is_marker")).select(
        "log_id", "chunk", "line_no", tx.strip_tool_prefix(F.col("value")).alias("text"), "is_start"
    )
    if cut and options.trim:
        body = body.filter(may_hold(bitmap(chunks, "log_id", "chunk").scalar(), "log_id", "chunk"))
    # Hash join: one shuffle of the lines serves the join and both windows.
    joined = body.join(chunks.hint("shuffle_hash"), ["log_id", "chunk"])
    shown = tx.with_rules(joined, "text", "raw", options.scrub_rules if options.scrub else ())
    wanted = (
        (F.col("line_no") > F.col("from_line"))
        & ~(F.col("is_start") & tx.is_leak_head(F.col("text")))
        & ~tx.is_blank(F.col("raw"))
    )
    shown = shown.withColumn("keep", wanted)
    in_bytes = tx.size_in_bytes(F.col("raw"), options.exact).cast("long") + 1
    size = F.when(F.col("keep"), in_bytes).otherwise(F.lit(0))
    run = W.partitionBy("log_id", "chunk").orderBy("line_no").rowsBetween(*RUN)
    counted = shown.withColumn("size", size).withColumns(
        {
            "starts": F.sum(F.col("is_start").cast("long")).over(run),
            "kept": F.sum(F.col("keep").cast("long")).over(run),
            "bytes": F.sum("size").over(run),
        }
    )
    # Totals at the last start so far; they only grow, so max finds them.
    at_start = counted.withColumns(
        {
            "kept_at": F.max(F.when(F.col("is_start"), F.col("kept") - F.col("keep").cast("long"))).over(run),
            "bytes_at": F.max(F.when(F.col("is_start"), F.col("bytes") - F.col("size"))).over(run),
        }
    )
    block_no = F.col("starts_before") + F.col("starts")
    opened = (F.col("starts") > 0) | F.col("is_first")
    closed = (F.col("starts") < F.col("n_starts")) | F.col("is_last")
    return at_start.filter("keep").select(
        "log_id",
        "chunk",
        "epoch",
        block_no.alias("block_no"),
        "line_no",
        "text",
        "raw",
        (F.col("kept") - F.coalesce("kept_at", F.lit(0))).alias("pos"),
        (F.col("bytes") - F.coalesce("bytes_at", F.lit(0))).alias("piece_bytes"),
        (opened & closed).alias("whole"),
    )


def assemble_pieces(numbered: DataFrame, options: CleanOptions) -> DataFrame:
    """One row per block and chunk; no shuffle after `number_lines`."""
    in_key = F.col("pos") <= options.depth if options.depth else None
    keyed = tx.with_canonical(numbered, "text", "sig", options.canonical_rules, in_key)
    line = F.struct("line_no", "raw")
    too_big = F.col("piece_bytes") > MAX_BLOCK_BYTES
    if options.strict:
        line = F.struct("line_no", _checked(F.col("raw"), too_big, _BLOCK_ERROR).alias("raw"))
    else:
        # Nothing more is collected of a block that is not going to be joined.
        line = F.when(~too_big, line)
    sig_line = F.when(F.col("sig").isNotNull() & ~too_big, F.struct("line_no", "sig"))
    grouped = keyed.groupBy("log_id", "chunk", "epoch", "block_no", "whole").agg(
        F.sort_array(F.collect_list(line)).alias("lines"),
        F.sort_array(F.collect_list(sig_line)).alias("sig_lines"),
        F.max("piece_bytes").alias("n_bytes"),
        F.min("line_no").alias("first_line"),
        F.count("*").alias("n_lines"),
    )
    return grouped.select(
        "log_id",
        "epoch",
        "block_no",
        "whole",
        "first_line",
        "n_lines",
        "n_bytes",
        F.array_join(F.col("lines.raw"), "\n").alias("block_text"),
        F.col("sig_lines.sig").alias("sigs"),
    )


def _joined_parts(parts: Column, options: CleanOptions) -> dict[str, Column]:
    ordered = F.sort_array(parts)
    n_lines = F.aggregate(ordered["n_lines"], F.lit(0).cast("long"), lambda a, b: a + b)
    return {
        "log_id": ordered[0]["log_id"],
        "block_no": ordered[0]["block_no"],
        "n_lines": n_lines,
        "block_text": F.array_join(ordered["block_text"], "\n"),
        "sig_key": tx.leading_lines(F.flatten(ordered["sigs"]), options.depth),
    }


def _size_checked(parts: DataFrame, block: list[str], size: Column, options: CleanOptions) -> DataFrame:
    """Fail at the part with which a block gets too big, or leave out its text from there on.

    The window runs over sorted rows and can spill. It shares its shuffle with
    the grouping that follows, so no more than the limit is ever collected.
    """
    so_far = W.partitionBy(*block).orderBy("log_id", "first_line").rowsBetween(*RUN)
    summed = parts.withColumn("_size", F.sum(size).over(so_far))
    too_big = F.col("_size") > MAX_BLOCK_BYTES
    if options.strict:
        return summed.withColumn("block_text", _checked(F.col("block_text"), too_big, _BLOCK_ERROR))
    return summed.withColumns(
        {n: F.when(~too_big, F.col(n)) for n in ("block_text", "sigs")}
    )


def oversize_lines(numbered: DataFrame, options: CleanOptions, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """All lines of the blocks beyond the limit: log_id, epoch, block_no, part_no, text.

    A part is a line; part_no counts the block's lines from 1. Which blocks these are
    comes from sums of sizes; only their lines are shuffled again.
    """
    block = ["scope", "epoch", "block_no"]
    lines = numbered.withColumn("scope", _scope(options))
    size = F.sum(tx.size_in_bytes(F.col("raw"), options.exact).cast("long") + 1).alias("size")
    large = lines.groupBy(*block).agg(size).filter(F.col("size") > max_block_bytes).select(*block)
    found = lines.join(large, block)
    # Chunks of a block are counted apart and their totals summed up, as in `running`.
    chunks = found.groupBy(*block, "log_id", "chunk").agg(F.count("*").alias("held"))
    before = W.partitionBy(*block).orderBy("log_id", "chunk").rowsBetween(*BEFORE)
    starts = chunks.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    inside = W.partitionBy(*block, "log_id", "chunk").orderBy("line_no")
    placed = found.join(starts, [*block, "log_id", "chunk"])
    part_no = F.col("start") + F.row_number().over(inside)
    return placed.select("log_id", "epoch", "block_no", part_no.alias("part_no"), F.col("raw").alias("text"))


def oversize_piece_lines(numbered: DataFrame) -> DataFrame:
    """Lines of the parts that are over the limit by themselves: log_id, epoch, block_no, first_line, text."""
    piece = ["log_id", "chunk", "epoch", "block_no"]
    large = numbered.filter(F.col("piece_bytes") > MAX_BLOCK_BYTES).select(*piece).distinct()
    found = numbered.join(large, piece)
    return found.select("log_id", "epoch", "block_no", F.col("line_no").alias("first_line"), F.col("raw").alias("text"))


def oversize_parts(compacted: DataFrame) -> DataFrame:
    """Parts with text of the blocks that are over the limit, as `oversize_piece_lines` gives lines."""
    block = ["scope", "epoch", "block_no"]
    parts = compacted.filter(~F.col("whole"))
    large = parts.groupBy(*block).agg(F.sum("n_bytes").alias("size")).filter(F.col("size") > MAX_BLOCK_BYTES)
    found = parts.filter(F.col("n_bytes") <= MAX_BLOCK_BYTES).join(large.select(*block), block, "left_semi")
    return found.select("log_id", "epoch", "block_no", "first_line", F.col("block_text").alias("text"))


def after_last_marker(lines: DataFrame, options: CleanOptions) -> DataFrame:
    """Lines of every log that follow its last marker; none if it has no marker.

    The marks are one row per log: Spark broadcasts them if they are small and
    splits the lines of a hot log if it has to sort.
    """
    marked = lines.filter(tx.is_marker(F.col("value"), options.marker))
    marks = marked.groupBy("log_id").agg(F.max("line_no").alias("_mark"))
    return lines.join(marks, "log_id").filter(F.col("line_no") > F.col("_mark")).select(*lines.columns)


def with_epochs(lines: DataFrame, options: CleanOptions) -> DataFrame:
    """Add epoch: the number of markers of the log up to and including the line."""
    marker = tx.is_marker(F.col("value"), options.marker)
    return running(lines, ["log_id"], "line_no", sums={"epoch": marker}, bits=options.chunk_bits)


def unique_lines(lines: DataFrame, options: CleanOptions | None = None) -> DataFrame:
    """First line of every log per canonical text, blank lines left out."""
    options = options or CleanOptions()
    keyed = lines.withColumn("sig_key", tx.canonical(F.col("value"), options.canonical_rules))
    first = keyed.filter(~tx.is_blank(F.col("value"))).groupBy("log_id", "sig_key").agg(
        F.min(F.struct("line_no", "value")).alias("first"), F.count("*").alias("repeats")
    )
    return first.select("log_id", "first.line_no", "first.value", "sig_key", "repeats")


_PART = ("log_id", "first_line", "block_no", "n_lines", "block_text", "sigs")


def _scope(options: CleanOptions) -> Column:
    return (F.col("log_id") if options.scope == "log" else F.lit(0)).alias("scope")


def assemble_blocks(pieces: DataFrame, options: CleanOptions) -> DataFrame:
    """Every block: log_id, epoch, block_no, n_lines, block_text, sig_key."""
    block = ["scope", "epoch", "block_no"]
    parts = _size_checked(pieces.withColumn("scope", _scope(options)), block, F.col("n_bytes"), options)
    grouped = parts.groupBy(*block).agg(
        F.collect_list(F.struct(*_PART)).alias("parts"), F.max("_size").alias("_size")
    ).filter(F.col("_size") <= MAX_BLOCK_BYTES)
    joined = _joined_parts(F.col("parts"), options)
    return grouped.select(
        joined["log_id"].alias("log_id"),
        "epoch",
        "block_no",
        *[joined[n].alias(n) for n in ("n_lines", "block_text", "sig_key")],
    )


def compact_pieces(pieces: DataFrame, options: CleanOptions) -> DataFrame:
    """Repeats of whole blocks folded together before their text is shuffled.

    Rows are the first whole block of a signature with its number of repeats
    (key is "s" and the signature), or one part of a block that crosses chunks
    (key is "b" and the block number). A part over the limit has no text; its size
    is kept so that the whole block is left out. A whole block over it is such a part.
    """
    too_big = F.col("n_bytes") > MAX_BLOCK_BYTES
    whole = F.col("whole") & ~too_big
    sig_key = tx.leading_lines(F.col("sigs"), options.depth)
    number = F.col("block_no").cast("string")
    # Where options say strict, making the text fails.
    text = F.col("block_text") if options.strict else F.when(~too_big, F.col("block_text"))
    keyed = pieces.select(
        _scope(options),
        "epoch",
        F.when(whole, F.concat(F.lit("s"), sig_key)).otherwise(F.concat(F.lit("b"), number)).alias("key"),
        # Parts stay apart: a part is known by its log and first line.
        F.when(~whole, F.struct("log_id", "first_line")).alias("part"),
        F.struct(
            "block_no",
            "log_id",
            "first_line",
            "n_lines",
            "n_bytes",
            text.alias("block_text"),
            # The key of a whole block says it all.
            F.when(~whole, F.col("sigs")).alias("sigs"),
        ).alias("piece"),
    )
    folded = keyed.groupBy("scope", "epoch", "key", "part").agg(
        F.min("piece").alias("piece"), F.count("*").alias("repeats")
    )
    return folded.select("scope", "epoch", "key", F.col("part").isNull().alias("whole"), "piece.*", "repeats")


def fold_again(compacted: DataFrame) -> DataFrame:
    """Compacted pieces of several batches as if they had come in one."""
    fields = ("block_no", "log_id", "first_line", "n_lines", "n_bytes", "block_text", "sigs")
    part = F.when(~F.col("whole"), F.struct("log_id", "first_line"))
    folded = compacted.groupBy("scope", "epoch", "key", "whole", part.alias("part")).agg(
        F.min(F.struct(*fields)).alias("piece"), F.sum("repeats").alias("repeats")
    )
    return folded.select("scope", "epoch", "key", "whole", "piece.*", "repeats")


def unique_blocks(compacted: DataFrame, options: CleanOptions) -> DataFrame:
    """First block of every signature and how often the signature occurs."""
    whole = F.col("whole")
    block = ["scope", "epoch", "key"]
    # A signature has one row by now, or one per batch of a stream.
    size = F.when(whole, F.lit(0)).otherwise(F.col("n_bytes"))
    parts = _size_checked(compacted, block, size, options)
    grouped = parts.groupBy(*block).agg(
        F.min(F.when(whole, F.struct("block_no", "log_id", "block_text"))).alias("best"),
        F.sum("repeats").alias("repeats"),
        F.collect_list(F.when(~whole, F.struct(*_PART))).alias("parts"),
        F.max("_size").alias("_size"),
    ).filter(F.col("_size") <= MAX_BLOCK_BYTES)
    joined = _joined_parts(F.col("parts"), options)
    crossing = F.struct(*[joined[n].alias(n) for n in ("block_no", "log_id", "block_text")])
    is_whole = F.col("best").isNotNull()
    blocks = grouped.select(
        "scope",
        "epoch",
        F.when(is_whole, F.substr("key", F.lit(2))).otherwise(joined["sig_key"]).alias("sig_key"),
        F.when(is_whole, F.col("best")).otherwise(crossing).alias("block"),
        F.when(is_whole, F.col("repeats")).otherwise(1).alias("repeats"),
    )
    first = blocks.groupBy("scope", "epoch", "sig_key").agg(
        F.min("block").alias("block"), F.sum("repeats").alias("repeats")
    )
    return first.select(
        "block.log_id", "epoch", "block.block_no", "block.block_text", "sig_key", "repeats"
    )


# --- folding without the text ----------------------------------------------------


def signature_digest(sig_key: Column) -> Column:
    """128 bits for a signature."""
    return F.unhex(F.md5(sig_key.cast("binary")))


def _signed(pieces: DataFrame, options: CleanOptions) -> DataFrame:
    """scope, epoch, block_no, digest of every block within the size limit; no text of blocks."""
    too_big = F.col("n_bytes") > MAX_BLOCK_BYTES
    block = ["scope", "epoch", "block_no"]
    sig_key = tx.leading_lines(F.col("sigs"), options.depth)
    if options.strict:
        sig_key = _checked(sig_key, too_big, _BLOCK_ERROR)
        inside = pieces.filter("whole")
    else:
        inside = pieces.filter(F.col("whole") & ~too_big)
    heads = inside.select(*block, signature_digest(sig_key).alias("digest"))
    # Blocks that cross chunks: the leading lines of their parts, two parts a chunk at most.
    so_far = W.partitionBy(*block).orderBy("log_id", "first_line").rowsBetween(*RUN)
    parts = pieces.filter(~F.col("whole")).withColumn("_size", F.sum("n_bytes").over(so_far))
    beyond = F.col("_size") > MAX_BLOCK_BYTES
    sigs = _checked(F.col("sigs"), beyond, _BLOCK_ERROR) if options.strict else F.when(~beyond, F.col("sigs"))
    joined = parts.groupBy(*block).agg(
        F.sort_array(F.collect_list(F.struct("log_id", "first_line", sigs.alias("sigs")))).alias("parts"),
        F.max("_size").alias("_size"),
    ).filter(F.col("_size") <= MAX_BLOCK_BYTES)
    whole_key = tx.leading_lines(F.flatten(F.col("parts.sigs")), options.depth)
    return heads.unionByName(joined.select(*block, signature_digest(whole_key).alias("digest")))


def fold_pieces(pieces: DataFrame, options: CleanOptions) -> DataFrame:
    """First block of every signature and how often the signature occurs, as `unique_blocks`.

    Digests are folded first, 40 bytes a block. Text is fetched for the winners alone:
    a bitmap of their numbers is tested before it is shuffled, the one time it is.
    """
    block = ["scope", "epoch", "block_no"]
    pieces = pieces.withColumn("scope", _scope(options))
    signed = _signed(pieces, options)
    winners = signed.groupBy("scope", "epoch", "digest").agg(
        F.min("block_no").alias("block_no"), F.count(F.lit(1)).alias("repeats")
    ).select(*block, "repeats")
    likely = pieces.filter(may_hold(bitmap(winners, *block).scalar(), *block))
    met = likely.select(*block, *[c for c in _PART if c != "block_no"]).join(winners, block)
    grouped = met.groupBy(*block, "repeats").agg(F.collect_list(F.struct(*_PART)).alias("parts"))
    joined = _joined_parts(F.col("parts"), options)
    return grouped.select(
        joined["log_id"].alias("log_id"),
        "epoch",
        "block_no",
        *[joined[n].alias(n) for n in ("block_text", "sig_key")],
        "repeats",
    )
