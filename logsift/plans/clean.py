"""The log cleaner from lines to unique blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from logsift.functions import text as tx
from logsift.operators import blocks as bl
from logsift.operators import quality as ql
from logsift.options import CleanOptions


def _pieces(lines: DataFrame, options: CleanOptions, observation: Observation | None = None) -> DataFrame:
    return bl.assemble_pieces(number(lines, options, observation), options)


def _shown(blocks: DataFrame, options: CleanOptions) -> DataFrame:
    if not options.exact:
        return blocks
    return blocks.withColumns({n: tx.text_as_bytes(F.col(n)) for n in ("block_text", "sig_key")})


def number(lines: DataFrame, options: CleanOptions | None = None, observation: Observation | None = None) -> DataFrame:
    """Kept lines with epoch and block_no; see `blocks.number_lines`.

    With options.exact texts have a character for each byte (`functions.text.bytes_as_text`).
    """
    options = options or CleanOptions()
    if options.exact:
        options = options.over_bytes()
        lines = lines.withColumn("value", tx.bytes_as_text(F.col("value")))
    flagged = bl.flag_lines(lines, options)
    totals = bl.chunk_totals(flagged, options.exact)
    if observation is not None:
        # On the way of the lines to their shuffle, which happens once.
        flagged = flagged.observe(observation, *ql.line_metrics(options))
    return bl.number_lines(flagged, bl.place_chunks(totals, options), options)


def blocks(lines: DataFrame, options: CleanOptions | None = None) -> DataFrame:
    """Every block of the logs, repeats included."""
    options = options or CleanOptions()
    return _shown(bl.assemble_blocks(_pieces(lines, options), options), options)


def oversize(lines: DataFrame, options: CleanOptions | None = None) -> DataFrame:
    """Lines of the blocks that `clean` and `blocks` leave out for their size."""
    options = options or CleanOptions()
    return bl.oversize_lines(number(lines, options), options)


def clean(
    lines: DataFrame, options: CleanOptions | None = None, observation: Observation | None = None
) -> DataFrame:
    """One block per signature: log_id, epoch, block_no, block_text, sig_key, repeats.

    With options.exact, block_text and sig_key are binary and hold the bytes of the log.
    An `observation` gets the sizes of all lines while the blocks are made: see
    `operators.quality.line_metrics`.

    `lines` has log_id, line_no and value. The rows come in no set order;
    `sinks.write_blocks` sorts them. Blocks beyond the size limit fail if options say
    strict; else their lines are what `oversize` gives.
    """
    if lines.isStreaming:
        raise ValueError("lines must be a table; streaming.BlockStream takes streams")
    options = options or CleanOptions()
    return _shown(bl.fold_pieces(_pieces(lines, options, observation), options), options)
