"""Reports on inputs that break the size limits or the path rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.paths import path_verdict
from logsift.functions.text import is_tool_line, size_in_bytes
from logsift.options import (
    MAX_BATCH_LINES,
    MAX_BLOCK_BYTES,
    MAX_LINE_BYTES,
    MAX_PENDING_BLOCKS,
    CleanOptions,
)


def _metrics(size: Column, max_line_bytes: int) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(is_tool_line(F.col("value"))).alias("n_tool_lines"),
        F.sum(size).alias("n_bytes"),
        F.max(size).alias("longest_line"),
        F.count_if(size > max_line_bytes).alias("n_long_lines"),
    ]


def line_metrics(options: CleanOptions) -> list[Column]:
    """The measures of `log_quality` over all logs, for `observe` on lines that are read anyway."""
    return _metrics(size_in_bytes(F.col("value"), options.exact).cast("long"), MAX_LINE_BYTES)


def log_quality(
    lines: DataFrame, max_line_bytes: int = MAX_LINE_BYTES, max_lines: int = MAX_BATCH_LINES
) -> DataFrame:
    """Per log: lines, tool lines, sizes, and which limit is broken."""
    report = lines.groupBy("log_id").agg(*_metrics(F.octet_length("value").cast("long"), max_line_bytes))
    problem = (
        F.when(F.col("n_long_lines") > 0, "line_too_long")
        .when(F.col("n_lines") > max_lines, "too_many_lines")
        .otherwise("ok")
    )
    return report.withColumn("problem", problem)


def block_quality(
    numbered: DataFrame,
    max_block_bytes: int = MAX_BLOCK_BYTES,
    max_pending: int = MAX_PENDING_BLOCKS,
) -> DataFrame:
    """Per log, from numbered lines: blocks, largest block, and broken limits.

    Only sizes travel, no text.
    """
    per_block = numbered.groupBy("log_id", "block_no").agg(
        F.sum(F.octet_length("raw").cast("long") + 1).alias("size")
    )
    report = per_block.groupBy("log_id").agg(
        F.count("*").alias("n_blocks"),
        F.max("size").alias("largest_block"),
        F.count_if(F.col("size") > max_block_bytes).alias("n_large_blocks"),
    )
    problem = (
        F.when(F.col("n_large_blocks") > 0, "block_too_large")
        .when(F.col("n_blocks") > max_pending + 1, "many_blocks")
        .otherwise("ok")
    )
    return report.withColumn("problem", problem)


def require_ok(report: DataFrame) -> DataFrame:
    """The report itself; reading it fails at the first row with a problem."""
    failed = F.raise_error(F.concat(F.lit("log "), F.col("log_id").cast("string"), F.lit(": "), F.col("problem")))
    checked: Column = F.when(F.col("problem") != "ok", failed.cast("string")).otherwise(F.col("problem"))
    return report.withColumn("problem", checked)


def path_audit(paths: DataFrame, path: str = "path") -> DataFrame:
    """How many paths get each verdict."""
    return paths.groupBy(path_verdict(F.col(path)).alias("verdict")).agg(F.count("*").alias("n_paths"))
