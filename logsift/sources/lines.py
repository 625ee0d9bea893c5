"""Log lines with their order, from text files, text columns or tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.sources.files import read_lines, stream_text

__all__ = ["read_lines", "stream_lines", "stream_text", "text_lines"]


def text_lines(rows: DataFrame, log_id: str, text: str) -> DataFrame:
    """Lines of a text column; a log is a row. A final newline ends the last line."""
    whole = F.regexp_replace(text, r"\n\z", "")
    pieces = F.posexplode(F.split(whole, "\n")).alias("line_no", "value")
    lines = rows.filter(F.col(text) != "").select(F.col(log_id).alias("log_id"), pieces)
    return lines.withColumn("line_no", F.col("line_no").cast("long"))


def stream_lines(spark: SparkSession, path: str, schema, **options: str) -> DataFrame:
    """Stream of a table that carries log_id, line_no and value."""
    reader = spark.readStream.schema(schema)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.parquet(path)
