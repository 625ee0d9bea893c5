"""Change, commit and tag tables with their fixed schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from logsift import schemas

FORMATS = ("parquet", "orc", "json", "csv")


def read_table(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    kind: str = "parquet",
    **options: str,
) -> DataFrame:
    """A table in one of the built-in formats, read with the given schema."""
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {', '.join(FORMATS)}")
    reader = spark.read.format(kind).schema(schema).options(**options)
    return reader.load(paths if isinstance(paths, str) else list(paths))


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows of the schema: what a missing input counts as."""
    return spark.createDataFrame([], schema)


def file_changes(spark: SparkSession, paths, kind: str = "parquet", **options) -> DataFrame:
    return read_table(spark, paths, schemas.FILE_CHANGES, kind, **options)


def diff_lines(spark: SparkSession, paths, kind: str = "parquet", **options) -> DataFrame:
    return read_table(spark, paths, schemas.DIFF_LINES, kind, **options)


def commits(spark: SparkSession, paths, kind: str = "parquet", **options) -> DataFrame:
    return read_table(spark, paths, schemas.COMMITS, kind, **options)


def tags(spark: SparkSession, paths, kind: str = "parquet", **options) -> DataFrame:
    return read_table(spark, paths, schemas.TAGS, kind, **options)


def option_sources(spark: SparkSession, paths, kind: str = "parquet", **options) -> DataFrame:
    return read_table(spark, paths, schemas.OPTION_SOURCES, kind, **options)
