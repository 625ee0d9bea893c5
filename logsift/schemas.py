"""Schemas of the tables the library reads."""

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


LOG_LINES = _schema(log_id=T.StringType(), line_no=T.LongType(), value=T.StringType())

FILE_CHANGES = _schema(
    range_id=T.StringType(),
    status=T.StringType(),
    path=T.StringType(),
    new_path=T.StringType(),
    ins_txt=T.StringType(),
    del_txt=T.StringType(),
)

DIFF_LINES = _schema(
    range_id=T.StringType(),
    path=T.StringType(),
    line_no=T.LongType(),
    sign=T.StringType(),
    text=T.StringType(),
)

COMMITS = _schema(
    range_id=T.StringType(),
    commit_id=T.StringType(),
    committed_at=T.TimestampType(),
    is_merge=T.BooleanType(),
    subject=T.StringType(),
    body=T.StringType(),
)

TAGS = _schema(repo=T.StringType(), tag=T.StringType(), points_at_head=T.BooleanType())

OPTION_SOURCES = _schema(
    range_id=T.StringType(),
    side=T.StringType(),
    path=T.StringType(),
    line_no=T.LongType(),
    text=T.StringType(),
)

WEIGHTS = _schema(category=T.StringType(), rule=T.StringType(), weight=T.DoubleType())

BLOCKS = _schema(
    log_id=T.StringType(),
    epoch=T.LongType(),
    block_no=T.LongType(),
    block_text=T.StringType(),
    sig_key=T.StringType(),
    repeats=T.LongType(),
)
