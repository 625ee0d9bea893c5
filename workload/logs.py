"""Queries on log lines and blocks."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsift import CleanOptions, clean, sinks
from logsift.functions import text as tx
from logsift.operators import blocks as bl
from logsift.operators import quality as ql
from logsift.plans import clean as plan
from logsift.sources.lines import read_lines, stream_text
from logsift.sources.storage import fresh_folder
from logsift.streaming import BlockStream
from workload import derived as dv

DEPTH_3 = CleanOptions(depth=3)
SILENT_MS = 6 * 3_600_000

# --- the same steps in SQL -----------------------------------------------------

_WS = r"[ \t\n\x0B\f\r]"
_TOOL = "regexp_matches(value, '^==[0-9]{2,}==')"
_TEXT = rf"regexp_replace(value, '^==[0-9]{{2,}}=={_WS}*', '')"
_OPENS = (
    "regexp_matches(text, 'Invalid read|Invalid write|Syscall param|Use of uninitialised"
    "|Conditional jump|bytes in |still reachable|possibly lost|definitely lost|Process terminating')"
)
_HEAD = "regexp_matches(text, '^[^0-9]*[0-9]+ bytes in [0-9]+ blocks')"
_MARK = "contains(value, 'Successfully downloaded debug')"


def canon_sql(c: str) -> str:
    for pattern, replacement in (
        ("0x[0-9a-fA-F]+", "0xADDR"),
        (":[0-9]+", ":LINE"),
        (r"\[[0-9]*\]", "[]"),
        ("<[^>]*>", "<T>"),
        (f"{_WS}+", " "),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{replacement}', 'g')"
    return f"trim({c}, ' ')"


def scrub_sql(c: str) -> str:
    for pattern in ("0x[0-9a-fA-F]+", "at : ", "by : ", r"\?{3,}"):
        c = f"regexp_replace({c}, '{pattern}', '', 'g')"
    return c


def _numbered(trim: bool = True, scrub: bool = True, one_log: bool = False) -> str:
    """CTEs up to `kept`: kept lines with scope, epoch, block_no."""
    scope = "0" if one_log else "log_id"
    mark = f"CASE WHEN {_MARK} THEN 1 ELSE 0 END" if trim else "0"
    wanted = "is_mark = 0 AND epoch = last_epoch AND epoch > 0" if trim else "true"
    raw = scrub_sql("text") if scrub else "text"
    return rf"""{dv.LOG_SQL},
    flagged AS (SELECT *, {scope} AS scope, {mark} AS is_mark,
                CASE WHEN {_TOOL} THEN {_TEXT} END AS text FROM log),
    placed AS (SELECT *, sum(is_mark) OVER w AS epoch, sum(is_mark) OVER (PARTITION BY scope) AS last_epoch,
               CAST(sum(CASE WHEN is_mark = 0 AND text IS NOT NULL AND {_OPENS} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS block_no
               FROM flagged WINDOW w AS (PARTITION BY scope ORDER BY log_id, line_no)),
    kept AS (SELECT *, {raw} AS raw, row_number() OVER (PARTITION BY scope, block_no ORDER BY log_id, line_no) AS pos
             FROM placed WHERE text IS NOT NULL AND {wanted} AND NOT ({_OPENS} AND {_HEAD})
             AND regexp_matches({raw}, '[^ \t\n\x0B\f\r]'))"""


def _blocks(depth: int, **kind: bool) -> str:
    first = f"FILTER (WHERE pos <= {depth})" if depth else ""
    return f"""{_numbered(**kind)},
    blocks AS (SELECT scope, min(log_id) AS log_id, CAST(max(epoch) AS BIGINT) AS epoch, block_no,
               count(*) AS n_lines,
               string_agg(raw, chr(10) ORDER BY log_id, line_no) AS block_text,
               string_agg({canon_sql("text")}, chr(10) ORDER BY log_id, line_no) {first} AS sig_key
               FROM kept GROUP BY scope, block_no)"""


def _unique(depth: int, columns: str = "log_id, epoch, block_no, block_text, sig_key, repeats", **kind) -> str:
    return f"""WITH {_blocks(depth, **kind)},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY scope, sig_key ORDER BY block_no) AS place,
               count(*) OVER (PARTITION BY scope, sig_key) AS repeats FROM blocks)
    SELECT {columns} FROM ranked WHERE place = 1"""


# --- queries -------------------------------------------------------------------


def tool_lines(spark: SparkSession, folder: str) -> DataFrame:
    log = dv.log_lines(spark, folder)
    return log.filter(tx.is_tool_line(F.col("value"))).select("log_id", "line_no", "value")


def strip_prefix(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("value")
    lines = tool_lines(spark, folder)
    return lines.select("log_id", "line_no", tx.pid(value).alias("pid"), tx.strip_prefix(value).alias("text"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return strip_prefix(spark, folder).select("log_id", "line_no", "text")


def block_starts(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).filter(tx.opens_block(F.col("text")))


def leak_heads(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).filter(tx.is_leak_head(F.col("text")))


def frame_flags(spark: SparkSession, folder: str) -> DataFrame:
    bare = tx.apply_rules(F.col("text"), (("0x[0-9a-fA-F]+", ""),))
    lines = _texts(spark, folder).withColumn("bare", bare)
    flags = {"has_at": tx.has_at, "has_by": tx.has_by, "has_unknown": tx.has_unknown}
    return lines.select("log_id", "line_no", *[f(F.col("bare")).alias(n) for n, f in flags.items()])


def canon_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("log_id", "line_no", tx.canonical(F.col("text")).alias("sig"))


def canon_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = dv.table(spark, folder, "pages")
    return pages.select("page_id", tx.canonical(F.col("html")).alias("sig"))


def canon_documents(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("value")
    return dv.document_lines(spark, folder).select(
        "log_id",
        "line_no",
        tx.canonical(value).alias("sig"),
        tx.trim_white(value).alias("trimmed"),
        tx.trim_end(value).alias("trimmed_end"),
    )


def scrub_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("log_id", "line_no", tx.scrubbed(F.col("text")).alias("raw"))


def nonblank_lines(spark: SparkSession, folder: str) -> DataFrame:
    return scrub_lines(spark, folder).filter(~tx.is_blank(F.col("raw")))


def after_last_marker(spark: SparkSession, folder: str) -> DataFrame:
    return bl.after_last_marker(dv.log_lines(spark, folder), CleanOptions())


def epochs(spark: SparkSession, folder: str) -> DataFrame:
    return bl.with_epochs(dv.log_lines(spark, folder), CleanOptions())


def number_blocks(spark: SparkSession, folder: str) -> DataFrame:
    numbered = plan.number(dv.log_lines(spark, folder))
    return numbered.select("log_id", "epoch", "block_no", "line_no", "raw")


def assemble_blocks(spark: SparkSession, folder: str) -> DataFrame:
    blocks = plan.blocks(dv.log_lines(spark, folder), DEPTH_3)
    return blocks.select("log_id", "epoch", "block_no", "n_lines", "block_text")


def _signatures(depth: int):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        blocks = plan.blocks(dv.log_lines(spark, folder), CleanOptions(depth=depth))
        return blocks.select("log_id", "block_no", "sig_key")

    return query


def _clean(options: CleanOptions):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return clean(dv.log_lines(spark, folder), options)

    return query


def block_repeats(spark: SparkSession, folder: str) -> DataFrame:
    unique = clean(dv.log_lines(spark, folder), CleanOptions(trim=False))
    return unique.select("log_id", "sig_key", "repeats")


def dedup_document_lines(spark: SparkSession, folder: str) -> DataFrame:
    return bl.unique_lines(dv.document_lines(spark, folder))


def log_quality(spark: SparkSession, folder: str) -> DataFrame:
    report = ql.log_quality(dv.log_lines(spark, folder), max_line_bytes=80, max_lines=300)
    return report


def block_quality(spark: SparkSession, folder: str) -> DataFrame:
    return ql.block_quality(plan.number(dv.log_lines(spark, folder)), max_block_bytes=150)


def oversize_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the blocks over 90 bytes, numbered inside their block."""
    options = CleanOptions()
    return bl.oversize_lines(plan.number(dv.log_lines(spark, folder), options), options, 90)


def text_file_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents written as text files and read back: their order within a document."""
    path = fresh_folder(spark, "lines")
    rows = dv.document_lines(spark, folder)
    text = F.concat_ws("\t", "log_id", "line_no", "value").alias("value")
    ordered = rows.repartitionByRange("log_id").sortWithinPartitions("log_id", "line_no")
    ordered.select(text).write.option("lineSep", "\n").text(path)
    lines = read_lines(spark, path)
    parts = F.split("value", "\t", 3)
    named = lines.select(parts[0].cast("long").alias("doc_id"), "line_no", parts[1].cast("long").alias("written"), parts[2].alias("value"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("line_no")).cast("long") - 1
    return named.select("doc_id", place.alias("line_no"), "written", "value")


def block_text_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks written as text, an empty line after each, and read back."""
    path = fresh_folder(spark, "blocks")
    sinks.write_blocks(_clean(DEPTH_3)(spark, folder), path)
    blocks = spark.read.option("lineSep", "\n\n").text(path).filter(F.col("value") != "")
    return blocks.groupBy(F.col("value").alias("block_text")).agg(F.count("*").alias("n_blocks"))


def path_audit(spark: SparkSession, folder: str) -> DataFrame:
    pages = dv.table(spark, folder, "pages")
    tail = F.regexp_replace("url", "^https?://[^/]*", "")
    path = (
        F.when(F.col("page_id") % 4 == 0, F.substr(tail, F.lit(2)))
        .when(F.col("page_id") % 4 == 1, tail)
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("../"), F.substr(tail, F.lit(2))))
        .otherwise(F.substr(tail, F.lit(2)))
    )
    return ql.path_audit(pages.select(path.alias("path")))


def _streamed(spark: SparkSession, folder: str) -> BlockStream:
    """The log arrives in three runs of lines; the stream is stopped between them."""
    base = fresh_folder(spark, "stream")
    log = dv.log_lines(spark, folder)
    last = log.agg(F.max("line_no").alias("n")).first()["n"]
    stream = BlockStream(spark, f"{base}/store", DEPTH_3)
    for part in range(3):
        low, high = last * part // 3, last * (part + 1) // 3
        arrived = dv.log_run(spark, folder, low if part else None, high)
        arrived.write.mode("append").parquet(f"{base}/lines")
        lines = spark.readStream.schema(log.schema).parquet(f"{base}/lines")
        stream.start(lines, f"{base}/checkpoint", availableNow=True).awaitTermination()
    return stream


def stream_unique_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _streamed(spark, folder).blocks(2)


def _put_lines(base: str):
    """Writes a log's lines as its text file; a file that is there is replaced as a whole."""

    def run(table: pa.Table) -> pa.Table:
        log_id, ordered = table.column("log_id")[0].as_py(), table.sort_by("line_no")
        body = "".join(f"{v}\n" for v in ordered.column("value").to_pylist())
        # The first line names the log, so that the file is known by it.
        place = f"{base}/{log_id}.log"
        with open(f"{place}.part-{uuid.uuid4().hex}", "wb") as file:
            file.write(f"log {log_id}\n{body}".encode())
        os.replace(file.name, place)
        return pa.table({"log_id": [str(log_id)]})

    return run


def stream_text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Unique blocks of text files that grow, twice: half of each log, then all of it."""
    base = fresh_folder(spark, "texts").removeprefix("file://").removeprefix("file:")
    os.makedirs(f"{base}/logs")
    log = dv.log_lines(spark, folder)
    last = log.agg(F.max("line_no").alias("n")).first()["n"]
    # A byte offset is a line's number here: chunks of 64 KB.
    stream = BlockStream(spark, f"{base}/store", CleanOptions(depth=3, chunk_bits=16))
    for high in (last // 2, last):
        part = log.filter(F.col("line_no") <= high).groupBy("log_id").applyInArrow(_put_lines(f"{base}/logs"), "log_id string")
        part.write.format("noop").mode("overwrite").save()
        lines = stream_text(spark, f"{base}/logs/*.log", positions=f"{base}/positions")
        stream.start(lines, f"{base}/checkpoint", availableNow=True).awaitTermination()
    blocks = stream.blocks(stream.last_batch())
    log_id = F.regexp_extract("log_id", r"([0-9]+)\.log#", 1).cast("long")
    return blocks.select(log_id.alias("log_id"), "epoch", "block_text", "sig_key", "repeats")


def stream_final_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of the logs that were silent for six hours when the last line of all came."""
    base = fresh_folder(spark, "final")
    log = dv.timed_log_lines(spark, folder)
    last = log.agg(F.max("line_no").alias("n")).first()["n"]
    stream = BlockStream(spark, f"{base}/store", DEPTH_3)
    for low, high in ((-1, last // 2), (last // 2, last)):
        arrived = log.filter((F.col("line_no") > low) & (F.col("line_no") <= high))
        arrived.write.mode("append").parquet(f"{base}/lines")
        lines = spark.readStream.schema(arrived.schema).parquet(f"{base}/lines")
        stream.start(lines, f"{base}/checkpoint", availableNow=True).awaitTermination()
    stream.start_closing(f"{base}/closing", SILENT_MS, availableNow=True).awaitTermination()
    return stream.final().drop("last_time")


def stream_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Logs whose waiting blocks are too many, by a limit of one."""
    return _streamed(spark, folder).pending(2, limit=1)


QUERIES = {
    "tool_lines": tool_lines,
    "strip_prefix": strip_prefix,
    "block_starts": block_starts,
    "leak_heads": leak_heads,
    "frame_flags": frame_flags,
    "canon_lines": canon_lines,
    "canon_html": canon_html,
    "canon_documents": canon_documents,
    "scrub_lines": scrub_lines,
    "nonblank_lines": nonblank_lines,
    "after_last_marker": after_last_marker,
    "epochs": epochs,
    "number_blocks": number_blocks,
    "assemble_blocks": assemble_blocks,
    "signature_depth1": _signatures(1),
    "signature_depth3": _signatures(3),
    "signature_all": _signatures(0),
    "unique_blocks": _clean(DEPTH_3),
    "unique_blocks_default": _clean(CleanOptions()),
    "unique_blocks_keep_all": _clean(CleanOptions(depth=0, trim=False)),
    "unique_blocks_raw": _clean(CleanOptions(depth=3, scrub=False)),
    "unique_blocks_all_logs": _clean(CleanOptions(depth=3, scope="all")),
    "unique_blocks_all_logs_keep_all": _clean(CleanOptions(depth=3, scope="all", trim=False)),
    "block_repeats": block_repeats,
    "dedup_document_lines": dedup_document_lines,
    "log_quality": log_quality,
    "block_quality": block_quality,
    "oversize_blocks": oversize_blocks,
    "text_file_lines": text_file_lines,
    "block_text_round_trip": block_text_round_trip,
    "path_audit": path_audit,
    "stream_unique_blocks": stream_unique_blocks,
    "stream_pending": stream_pending,
    "stream_text_blocks": stream_text_blocks,
    "stream_final_blocks": stream_final_blocks,
}

_TEXTS = f"WITH {dv.LOG_SQL}, texts AS (SELECT *, {_TEXT} AS text FROM log WHERE {_TOOL})"
_NO_ADDR = "regexp_replace(text, '0x[0-9a-fA-F]+', '', 'g')"

ORACLE = {
    "tool_lines": f"WITH {dv.LOG_SQL} SELECT log_id, line_no, value FROM log WHERE {_TOOL}",
    "strip_prefix": f"{_TEXTS} SELECT log_id, line_no, regexp_extract(value, '^==([0-9]+)==', 1) AS pid, text FROM texts",
    "block_starts": f"{_TEXTS} SELECT log_id, line_no, text FROM texts WHERE {_OPENS}",
    "leak_heads": f"{_TEXTS} SELECT log_id, line_no, text FROM texts WHERE {_HEAD}",
    "frame_flags": f"""{_TEXTS} SELECT log_id, line_no, contains({_NO_ADDR}, 'at : ') AS has_at,
        contains({_NO_ADDR}, 'by : ') AS has_by, contains({_NO_ADDR}, '???') AS has_unknown FROM texts""",
    "canon_lines": f"{_TEXTS} SELECT log_id, line_no, {canon_sql('text')} AS sig FROM texts",
    "canon_html": f"SELECT page_id, {canon_sql('html')} AS sig FROM pages",
    "canon_documents": rf"""WITH {dv.DOC_LINES_SQL} SELECT log_id, line_no, {canon_sql("value")} AS sig,
        regexp_replace(regexp_replace(value, '{_WS}+\z', ''), '\A{_WS}+', '') AS trimmed,
        regexp_replace(value, '{_WS}+\z', '') AS trimmed_end FROM doc_lines""",
    "scrub_lines": f"{_TEXTS} SELECT log_id, line_no, {scrub_sql('text')} AS raw FROM texts",
    "nonblank_lines": rf"""{_TEXTS} SELECT log_id, line_no, {scrub_sql("text")} AS raw FROM texts
        WHERE regexp_matches({scrub_sql("text")}, '[^ \t\n\x0B\f\r]')""",
    "after_last_marker": f"""WITH {dv.LOG_SQL},
        cut AS (SELECT log_id, max(line_no) AS cut_line FROM log WHERE {_MARK} GROUP BY log_id)
        SELECT log_id, line_no, value FROM log JOIN cut USING (log_id) WHERE line_no > cut_line""",
    "epochs": f"""WITH {dv.LOG_SQL} SELECT log_id, line_no, value,
        CAST(sum(CASE WHEN {_MARK} THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY line_no) AS BIGINT) AS epoch
        FROM log""",
    "number_blocks": f"WITH {_numbered()} SELECT log_id, CAST(epoch AS BIGINT) AS epoch, block_no, line_no, raw FROM kept",
    "assemble_blocks": f"WITH {_blocks(3)} SELECT log_id, epoch, block_no, n_lines, block_text FROM blocks",
    "signature_depth1": f"WITH {_blocks(1)} SELECT log_id, block_no, sig_key FROM blocks",
    "signature_depth3": f"WITH {_blocks(3)} SELECT log_id, block_no, sig_key FROM blocks",
    "signature_all": f"WITH {_blocks(0)} SELECT log_id, block_no, sig_key FROM blocks",
    "unique_blocks": _unique(3),
    "unique_blocks_default": _unique(1),
    "unique_blocks_keep_all": _unique(0, trim=False),
    "unique_blocks_raw": _unique(3, scrub=False),
    "unique_blocks_all_logs": _unique(3, one_log=True),
    "unique_blocks_all_logs_keep_all": _unique(3, one_log=True, trim=False),
    "block_repeats": _unique(1, columns="log_id, sig_key, repeats", trim=False),
    "dedup_document_lines": f"""WITH {dv.DOC_LINES_SQL},
        keyed AS (SELECT *, {canon_sql("value")} AS sig_key FROM doc_lines),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY log_id, sig_key ORDER BY line_no) AS place,
                   count(*) OVER (PARTITION BY log_id, sig_key) AS repeats FROM keyed)
        SELECT log_id, line_no, value, sig_key, repeats FROM ranked WHERE place = 1 AND sig_key <> ''""",
    "log_quality": f"""WITH {dv.LOG_SQL} SELECT *, CASE WHEN n_long_lines > 0 THEN 'line_too_long'
        WHEN n_lines > 300 THEN 'too_many_lines' ELSE 'ok' END AS problem FROM (
        SELECT log_id, count(*) AS n_lines, count(*) FILTER (WHERE {_TOOL}) AS n_tool_lines,
        CAST(sum(strlen(value)) AS BIGINT) AS n_bytes, max(strlen(value)) AS longest_line,
        count(*) FILTER (WHERE strlen(value) > 80) AS n_long_lines FROM log GROUP BY log_id) q""",
    "block_quality": f"""WITH {_numbered()}, sizes AS (SELECT log_id, block_no,
        CAST(sum(strlen(raw) + 1) AS BIGINT) AS size FROM kept GROUP BY log_id, block_no)
        SELECT *, CASE WHEN n_large_blocks > 0 THEN 'block_too_large' ELSE 'ok' END AS problem FROM (
        SELECT log_id, count(*) AS n_blocks, max(size) AS largest_block,
        count(*) FILTER (WHERE size > 150) AS n_large_blocks FROM sizes GROUP BY log_id) q""",
    "path_audit": r"""WITH tails AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS tail FROM pages),
        paths AS (SELECT CASE page_id % 4 WHEN 0 THEN substr(tail, 2) WHEN 1 THEN tail
                  WHEN 2 THEN concat('../', substr(tail, 2)) ELSE substr(tail, 2) END AS path FROM tails)
        SELECT CASE WHEN path = '-' THEN 'ok' WHEN path = '' THEN 'empty_or_nul'
          WHEN regexp_matches(path, '[`$(){}\[\]|&;<>"''\\]') THEN 'dangerous'
          WHEN path[1] = '/' OR regexp_matches(path, '^[\x00-\x7F]:[/\\]') THEN 'absolute'
          WHEN contains(path, '..') THEN 'traversal' ELSE 'ok' END AS verdict, count(*) AS n_paths
        FROM paths GROUP BY 1""",
    "stream_unique_blocks": _unique(3),
    "stream_text_blocks": _unique(3, columns="log_id, epoch, block_text, sig_key, repeats"),
    # A watermark counts whole milliseconds.
    "stream_final_blocks": f"""WITH last AS (SELECT user_id AS log_id, max(ts) AS said_at FROM events GROUP BY user_id)
        SELECT u.* FROM ({_unique(3)}) u JOIN last USING (log_id)
        WHERE epoch_ms(said_at) + {SILENT_MS} < (SELECT epoch_ms(max(said_at)) FROM last)""",
    "stream_pending": f"""SELECT log_id, count(*) AS n_pending,
        CASE WHEN count(*) > 2 THEN 'too_many_pending' ELSE 'ok' END AS problem FROM ({_unique(3)}) u GROUP BY log_id""",
    "oversize_blocks": f"""WITH {_numbered()}, sizes AS (SELECT scope, block_no, sum(strlen(raw) + 1) AS size
        FROM kept GROUP BY scope, block_no)
        SELECT log_id, CAST(epoch AS BIGINT) AS epoch, block_no,
          row_number() OVER (PARTITION BY scope, block_no ORDER BY line_no) AS part_no, raw AS text
        FROM kept JOIN sizes USING (scope, block_no) WHERE size > 90""",
    "text_file_lines": f"""WITH {dv.DOC_LINES_SQL}
        SELECT log_id AS doc_id, line_no, line_no AS written, value FROM doc_lines""",
    "block_text_round_trip": f"""SELECT block_text, count(*) AS n_blocks FROM ({_unique(3)}) u GROUP BY block_text""",
}
