"""Logs, changes, commits and tags derived from the given tables.

Every derived table exists twice with the same text: as a DataFrame and as SQL
for the other engine.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.sources.lines import text_lines


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def run_sql(spark: SparkSession, sql: str, rows: DataFrame) -> DataFrame:
    """SQL text that ends in FROM, over the rows."""
    view = f"rows_{uuid.uuid4().hex}"
    rows.createTempView(view)
    result = spark.sql(f"{sql.replace('VARCHAR', 'STRING')} {view}")
    spark.catalog.dropTempView(view)
    return result


# --- a log of every user -------------------------------------------------------

_LOG = """
SELECT user_id AS log_id, event_id * 8 + k AS line_no,
  CASE WHEN k = 0 AND event_type = 'error' AND event_id % 5 = 0
       THEN '--pid-- Successfully downloaded debug info'
  ELSE concat('==', CAST(10000 + user_id AS VARCHAR), '== ', CASE k
    WHEN 0 THEN CASE event_type
      WHEN 'error' THEN concat('Invalid read of size ', CAST(event_id % 3 * 4 + 4 AS VARCHAR))
      WHEN 'click' THEN 'Conditional jump or move depends on uninitialised value(s)'
      WHEN 'view' THEN concat(CAST(event_id % 90 + 10 AS VARCHAR), ' bytes in ',
                              CAST(event_id % 4 + 1 AS VARCHAR),
                              ' blocks are definitely lost in loss record 1 of 2')
      ELSE 'Syscall param write(buf) points to uninitialised byte(s)' END
    WHEN 1 THEN concat('   at 0x', CAST(4198964 + event_id AS VARCHAR), ': fn_',
                       CAST(event_id % 7 AS VARCHAR), '<int>(int) (mod',
                       CAST(event_id % 3 AS VARCHAR), '.cpp:', CAST(event_id % 50 AS VARCHAR), ')')
    WHEN 2 THEN concat('   by 0x', CAST(4198900 + user_id AS VARCHAR), ': run[',
                       CAST(event_id % 9 AS VARCHAR), '] (app.cpp:',
                       CAST(event_id % 11 + 1 AS VARCHAR), ')')
    WHEN 3 THEN CASE WHEN event_id % 4 = 0 THEN '   by 0x4005A1: ???'
                     ELSE '   by 0x4005A1: main (main.cpp:8)' END
    ELSE '' END) END AS value
FROM """

LOG_SQL = f"log AS ({_LOG} (SELECT *, unnest(range(0, 5)) AS k FROM events) e)"


def _lines_of(spark: SparkSession, events: DataFrame) -> DataFrame:
    return run_sql(spark, _LOG, events.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _lines_of(spark, table(spark, folder, "events").select("event_id", "user_id", "event_type"))


def log_run(spark: SparkSession, folder: str, above: int | None, high: int) -> DataFrame:
    """Lines of the log with numbers above `above`, if given, up to `high`, dealt evenly.

    Events lie in their files by number as often as not: those of the run are dealt,
    a fifth of the rows and without text, before they are made lines.
    """
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    low = F.lit(True) if above is None else F.col("event_id") * 8 + 4 > above
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.filter(low & (F.col("event_id") * 8 <= high)).repartitionByRange(parts, "event_id")
    lines = _lines_of(spark, dealt).filter(F.col("line_no") <= high)
    return lines if above is None else lines.filter(F.col("line_no") > above)


_TIMED_LOG = _LOG.replace("AS value\nFROM", "AS value, time\nFROM")


def timed_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same log with the time of the event of each line."""
    events = table(spark, folder, "events")
    times = events.select("event_id", F.col("ts").alias("time"))
    # Events are joined, a fifth of the rows and without text, and then made lines.
    timed = events.select("event_id", "user_id", "event_type").join(times, "event_id")
    return run_sql(spark, _TIMED_LOG, timed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))))


# --- lines of documents --------------------------------------------------------

DOC_LINES_SQL = r"""doc_lines AS (
  SELECT doc_id AS log_id, unnest(parts) AS value,
         CAST(unnest(range(0, len(parts))) AS BIGINT) AS line_no
  FROM (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS parts
        FROM documents WHERE text <> '') d)"""


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    return text_lines(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


# --- a diff of every range -----------------------------------------------------

_DIFF = """
SELECT concat('r', CAST(log_id % 200 AS VARCHAR)) AS range_id,
  CASE WHEN log_id % 37 = 5 THEN CAST(NULL AS VARCHAR)
    ELSE concat('src/mod', CAST(log_id % 17 AS VARCHAR), CASE WHEN log_id % 6 = 0 THEN '.py' ELSE '.c' END) END AS path,
  log_id * 100000 + line_no AS line_no,
  CASE line_no % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END AS sign,
  CASE (log_id * 7 + line_no) % 24
    WHEN 0 THEN concat('// CLI BREAKING ', value)
    WHEN 1 THEN concat('  # API-BREAKING: ', value)
    WHEN 2 THEN concat('/* new feature */', value)
    WHEN 3 THEN concat('-- SECURITY ', value)
    WHEN 4 THEN concat('//REMOVED   OPTIONS ', value)
    WHEN 5 THEN concat('# added option ', value)
    WHEN 6 THEN concat('buffer overflow in token parser, CVE-2024-12345 ', value)
    WHEN 7 THEN concat('while ((c = getopt(argc, argv, "ab:c")) != -1) ', value)
    WHEN 8 THEN concat('case ', CAST(line_no % 5 AS VARCHAR), ': --verbose-', CAST(log_id % 5 AS VARCHAR))
    WHEN 9 THEN concat('int main(int argc, char **argv) { ', value)
    WHEN 10 THEN concat('void fn', CAST(line_no % 9 AS VARCHAR), '(int a);')
    WHEN 11 THEN '++ b/file'
    WHEN 12 THEN concat('if (argc > 1 && argv[1]) usage(--opt', CAST(line_no % 4 AS VARCHAR))
    WHEN 13 THEN concat('fatal error, session  hijacked; stack trace ', value)
    WHEN 14 THEN concat('   x = ', CAST(line_no % 4 AS VARCHAR), ';  ')
    WHEN 15 THEN concat('x=', CAST(line_no % 4 AS VARCHAR), ';')
    WHEN 16 THEN concat('heap-overflow and use after free, exploité ', value)
    ELSE value END AS text
FROM """

DIFF_SQL = f"{DOC_LINES_SQL}, diff AS ({_DIFF} doc_lines)"


def diff_lines(spark: SparkSession, folder: str) -> DataFrame:
    return run_sql(spark, _DIFF, document_lines(spark, folder))


# A document's lines, three at a time, are a hunk: an added, a removed and a context line.
HUNK = "line_no div 100000 * 100000 + line_no % 100000 div 3"
HUNK_SQL = "line_no // 100000 * 100000 + line_no % 100000 // 3"


def diff_hunks(spark: SparkSession, folder: str) -> DataFrame:
    """The diff with a hunk for every line."""
    return diff_lines(spark, folder).withColumn("hunk", F.expr(HUNK))


_SOURCES = """
SELECT concat('r', CAST(log_id % 200 AS VARCHAR)) AS range_id,
  CASE WHEN log_id % 400 < 200 THEN 'before' ELSE 'after' END AS side,
  concat('src/cli', CAST(log_id % 3 AS VARCHAR), '.c') AS path,
  log_id * 100000 + line_no AS line_no,
  CASE (log_id + line_no) % 9
    WHEN 0 THEN 'static struct option long_options[] = {'
    WHEN 1 THEN concat('  { "name-', CAST(log_id % 23 AS VARCHAR), '", no_argument, 0, 1 },')
    WHEN 2 THEN concat('  { .name = "opt', CAST(line_no % 13 AS VARCHAR), '" },')
    WHEN 3 THEN '};'
    WHEN 4 THEN concat('  { "outside-', CAST(log_id % 5 AS VARCHAR), '" }')
    WHEN 5 THEN concat('c = getopt_long (argc, argv, "hv', chr(CAST(97 + log_id % 20 AS INT)), ':x", long_options)')
    ELSE value END AS text
FROM """

SOURCES_SQL = f"{DOC_LINES_SQL}, sources AS ({_SOURCES} doc_lines)"


def option_sources(spark: SparkSession, folder: str) -> DataFrame:
    return run_sql(spark, _SOURCES, document_lines(spark, folder))


# --- files, commits, tags, versions --------------------------------------------

_FILES = """
SELECT concat('r', CAST(l_orderkey % 200 AS VARCHAR)) AS range_id,
  CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D'
    WHEN 3 THEN 'R100' WHEN 4 THEN 'T' WHEN 5 THEN 'A' ELSE 'C075' END AS status,
  concat(CASE l_suppkey % 9 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'Docs/'
    WHEN 3 THEN 'build/' WHEN 4 THEN 'core/lib/' WHEN 5 THEN '' WHEN 6 THEN 'examples/'
    WHEN 7 THEN 'third-party/' ELSE 'src/test/' END,
    CASE l_partkey % 6 WHEN 0 THEN 'README' ELSE concat('f', CAST(l_partkey % 40 AS VARCHAR)) END,
    CASE l_partkey % 11 WHEN 0 THEN '.c' WHEN 1 THEN '.cpp' WHEN 2 THEN '.md' WHEN 3 THEN '.TXT'
    WHEN 4 THEN '_test.py' WHEN 5 THEN '.png' WHEN 6 THEN '.h' WHEN 7 THEN '' WHEN 8 THEN '.lock'
    WHEN 9 THEN '.dat' ELSE '.sh' END) AS path,
  concat('moved/f', CAST(l_partkey % 40 AS VARCHAR), '.c') AS new_path,
  CASE WHEN l_partkey % 13 = 0 THEN '-' ELSE CAST(l_partkey % 50 AS VARCHAR) END AS ins_txt,
  CASE WHEN l_partkey % 13 = 0 THEN '-' ELSE CAST(l_suppkey % 20 AS VARCHAR) END AS del_txt
FROM """

FILES_SQL = f"files AS ({_FILES} lineitem)"


def file_changes(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return run_sql(spark, _FILES, lineitem)


_COMMITS = """
SELECT concat('r', CAST(o_custkey % 200 AS VARCHAR)) AS range_id,
  concat('repo', CAST(o_custkey % 40 AS VARCHAR)) AS repo,
  o_orderkey AS commit_id, o_orderdate AS committed_at, 
  CASE WHEN o_orderkey % 17 <> 3 THEN o_orderkey % 11 = 0 END AS is_merge,
  CASE o_orderkey % 13 WHEN 0 THEN 'Breaking: new CLI' WHEN 1 THEN 'API breaking change'
    WHEN 2 THEN 'BREAKING CHANGE in output' WHEN 3 THEN 'Features: added a report'
    WHEN 4 THEN 'Fix vulnerability CVE-2023-1234' WHEN 5 THEN 'path traversal and xss'
    WHEN 6 THEN 'Breaking — major rework' ELSE concat('Order ', o_orderpriority) END AS subject,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('See notes', chr(10), 'security token rotated', chr(10), 'x')
    WHEN o_orderkey % 5 = 1 THEN '' ELSE concat('status ', o_orderstatus) END AS body
FROM """

COMMITS_SQL = f"commits AS ({_COMMITS} orders)"


def commits(spark: SparkSession, folder: str) -> DataFrame:
    return run_sql(spark, _COMMITS, table(spark, folder, "orders"))


_RELEASES = """
SELECT concat('repo', CAST(o_custkey % 40 AS VARCHAR)) AS repo, o_orderkey AS seq,
  concat(CASE WHEN o_orderkey % 19 = 0 THEN 'old-' ELSE 'v' END,
    CAST(o_orderkey % 3 AS VARCHAR), '.', CAST(o_orderkey % 23 AS VARCHAR), '.',
    CAST(o_orderkey % 7 AS VARCHAR),
    CASE WHEN o_orderkey % 4 = 0 THEN concat('-rc.', CAST(o_orderkey % 15 AS VARCHAR)) ELSE '' END) AS tag,
  CASE WHEN o_orderkey % 5 <> 2 THEN o_orderkey % 97 = 0 END AS points_at_head
FROM """

# The numbers of a tag, its place among tag names and among versions.
RELEASES_SQL = rf"""releases AS (
  SELECT *, n1 * 1000000000 + n2 * 1000000 + n3 * 1000 + CASE WHEN rc IS NULL THEN 0 ELSE 100 + rc END AS name_rank,
         n1 * 1000000000 + n2 * 1000000 + n3 * 1000 + coalesce(rc, 900) AS version_rank
  FROM (SELECT *, CAST(regexp_extract(tag, '([0-9]+)\.', 1) AS BIGINT) AS n1,
               CAST(regexp_extract(tag, '\.([0-9]+)\.', 1) AS BIGINT) AS n2,
               CAST(regexp_extract(tag, '\.[0-9]+\.([0-9]+)', 1) AS BIGINT) AS n3,
               CAST(nullif(regexp_extract(tag, 'rc\.([0-9]+)', 1), '') AS BIGINT) AS rc
        FROM ({_RELEASES} orders) r) s)"""
TAGS_SQL = f"""{RELEASES_SQL}, tags AS (
  SELECT repo, tag, bool_or(points_at_head) AS points_at_head, max(name_rank) AS name_rank,
         max(version_rank) AS version_rank FROM releases GROUP BY repo, tag)"""


def releases(spark: SparkSession, folder: str) -> DataFrame:
    return run_sql(spark, _RELEASES, table(spark, folder, "orders"))


def tags(spark: SparkSession, folder: str) -> DataFrame:
    rows = releases(spark, folder)
    return rows.groupBy("repo", "tag").agg(F.bool_or("points_at_head").alias("points_at_head"))


_BUMPS = """
SELECT o_orderkey AS row_id,
  CASE WHEN o_orderkey % 29 = 0 THEN '0.0.0' WHEN o_orderkey % 31 = 0 THEN 'x.1'
    ELSE concat(CAST(o_orderkey % 5 AS VARCHAR), '.', CAST(o_orderkey * 3 % 1000 AS VARCHAR), '.',
                CAST(999 - o_orderkey % 400 AS VARCHAR)) END AS current_version,
  CASE o_orderkey % 3 WHEN 0 THEN 'patch' WHEN 1 THEN 'minor' ELSE 'major' END AS bump,
  o_custkey * 37 % 3000 AS loc, o_custkey % 60 AS bonus
FROM """

BUMPS_SQL = f"bumps AS ({_BUMPS} orders)"


def bumps(spark: SparkSession, folder: str) -> DataFrame:
    return run_sql(spark, _BUMPS, table(spark, folder, "orders"))


_RANGES = """
SELECT DISTINCT concat('r', CAST(o_orderkey % 210 AS VARCHAR)) AS range_id,
  CASE o_orderkey % 210 % 4 WHEN 0 THEN '1.2.3' WHEN 1 THEN CAST(NULL AS VARCHAR)
    WHEN 2 THEN '0.9.999' ELSE 'bad' END AS current_version
FROM """

RANGES_SQL = f"ranges AS ({_RANGES} orders)"


def ranges(spark: SparkSession, folder: str) -> DataFrame:
    return run_sql(spark, _RANGES, table(spark, folder, "orders"))
