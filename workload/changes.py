"""Queries on file changes, diff lines, commits and command-line options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsift import sinks
from logsift.functions import keywords as kw
from logsift.functions import paths as pt
from logsift.functions.values import int_or_default, int_or_zero, kv_map
from logsift.operators import changes as ch
from logsift.operators import cli_options as co
from logsift.operators import commits as cm
from logsift.plans import release
from logsift.sources import git_text as gt
from logsift.sources.weights import weight_struct
from workload import derived as dv

# --- the same steps in SQL -----------------------------------------------------


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(text: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {_q(p)})" for p in patterns) + ")"


def _count_if(condition: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {condition}) AS {name}"


_FOLD = r"regexp_replace({}, '[^\x00-\x7F]', chr(26), 'g')"
_CLASS = f"""CASE WHEN {_has("path", pt.IGNORED_DIRS, pt.IGNORED_ENDS)} THEN 0
  WHEN {_has("path", pt.TEST_DIRS, pt.TEST_ENDS)} THEN 10
  WHEN {_has("path", pt.SOURCE_DIRS, pt.SOURCE_ENDS, pt.SOURCE_NAMES)} THEN 30
  WHEN {_has("lower(path)", pt.DOC_DIRS, pt.DOC_NAMES, pt.DOC_ENDS)} THEN 20 ELSE 0 END"""

_FILE_NAMES = (
    "added_files",
    "modified_files",
    "deleted_files",
    "new_source_files",
    "new_test_files",
    "new_doc_files",
    "insertions",
    "deletions",
    "diff_size",
)
_SUMMARY = f"""summary AS (SELECT *, insertions + deletions AS diff_size FROM (SELECT range_id,
  {_count_if("status = 'A'", "added_files")}, {_count_if("status NOT IN ('A', 'D')", "modified_files")},
  {_count_if("status = 'D'", "deleted_files")},
  {_count_if("status = 'A' AND class = 30", "new_source_files")},
  {_count_if("status = 'A' AND class = 10", "new_test_files")},
  {_count_if("status = 'A' AND class = 20", "new_doc_files")},
  CAST(coalesce(sum(try_cast(ins_txt AS BIGINT)), 0) AS BIGINT) AS insertions,
  CAST(coalesce(sum(try_cast(del_txt AS BIGINT)), 0) AS BIGINT) AS deletions
  FROM (SELECT *, {_CLASS} AS class FROM files) f GROUP BY range_id) s)"""

_MESSAGES = """messages AS (SELECT range_id, unnest(string_split(concat(subject, {}, body), chr(10))) AS text
  FROM commits)"""


def _keywords() -> str:
    code = ", ".join(
        _count_if(f"regexp_matches(line, {_q('(?is)' + kw.COMMENT_START + p)})", n)
        for n, p in kw.COMMENT_WORDS.items()
    )
    said = ", ".join(
        _count_if(f"regexp_matches(line, {_q('(?is)' + p)})", n) for n, p in kw.MESSAGE_WORDS.items()
    )
    names = [*kw.COMMENT_WORDS, *kw.MESSAGE_WORDS]
    return f"""{dv.DIFF_SQL}, {dv.COMMITS_SQL}, {_MESSAGES.format("' '")},
    in_code AS (SELECT range_id, {code} FROM (SELECT range_id, {_FOLD.format("concat(sign, text)")} AS line FROM diff
                WHERE sign IN ('+', '-')) c GROUP BY range_id),
    in_messages AS (SELECT range_id, {said} FROM (SELECT range_id, {_FOLD.format("text")} AS line FROM messages) m
                    GROUP BY range_id),
    counts AS (SELECT range_id, {", ".join(f"coalesce({n}, 0) AS {n}" for n in names)}
               FROM in_code FULL JOIN in_messages USING (range_id)),
    keywords AS (SELECT *, total_cli_breaking > 0 AS has_cli_breaking, total_api_breaking > 0 AS has_api_breaking,
      total_general_breaking > 0 AS has_general_breaking, total_new_features > 0 AS has_new_features,
      total_security > 0 AS has_security, removed_options_keywords > 0 AS has_removed_options,
      added_options_keywords > 0 AS has_added_options
      FROM (SELECT *, cli_breaking_keywords + commit_cli_breaking AS total_cli_breaking,
        api_breaking_keywords + commit_api_breaking AS total_api_breaking,
        commit_general_breaking AS total_general_breaking,
        new_feature_keywords + commit_new_feature AS total_new_features,
        security_keywords + commit_security AS total_security FROM counts) t)"""


def _occurrences(text: str, words: str) -> str:
    return f"CAST(sum(len(regexp_extract_all({text}, {_q('(?i)' + words)}))) AS BIGINT)"


_SECURITY_DIFF = {
    "security_patterns": kw.SECURITY_WORDS,
    "cve_patterns": kw.CVE_WORDS,
    "memory_safety_issues": kw.MEMORY_WORDS,
    "crash_fixes": kw.CRASH_WORDS,
}


def _security(added_only: bool) -> str:
    code = "text" if added_only else "concat(sign, text)"
    where = "WHERE sign = '+' AND text <> '' AND NOT starts_with(text, '+')" if added_only else ""
    found = ", ".join(f"{_occurrences('line', p)} AS {n}" for n, p in _SECURITY_DIFF.items())
    shown = ", ".join(f"coalesce({n}, 0) AS {n}" for n in ("security_keywords", *_SECURITY_DIFF))
    return f"""sec_messages AS (SELECT range_id, unnest(string_split(concat(subject, chr(10), body), chr(10))) AS text
      FROM commits),
    sec_code AS (SELECT range_id, {found} FROM (SELECT range_id, {_FOLD.format(code)} AS line FROM diff {where}) c
      GROUP BY range_id),
    sec_said AS (SELECT range_id, {_occurrences("line", kw.SECURITY_WORDS)} AS security_keywords
      FROM (SELECT range_id, {_FOLD.format("text")} AS line FROM sec_messages) m GROUP BY range_id),
    security AS (SELECT range_id, {shown} FROM sec_code FULL JOIN sec_said USING (range_id))"""


_SCORE = """SELECT *, CASE WHEN total_security_score >= 15 THEN 'high' WHEN total_security_score >= 5 THEN 'medium'
  WHEN total_security_score >= 1 THEN 'low' ELSE 'none' END AS risk
  FROM (SELECT *, security_keywords + security_patterns + 3 * cve_patterns + 2 * memory_safety_issues + crash_fixes
        AS total_security_score FROM security) s"""

_NO_SPACE = r"regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g')"
_C_FILES = r"regexp_matches(path, '\.(c|cc|cpp|cxx|h|hh|hpp)\z')"

# State of the option table at every line: inside after the last opening line
# unless a closing line is at or behind it.
_LONG_NAMES = f"""
  stated AS (SELECT *,
    max(CASE WHEN {_has("text", co.TABLE_OPENS)} THEN line_no END) OVER w AS opened,
    max(CASE WHEN {_has("text", co.TABLE_CLOSES)} THEN line_no END) OVER w AS closed
    FROM picked_sources WINDOW w AS (PARTITION BY range_id, side, path ORDER BY line_no)),
  named AS (SELECT range_id, side, unnest([nullif(regexp_extract(text, {_q(co.BRACED_NAME)}, 1), ''),
    nullif(regexp_extract(text, {_q(co.DOTTED_NAME)}, 1), '')]) AS names
    FROM stated WHERE opened IS NOT NULL AND (closed IS NULL OR opened > closed)),
  long_names AS (SELECT DISTINCT range_id, side, option FROM (
    SELECT range_id, side, unnest(string_split(names, ',')) AS option FROM named WHERE names IS NOT NULL) n
    WHERE option <> '')"""
_SHORT = f"""
  strings AS (SELECT DISTINCT range_id, side, path, optstring FROM (
    SELECT range_id, side, path, unnest(regexp_extract_all(text, {_q(co.QUOTED)}, 1)) AS optstring
    FROM picked_sources WHERE {_has("text", co.GETOPT_CALL)}) q),
  short_names AS (SELECT DISTINCT range_id, side, option FROM (
    SELECT range_id, side, unnest(string_split(replace(optstring, ':', ''), '')) AS option FROM strings) s
    WHERE option <> '')"""


def _one_side(source: str, kind: str) -> str:
    return f"""SELECT range_id, '{kind}' AS kind, option, CASE WHEN bool_or(side = 'before') THEN 'removed' ELSE 'added' END AS change
      FROM {source} GROUP BY range_id, option HAVING count(DISTINCT side) = 1"""


_MANUAL = f"""manual AS (SELECT DISTINCT range_id, sign, kind, option FROM (
  SELECT range_id, sign, 'long' AS kind, concat('--', nullif(regexp_extract(line, {_q(co.LONG_NAME)}, 1), '')) AS option
    FROM changed WHERE NOT {_has("line", "(?s)" + co.QUOTED_DASHES)} AND {_has("line", co.LONG_NAME)}
  UNION ALL SELECT range_id, sign, 'case', regexp_extract(line, {_q(co.CASE_LABEL)}, 1)
    FROM changed WHERE {_has("line", co.CASE_LABEL)}) m)"""
_CHANGED = f"""changed AS (SELECT * FROM (SELECT range_id, sign, concat(sign, text) AS line FROM picked_diff
  WHERE sign IN ('+', '-')) c WHERE NOT {_has("line", co.COMMENT_LINE)})"""
_PATTERNS = f"""patterns AS (SELECT range_id,
  {", ".join(_count_if(_has("line", p), n) for n, p in co.DIFF_PATTERNS.items())},
  {" + ".join(f"CAST(bool_or({_has('line', p)}) AS BIGINT)" for p in co.PATTERN_KINDS.values())} AS enhanced_cli_patterns,
  {_count_if(f'{_has("line", co.PROTOTYPE)} AND NOT {_has("line", co.NO_PROTOTYPE)}', "removed_prototypes")}
  FROM (SELECT range_id, {_FOLD.format("concat(sign, text)")} AS line FROM picked_diff
    WHERE sign IN ('+', '-')) p GROUP BY range_id)"""


def _per_side(source: str, option: str, name: str) -> str:
    return f"""{name}_sides AS (SELECT range_id,
      {_count_if("b", f"{name}_before")}, {_count_if("a", f"{name}_after")},
      {_count_if("b AND NOT a", f"{name}_removed")}, {_count_if("a AND NOT b", f"{name}_added")}
      FROM (SELECT range_id, {option} AS o, bool_or(side = 'before') AS b, bool_or(side = 'after') AS a
            FROM {source} GROUP BY ALL) s GROUP BY range_id)"""


def _options(filtered: bool) -> str:
    where = f"WHERE {_C_FILES}" if filtered else ""
    names = [f"{n}_{k}" for n in ("short", "long", "text") for k in ("before", "after", "removed", "added")]
    names += ["manual_added_long_count", "manual_removed_long_count", "missing_cases"]
    names += [*co.DIFF_PATTERNS, "enhanced_cli_patterns", "removed_prototypes"]
    hints = " + ".join([*co.DIFF_PATTERNS, "enhanced_cli_patterns"])
    return f"""picked_sources AS (SELECT * FROM sources {where}), picked_diff AS (SELECT * FROM diff {where}),
    {_LONG_NAMES}, {_SHORT}, {_CHANGED}, {_MANUAL}, {_PATTERNS},
    {_per_side("short_names", "option", "short")}, {_per_side("long_names", "option", "long")},
    {_per_side("strings", "(path, optstring)", "text")},
    manual_counts AS (SELECT range_id, {_count_if("kind = 'long' AND plus", "manual_added_long_count")},
      {_count_if("kind = 'long' AND minus", "manual_removed_long_count")},
      {_count_if("kind = 'case' AND minus AND NOT plus", "missing_cases")}
      FROM (SELECT range_id, kind, option, bool_or(sign = '+') AS plus, bool_or(sign = '-') AS minus
            FROM manual GROUP BY ALL) m GROUP BY range_id),
    joined AS (SELECT range_id, {", ".join(f"coalesce({n}, 0) AS {n}" for n in names)}
      FROM short_sides FULL JOIN long_sides USING (range_id) FULL JOIN text_sides USING (range_id)
      FULL JOIN manual_counts USING (range_id) FULL JOIN patterns USING (range_id)),
    options AS (SELECT range_id, short_changed OR long_changed AS cli_changes,
      missing_cases > 0 OR (short_changed AND short_removed > 0) OR (long_changed AND long_removed > 0) AS breaking_cli_changes,
      removed_prototypes > 0 AS api_breaking,
      manual_added_long_count + manual_removed_long_count + {hints} > 0 AS manual_cli_changes,
      manual_added_long_count, manual_removed_long_count,
      short_removed + CAST(short_before = 0 AND short_after > 0 AS BIGINT) AS removed_short_count,
      short_added + CAST(short_after = 0 AND short_before > 0 AS BIGINT) AS added_short_count,
      long_removed + CAST(long_before = 0 AND long_after > 0 AS BIGINT) AS removed_long_count,
      long_added + CAST(long_after = 0 AND long_before > 0 AS BIGINT) AS added_long_count,
      {", ".join(co.DIFF_PATTERNS)}, enhanced_cli_patterns
      FROM (SELECT *, short_after > 0 AND text_removed + text_added > 0 AS short_changed,
            long_after > 0 AND long_removed + long_added > 0 AS long_changed FROM joined) j)"""


# --- queries -------------------------------------------------------------------


def path_classes(spark: SparkSession, folder: str) -> DataFrame:
    paths = dv.file_changes(spark, folder).select("path").distinct()
    return paths.select("path", pt.path_class(F.col("path")).alias("class"))


def path_globs(spark: SparkSession, folder: str) -> DataFrame:
    files = dv.file_changes(spark, folder)
    chosen = ch.select_paths(files, "src, core/*.c, !*/test/*,[DR]*", exclude="src/f1*")
    return chosen.groupBy("path").agg(F.count("*").alias("n_changes"))


def c_family_paths(spark: SparkSession, folder: str) -> DataFrame:
    files = ch.select_paths(dv.file_changes(spark, folder), pt.C_FAMILY_GLOBS)
    return files.select("path").distinct()


def file_change_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ch.file_change_summary(dv.file_changes(spark, folder))


def keyword_lines(spark: SparkSession, folder: str) -> DataFrame:
    counts = ch.keyword_counts(dv.diff_lines(spark, folder), dv.commits(spark, folder))
    return counts.select("range_id", *kw.COMMENT_WORDS, *kw.MESSAGE_WORDS)


def keyword_flags(spark: SparkSession, folder: str) -> DataFrame:
    return ch.keyword_counts(dv.diff_lines(spark, folder), dv.commits(spark, folder))


def keyword_lines_added(spark: SparkSession, folder: str) -> DataFrame:
    lines = ch.added_lines(dv.diff_lines(spark, folder))
    counts = ch.keyword_counts(lines, ch.without_merges(dv.commits(spark, folder)))
    return counts.select("range_id", *kw.COMMENT_WORDS, *kw.MESSAGE_WORDS)


def security_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return ch.security_counts(dv.diff_lines(spark, folder), dv.commits(spark, folder))


def security_score(spark: SparkSession, folder: str) -> DataFrame:
    counts = ch.security_counts(dv.diff_lines(spark, folder), dv.commits(spark, folder), added_only=True)
    return ch.security_score(counts)


def security_in_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = dv.table(spark, folder, "pages")
    lines = pages.select("page_id", F.explode(F.split("html", "<")).alias("text"))
    folded = lines.select("page_id", F.regexp_replace("text", r"[^\x00-\x7F]", "\x1a").alias("line"))
    words = {"security_patterns": kw.SECURITY_WORDS, "crash_fixes": kw.CRASH_WORDS}
    return folded.groupBy("page_id").agg(
        *[F.sum(kw.occurrences(F.col("line"), w)).alias(n) for n, w in words.items()]
    )


def top_security_texts(spark: SparkSession, folder: str) -> DataFrame:
    return cm.top_security_subjects(ch.without_merges(dv.commits(spark, folder)), top=3)


def whitespace_only_changes(spark: SparkSession, folder: str) -> DataFrame:
    return ch.space_only_changes(dv.diff_lines(spark, folder))


def without_whitespace_changes(spark: SparkSession, folder: str) -> DataFrame:
    return ch.without_space_changes(dv.diff_hunks(spark, folder)).select("range_id", "path", "line_no", "sign")


def option_changes(spark: SparkSession, folder: str) -> DataFrame:
    return co.option_changes(dv.option_sources(spark, folder))


def diff_options(spark: SparkSession, folder: str) -> DataFrame:
    return co.diff_options(dv.diff_lines(spark, folder))


def diff_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return co.diff_patterns(dv.diff_lines(spark, folder))


def option_summary(spark: SparkSession, folder: str) -> DataFrame:
    return co.option_summary(dv.option_sources(spark, folder), dv.diff_lines(spark, folder))


def short_option_lists(spark: SparkSession, folder: str) -> DataFrame:
    letters = co.short_options(co.optstrings(dv.option_sources(spark, folder)))
    # Distinct characters: the list cannot outgrow the alphabet.
    return letters.groupBy("range_id", "side").agg(
        F.array_join(F.array_sort(F.collect_set("option")), "").alias("letters")
    )


def commit_counts(spark: SparkSession, folder: str) -> DataFrame:
    return cm.commit_counts(dv.ranges(spark, folder), dv.commits(spark, folder))


def diff_from_text(spark: SparkSession, folder: str) -> DataFrame:
    """The diff printed as git does, a log for each range, and read back.

    The hunks of a file follow one another; a hunk is a line of each side or a context line.
    """
    diff = dv.diff_hunks(spark, folder).filter(F.col("path").isNotNull() & F.col("text").isNotNull())
    count = lambda *signs: F.count_if(F.col("sign").isin(*signs)).cast("string")
    lines = F.sort_array(F.collect_list(F.struct("line_no", F.concat("sign", "text").alias("line"))))
    hunks = diff.groupBy("range_id", "path", "hunk").agg(
        F.concat(F.lit("@@ -1,"), count("-", " "), F.lit(" +1,"), count("+", " "), F.lit(" @@")).alias("head"), lines.alias("lines")
    )
    printed = hunks.select(
        "range_id",
        F.posexplode(
            F.concat(
                F.array(
                    F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path"),
                    F.concat(F.lit("--- a/"), "path"),
                    F.concat(F.lit("+++ b/"), "path"),
                    "head",
                ),
                F.col("lines.line"),
            )
        ).alias("k", "value"),
        "path",
        "hunk",
    )
    # Line numbers with gaps: hunks in the order of their texts' first lines, by path.
    place = F.dense_rank().over(W.partitionBy("range_id").orderBy("path", "hunk")).cast("long") * 16 + F.col("k")
    text = printed.select(F.col("range_id").alias("log_id"), place.alias("line_no"), "value")
    return gt.diff_rows(text).groupBy("range_id", "path", "sign", "text").agg(F.count("*").alias("n_lines"))


_ASKED = """
SELECT DISTINCT concat('r', CAST(o_orderkey % 210 AS VARCHAR)) AS range_id,
  concat('repo', CAST(o_orderkey % 210 % 43 AS VARCHAR)) AS repo,
  DATE '1991-12-01' + CAST(o_orderkey % 210 * 13 AS INT) AS day
FROM """


def base_by_range(spark: SparkSession, folder: str) -> DataFrame:
    """A base commit for every range and its day; some repos have no commits, some days come before all."""
    asked = dv.run_sql(spark, _ASKED, dv.table(spark, folder, "orders"))
    return cm.base_by_range(asked, dv.commits(spark, folder))


def base_by_date(spark: SparkSession, folder: str) -> DataFrame:
    return cm.base_by_day(dv.commits(spark, folder), "1995-02-10")


def _metrics(spark: SparkSession, folder: str, lines: DataFrame | None = None, **more) -> DataFrame:
    return release.range_metrics(
        dv.ranges(spark, folder),
        dv.file_changes(spark, folder),
        dv.diff_lines(spark, folder) if lines is None else lines,
        dv.commits(spark, folder),
        dv.option_sources(spark, folder),
        **more,
    )


def bonus_suggestion(spark: SparkSession, folder: str) -> DataFrame:
    return release.suggest_releases(_metrics(spark, folder))


def bonus_suggestion_no_space(spark: SparkSession, folder: str) -> DataFrame:
    metrics = _metrics(spark, folder, ignore_space=True, no_merges=True, lines=dv.diff_hunks(spark, folder))
    return release.suggest_releases(metrics).select("range_id", "total_bonus", "suggestion")


def release_json(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.release_json(bonus_suggestion(spark, folder))


def security_json(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.security_json(security_score(spark, folder))


def bonus_suggestion_weighted(spark: SparkSession, folder: str) -> DataFrame:
    # Weights from a given table: the smallest size per part type, by rule.
    part = dv.table(spark, folder, "part")
    rule = (
        F.when(F.col("p_partkey") % 3 == 0, "security_vuln")
        .when(F.col("p_partkey") % 3 == 1, "cli_breaking")
        .otherwise("api_breaking")
    )
    category = F.when(rule == "security_vuln", "security_stability").otherwise("breaking_changes")
    weights = part.select(category.alias("category"), rule.alias("rule"), (F.col("p_size") / 10).alias("weight"))
    suggested = release.suggest_releases(_metrics(spark, folder), weight_struct(weights))
    return suggested.select("range_id", "total_bonus", "suggestion")


def report_json(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.to_json_rows(file_change_summary(spark, folder))


def report_kv(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.to_kv_rows(file_change_summary(spark, folder))


def kv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    orders = dv.table(spark, folder, "orders")
    text = F.concat(
        F.lit("STATUS="), F.col("o_orderstatus"), F.lit("\nno pair\nNOTE=a=b="), F.col("o_orderpriority"), F.lit("\n")
    )
    pairs = orders.select("o_orderkey", kv_map(text).alias("kv"))
    return pairs.select("o_orderkey", F.explode("kv").alias("name", "value"))


def whole_numbers(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("o_orderpriority")
    orders = dv.table(spark, folder, "orders").withColumn(
        "digits", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).otherwise(text)
    )
    return orders.select(
        "o_orderkey", int_or_default(F.col("digits"), 7).alias("or_default"), int_or_zero(F.col("digits")).alias("or_zero")
    )


QUERIES = {
    "path_classes": path_classes,
    "path_globs": path_globs,
    "c_family_paths": c_family_paths,
    "file_change_summary": file_change_summary,
    "keyword_lines": keyword_lines,
    "keyword_flags": keyword_flags,
    "keyword_lines_added": keyword_lines_added,
    "security_occurrences": security_occurrences,
    "security_score": security_score,
    "security_in_pages": security_in_pages,
    "top_security_texts": top_security_texts,
    "whitespace_only_changes": whitespace_only_changes,
    "without_whitespace_changes": without_whitespace_changes,
    "option_changes": option_changes,
    "diff_options": diff_options,
    "diff_patterns": diff_patterns,
    "option_summary": option_summary,
    "short_option_lists": short_option_lists,
    "commit_counts": commit_counts,
    "base_by_date": base_by_date,
    "base_by_range": base_by_range,
    "diff_from_text": diff_from_text,
    "bonus_suggestion": bonus_suggestion,
    "bonus_suggestion_weighted": bonus_suggestion_weighted,
    "bonus_suggestion_no_space": bonus_suggestion_no_space,
    "release_json": release_json,
    "security_json": security_json,
    "report_json": report_json,
    "report_kv": report_kv,
    "kv_round_trip": kv_round_trip,
    "whole_numbers": whole_numbers,
}


def _bonus(weights: str) -> str:
    metrics = ("new_source_files", "new_test_files", "new_doc_files", "diff_size", "removed_short_count",
               "removed_long_count", "manual_added_long_count", "manual_removed_long_count",
               "removed_options_keywords", "total_security", "security_words")
    flags = ("cli_changes", "breaking_cli_changes", "api_breaking", "manual_cli_changes", "has_cli_breaking",
             "has_api_breaking", "has_general_breaking")
    shown = [f"coalesce({n}, 0) AS {n}" for n in metrics] + [f"coalesce({n}, false) AS {n}" for n in flags]
    return f"""WITH {dv.RANGES_SQL}, {dv.FILES_SQL}, {_SUMMARY}, {_keywords()}, {dv.SOURCES_SQL.removeprefix(dv.DOC_LINES_SQL + ", ")},
    {_options(True)}, {_security(False)},
    metrics AS (SELECT range_id, coalesce(current_version, '0.0.0') AS current_version, {", ".join(shown)}
      FROM ranges LEFT JOIN summary USING (range_id) LEFT JOIN options USING (range_id)
      LEFT JOIN keywords USING (range_id)
      LEFT JOIN (SELECT range_id, security_keywords AS security_words FROM security) s USING (range_id)),
    w AS ({weights}),
    scored AS (SELECT m.*, CAST(CASE WHEN has_cli_breaking OR breaking_cli_changes THEN cli ELSE 0 END
      + CASE WHEN has_api_breaking OR api_breaking THEN api ELSE 0 END
      + CASE WHEN has_general_breaking THEN api ELSE 0 END + (security_words + total_security) * sec
      + CASE WHEN cli_changes THEN 2 ELSE 0 END + CAST(manual_cli_changes AS INT)
      + CAST(new_source_files > 0 AS INT) + CAST(new_test_files > 0 AS INT) + CAST(new_doc_files > 0 AS INT)
      + CAST(removed_short_count + removed_long_count + manual_removed_long_count + removed_options_keywords > 0 AS INT)
      AS BIGINT) AS total_bonus FROM metrics m, w),
    suggested AS (SELECT *, CASE WHEN NOT regexp_matches(current_version, '^[0-9]+\\.[0-9]+\\.[0-9]+$') THEN 'none'
      WHEN total_bonus >= 8 THEN 'major' WHEN total_bonus >= 4 THEN 'minor' WHEN total_bonus > 0 THEN 'patch'
      ELSE 'none' END AS suggestion FROM scored),
    parts AS (SELECT *, CASE suggestion WHEN 'patch' THEN 1 + (diff_size + 125) // 250
        WHEN 'minor' THEN 5 + (diff_size + 50) // 100 ELSE 10 + (diff_size + 50) // 100 END
      + total_bonus + CASE suggestion WHEN 'patch' THEN (total_bonus * diff_size + 125) // 250
        WHEN 'minor' THEN (total_bonus * diff_size + 250) // 500 ELSE (total_bonus * diff_size + 500) // 1000 END
      + coalesce(try_cast(split_part(current_version, '.', 3) AS BIGINT), 0) AS z,
      coalesce(try_cast(split_part(current_version, '.', 1) AS BIGINT), 0) AS x,
      coalesce(try_cast(split_part(current_version, '.', 2) AS BIGINT), 0) AS y FROM suggested)"""


_DEFAULT = "SELECT 2 AS cli, 3 AS api, 2 AS sec"
_FROM_PARTS = """SELECT coalesce(max(CAST(w AS BIGINT)) FILTER (WHERE k = 1), 2) AS cli,
  coalesce(max(CAST(w AS BIGINT)) FILTER (WHERE k = 2), 3) AS api,
  coalesce(max(CAST(w AS BIGINT)) FILTER (WHERE k = 0), 2) AS sec
  FROM (SELECT p_partkey % 3 AS k, p_size / 10 AS w FROM part) p WHERE w = floor(w)"""

_KEYWORD_LIST = ", ".join([*kw.COMMENT_WORDS, *kw.MESSAGE_WORDS])

ORACLE = {
    "path_classes": f"WITH {dv.FILES_SQL} SELECT DISTINCT path, {_CLASS} AS class FROM files",
    "path_globs": r"""WITH """ + dv.FILES_SQL + r""" SELECT path, count(*) AS n_changes FROM files
      WHERE regexp_matches(path, '^(src(/.*)?|core/.*\.c|[DR].*)$') AND NOT regexp_matches(path, '^.*/test/.*$')
      AND NOT regexp_matches(path, '^src/f1.*$') GROUP BY path""",
    "c_family_paths": f"WITH {dv.FILES_SQL} SELECT DISTINCT path FROM files WHERE {_C_FILES}",
    "file_change_summary": f"WITH {dv.FILES_SQL}, {_SUMMARY} SELECT * FROM summary",
    "keyword_lines": f"WITH {_keywords()} SELECT range_id, {_KEYWORD_LIST} FROM keywords",
    "keyword_flags": f"WITH {_keywords()} SELECT * FROM keywords",
    "keyword_lines_added": "WITH "
    + _keywords()
    .replace("WHERE sign IN ('+', '-')) c", "WHERE sign = '+' AND NOT starts_with(text, '++')) c")
    .replace("FROM commits)", "FROM commits WHERE is_merge IS NOT TRUE)")
    + f" SELECT range_id, {_KEYWORD_LIST} FROM keywords",
    "security_occurrences": f"WITH {dv.DIFF_SQL}, {dv.COMMITS_SQL}, {_security(False)} SELECT * FROM security",
    "security_score": f"WITH {dv.DIFF_SQL}, {dv.COMMITS_SQL}, {_security(True)} {_SCORE}",
    "security_in_pages": f"""SELECT page_id, {_occurrences("line", kw.SECURITY_WORDS)} AS security_patterns,
      {_occurrences("line", kw.CRASH_WORDS)} AS crash_fixes
      FROM (SELECT page_id, {_FOLD.format("text")} AS line FROM (
        SELECT page_id, unnest(string_split(html, '<')) AS text FROM pages) t) l GROUP BY page_id""",
    "top_security_texts": f"""WITH {dv.COMMITS_SQL}, hits AS (SELECT *, row_number() OVER (PARTITION BY range_id
        ORDER BY committed_at DESC, commit_id DESC) AS place FROM commits
        WHERE is_merge IS NOT TRUE AND regexp_matches({_FOLD.format("subject")}, {_q("(?i)" + kw.SECURITY_WORDS)}))
      SELECT range_id, CAST(place AS INT) AS place, commit_id, subject FROM hits WHERE place <= 3""",
    "whitespace_only_changes": f"""WITH {dv.DIFF_SQL}, texts AS (SELECT range_id,
        {_count_if("sign = '+'", "p")}, {_count_if("sign = '-'", "m")}
        FROM (SELECT *, {_NO_SPACE} AS bare FROM diff WHERE sign IN ('+', '-')) d GROUP BY range_id, path, bare)
      SELECT range_id, CAST(sum(p) AS BIGINT) AS added_lines, CAST(sum(m) AS BIGINT) AS removed_lines,
        CAST(sum(least(p, m)) AS BIGINT) AS space_only_pairs, CAST(sum(p - least(p, m)) AS BIGINT) AS added_kept,
        CAST(sum(m - least(p, m)) AS BIGINT) AS removed_kept FROM texts GROUP BY range_id""",
    "without_whitespace_changes": f"""WITH {dv.DIFF_SQL}, told AS (SELECT *, sign IN ('+', '-') AS signed,
          {dv.HUNK_SQL} AS hunk FROM (SELECT *, {_NO_SPACE} AS bare FROM diff) d)
      SELECT range_id, path, line_no, sign FROM (SELECT *, count(*) OVER (
        PARTITION BY range_id, path, hunk, bare, signed) AS alike FROM told) t WHERE NOT signed OR alike = 1""",
    "diff_from_text": f"""WITH {dv.DIFF_SQL} SELECT range_id, path, sign, text, count(*) AS n_lines FROM diff
      WHERE path IS NOT NULL AND text IS NOT NULL GROUP BY range_id, path, sign, text""",
    "base_by_range": f"""WITH {dv.COMMITS_SQL}, asked AS ({_ASKED} orders)
      SELECT asked.range_id, coalesce(arg_max(commit_id, (committed_at, commit_id)) FILTER (WHERE committed_at < day + 1),
        arg_min(commit_id, (committed_at, commit_id))) AS base_commit,
        CASE WHEN bool_or(committed_at < day + 1) THEN 'date' WHEN count(commit_id) > 0 THEN 'first' ELSE 'none' END AS ref_type
      FROM asked LEFT JOIN commits USING (repo) GROUP BY asked.range_id""",
    "option_changes": f"""WITH {dv.SOURCES_SQL}, picked_sources AS (SELECT * FROM sources), {_LONG_NAMES}, {_SHORT}
      {_one_side("short_names", "short")} UNION ALL {_one_side("long_names", "long")}""",
    "diff_options": f"""WITH {dv.DIFF_SQL}, picked_diff AS (SELECT * FROM diff), {_CHANGED}, {_MANUAL}
      SELECT range_id, kind, sign, option FROM manual""",
    "diff_patterns": f"WITH {dv.DIFF_SQL}, picked_diff AS (SELECT * FROM diff), {_PATTERNS} SELECT * FROM patterns",
    "option_summary": f"""WITH {dv.DIFF_SQL}, {dv.SOURCES_SQL.removeprefix(dv.DOC_LINES_SQL + ", ")}, {_options(False)}
      SELECT * FROM options""",
    "short_option_lists": f"""WITH {dv.SOURCES_SQL}, picked_sources AS (SELECT * FROM sources), {_SHORT}
      SELECT range_id, side, string_agg(option, '' ORDER BY option) AS letters FROM short_names GROUP BY range_id, side""",
    "commit_counts": f"""WITH {dv.RANGES_SQL}, {dv.COMMITS_SQL} SELECT range_id, count(commit_id) AS commit_count,
      count(commit_id) > 0 AS has_commits FROM (SELECT DISTINCT range_id FROM ranges) r
      LEFT JOIN commits USING (range_id) GROUP BY range_id""",
    "base_by_date": f"""WITH {dv.COMMITS_SQL}, days AS (SELECT *, CAST(committed_at AS DATE) <= DATE '1995-02-10' AS until
        FROM commits)
      SELECT repo, coalesce(arg_max(commit_id, (committed_at, commit_id)) FILTER (WHERE until),
        arg_min(commit_id, (committed_at, commit_id))) AS base_commit,
        CASE WHEN bool_or(until) THEN 'date' ELSE 'first' END AS ref_type FROM days GROUP BY repo""",
    "bonus_suggestion": _bonus(_DEFAULT)
    + """ SELECT range_id, CASE WHEN current_version = 'bad' THEN '0.0.0' ELSE current_version END AS current_version,
      total_bonus, suggestion,
      CASE WHEN suggestion = 'none' THEN NULL WHEN current_version = '0.0.0' THEN
        CASE suggestion WHEN 'major' THEN '1.0.0' WHEN 'minor' THEN '0.1.0' ELSE '0.0.1' END
      ELSE concat(CAST(x + (y + z // 1000) // 1000 AS VARCHAR), '.', CAST((y + z // 1000) % 1000 AS VARCHAR), '.',
        CAST(z % 1000 AS VARCHAR)) END AS next_version,
      diff_size, manual_cli_changes, manual_added_long_count, manual_removed_long_count,
      CASE WHEN current_version IN ('bad', '0.0.0') THEN 0 ELSE greatest(1, 1 + (diff_size + 125) // 250 + total_bonus
        + (total_bonus * diff_size + 125) // 250) END AS patch_delta,
      CASE WHEN current_version IN ('bad', '0.0.0') THEN 0 ELSE greatest(1, 5 + (diff_size + 50) // 100 + total_bonus
        + (total_bonus * diff_size + 250) // 500) END AS minor_delta,
      CASE WHEN current_version IN ('bad', '0.0.0') THEN 0 ELSE greatest(1, 10 + (diff_size + 50) // 100 + total_bonus
        + (total_bonus * diff_size + 500) // 1000) END AS major_delta FROM parts""",
    "bonus_suggestion_weighted": _bonus(_FROM_PARTS) + " SELECT range_id, total_bonus, suggestion FROM parts",
    "report_kv": f"""WITH {dv.FILES_SQL}, {_SUMMARY} SELECT range_id, upper(name) AS name, CAST(value AS VARCHAR) AS value
      FROM (UNPIVOT summary ON {", ".join(_FILE_NAMES)} INTO NAME name VALUE value) u""",
    "report_json": "WITH " + dv.FILES_SQL + ", " + _SUMMARY + " SELECT range_id, concat('{', "
    + ", ',', ".join(f"'\"{n}\":', CAST({n} AS VARCHAR)" for n in _FILE_NAMES)
    + ", '}') AS json FROM summary",
    "kv_round_trip": """SELECT o_orderkey, 'STATUS' AS name, o_orderstatus AS value FROM orders
      UNION ALL SELECT o_orderkey, 'NOTE', concat('a=b=', o_orderpriority) FROM orders""",
    "whole_numbers": """SELECT o_orderkey, coalesce(try_cast(digits AS BIGINT), 7) AS or_default,
      coalesce(try_cast(regexp_replace(digits, '[^0-9]', '', 'g') AS BIGINT), 0) AS or_zero
      FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END AS digits
            FROM orders) o""",
}

# Without lines that change white space only, as in without_whitespace_changes.
_KEPT_DIFF = f"""all_diff AS ({dv.DIFF_SQL.partition("diff AS (")[2]},
  diff AS (SELECT * EXCLUDE (bare, signed, hunk, alike) FROM (SELECT *,
      count(*) OVER (PARTITION BY range_id, path, hunk, bare, signed) AS alike
    FROM (SELECT *, {_NO_SPACE} AS bare, sign IN ('+', '-') AS signed, {dv.HUNK_SQL} AS hunk FROM all_diff) b) r
    WHERE NOT signed OR alike = 1)"""
_SHOWN = """concat('{"suggestion":"', suggestion, '","current_version":"', current_version, '"',
  CASE WHEN next_version IS NULL THEN '' ELSE concat(',"next_version":"', next_version, '"') END,
  ',"total_bonus":', total_bonus, ',"manual_cli_changes":', manual_cli_changes,
  ',"manual_added_long_count":', manual_added_long_count, ',"manual_removed_long_count":', manual_removed_long_count,
  ',"loc_delta":{"patch_delta":', patch_delta, ',"minor_delta":', minor_delta, ',"major_delta":', major_delta, '}}')"""
_SECURE = """concat('{"security_keywords":', security_keywords, ',"security_patterns":', security_patterns,
  ',"cve_patterns":', cve_patterns, ',"memory_safety_issues":', memory_safety_issues, ',"crash_fixes":', crash_fixes,
  ',"total_security_score":', total_security_score, ',"risk":"', risk,
  '","weights":{"commits":1,"diff_security":1,"cve":3,"memory":2,"crash":1}}')"""
ORACLE |= {
    "bonus_suggestion_no_space": ORACLE["bonus_suggestion_weighted"]
    .replace(_bonus(_FROM_PARTS), _bonus(_DEFAULT))
    .replace(dv.DIFF_SQL, dv.DIFF_SQL.partition("diff AS (")[0] + _KEPT_DIFF)
    .replace("FROM commits)", "FROM commits WHERE is_merge IS NOT TRUE)"),
    "release_json": f"SELECT range_id, {_SHOWN} AS json FROM ({ORACLE['bonus_suggestion']}) shown",
    "security_json": f"SELECT range_id, {_SECURE} AS json FROM ({ORACLE['security_score']}) shown",
}
