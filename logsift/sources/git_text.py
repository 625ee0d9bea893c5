"""Tables of changes from the text that git prints.

`diff_rows` reads unified diffs, `numstat_rows` and `name_status_rows` the two summaries,
`name_status_z_rows` the summary with NUL between fields, `log_rows` the log. Texts
come as lines (log_id, line_no, value), where log_id names the range; results
have the schemas in `schemas`.

What a line of a diff is depends on the lines before it: the last hunk header says how
many old and new lines follow, and only those are content. That state is a set of
running sums and maxima (`ordered.running`), so a diff of any length is read in
parallel. Names in quotes are decoded: git's backslash escapes, octal bytes as UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.ordered import running

# How git writes headers.
_HUNK = r"^@@ -[0-9]+(?:,([0-9]+))? \+[0-9]+(?:,([0-9]+))? @@"
_COMMIT = r"^commit ([0-9a-f]{7,64})(?: .*)?$"
_ESCAPES = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D", '"': "22", "\\": "5C"}


def unquoted(name: Column) -> Column:
    """A name as git quotes it, decoded; a name without quotes as it is."""
    inner = F.regexp_extract(name, r'(?s)^"(.*)"$', 1)
    tokens = F.regexp_extract_all(inner, F.lit(r"(?s)(\\[0-7]{3}|\\.|[^\\])"), 1)
    known = F.create_map(*(x for c, h in _ESCAPES.items() for x in (F.lit(c), F.lit(h))))

    def byte(token: Column) -> Column:
        octal = F.lpad(F.conv(F.substr(token, F.lit(2)), 8, 16), 2, "0")
        letter = F.try_element_at(known, F.substr(token, F.lit(2)))
        plain = F.hex(F.encode(token, "UTF-8"))
        return F.when(token.rlike(r"^\\[0-7]{3}$"), octal).when(token.startswith("\\"), letter).otherwise(plain)

    decoded = F.unhex(F.array_join(F.transform(tokens, byte), "")).cast("string")
    return F.when(name.startswith('"'), decoded).otherwise(name)


def _side(value: Column, letter: str) -> Column:
    """The name in a --- or +++ line; null if that side does not exist."""
    # Behind a name with a space git puts a tab.
    name = unquoted(F.regexp_replace(F.substr(value, F.lit(5)), r"\t$", ""))
    return F.when(name != "/dev/null", F.regexp_replace(name, f"^{letter}/", ""))


def diff_rows(lines: DataFrame, bits: int = 18) -> DataFrame:
    """range_id, path, line_no, sign, text, hunk: the content lines of unified diffs.

    path is the new name, of deleted files the old one. hunk is the line number of the
    hunk's header. Notes such as "No newline at end of file" are no content.
    """
    value = F.col("value")
    old, new = value.startswith("-") | value.startswith(" "), value.startswith("+") | value.startswith(" ")
    is_hunk = value.rlike(_HUNK)

    def count(group: int) -> Column:
        # One line if the header gives no count.
        found = F.regexp_extract(value, _HUNK, group)
        return F.when(found == "", 1).otherwise(F.try_to_number(found, F.lit("9999999999"))).cast("long")

    rows = lines.filter(value.isNotNull() & F.col("log_id").isNotNull()).withColumns(
        {"_old": old, "_new": new, "_hunk": is_hunk}
    )
    told = running(rows, ["log_id"], "line_no", sums={"_n_old": F.col("_old"), "_n_new": F.col("_new")}, bits=bits)
    header = F.when(
        F.col("_hunk"),
        F.struct("line_no", "_n_old", "_n_new", count(1).alias("old_lines"), count(2).alias("new_lines")),
    )
    name = F.when(value.startswith("diff --git "), F.col("line_no"))
    placed = running(told, ["log_id"], "line_no", maxes={"_at": header, "_file": name}, bits=bits)
    # Lines of the hunk before this one.
    olds = F.col("_n_old") - F.col("_old").cast("long") - F.col("_at._n_old")
    news = F.col("_n_new") - F.col("_new").cast("long") - F.col("_at._n_new")
    left = (F.col("_old") & (olds < F.col("_at.old_lines"))) | (F.col("_new") & (news < F.col("_at.new_lines")))
    here = F.coalesce(F.col("_file") < F.col("_at.line_no"), F.lit(True))
    content = F.coalesce(left & here & ~F.col("_hunk"), F.lit(False))
    flagged = placed.withColumn("_content", content)
    before = F.when(~F.col("_content") & value.startswith("--- "), F.struct("line_no", _side(value, "a").alias("name")))
    after = F.when(~F.col("_content") & value.startswith("+++ "), F.struct("line_no", _side(value, "b").alias("name")))
    named = running(flagged, ["log_id"], "line_no", maxes={"_before": before, "_after": after}, bits=bits)
    return named.filter("_content").select(
        F.col("log_id").alias("range_id"),
        F.coalesce("_after.name", "_before.name").alias("path"),
        "line_no",
        F.substring("value", 1, 1).alias("sign"),
        F.substr(value, F.lit(2)).alias("text"),
        F.col("_at.line_no").alias("hunk"),
    )


def _arrow(path: Column, group: int) -> Column:
    """One side of a renamed path: 'a => b' or 'x/{a => b}/y'."""
    braces = rf"(?s)^(.*)\{{(.*) => (.*)\}}(.*)$"
    inside = F.concat(F.regexp_extract(path, braces, 1), F.regexp_extract(path, braces, group + 1), F.regexp_extract(path, braces, 4))
    plain = F.regexp_extract(path, r"(?s)^(.*) => (.*)$", group)
    # An empty side leaves two slashes.
    return F.when(path.rlike(braces), F.regexp_replace(inside, "//", "/")).when(path.contains(" => "), plain)


def numstat_rows(lines: DataFrame) -> DataFrame:
    """range_id, ins_txt, del_txt, path, new_path of the lines that `--numstat` prints; new_path of renames only."""
    parts = F.split("value", "\t", 3)
    rows = lines.filter(F.col("value").rlike(r"^([0-9]+|-)\t([0-9]+|-)\t")).select("log_id", parts.alias("f"))
    path = F.col("f")[2]
    return rows.select(
        F.col("log_id").alias("range_id"),
        F.col("f")[0].alias("ins_txt"),
        F.col("f")[1].alias("del_txt"),
        unquoted(F.coalesce(_arrow(path, 1), path)).alias("path"),
        unquoted(_arrow(path, 2)).alias("new_path"),
    )


def name_status_rows(lines: DataFrame) -> DataFrame:
    """range_id, status, path, new_path of the lines that `--name-status` prints; new_path of renames and copies only."""
    parts = F.split("value", "\t")
    rows = lines.filter(F.col("value").rlike(r"^[A-Z][0-9]*\t")).select("log_id", parts.alias("f"))
    return rows.select(
        F.col("log_id").alias("range_id"),
        F.col("f")[0].alias("status"),
        unquoted(F.col("f")[1]).alias("path"),
        unquoted(F.get("f", F.lit(2))).alias("new_path"),
    )


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A status, then one name, or two after R and C; a name may look like a status."""
    for batch in batches:
        out: list[tuple] = []
        for range_id, text in zip(batch.column("range_id").to_pylist(), batch.column("value").to_pylist(), strict=True):
            fields = iter((text or "").split("\0"))
            for status in fields:
                if status:
                    path = next(fields, None)
                    out.append((range_id, status, path, next(fields, None) if status[0] in "RC" else None))
        names = ["range_id", "status", "path", "new_path"]
        columns = [pa.array([r[k] for r in out], pa.string()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def name_status_z_rows(texts: DataFrame) -> DataFrame:
    """The same from `--name-status -z`: range_id and value, one whole output a row."""
    rows = texts.select(F.col("range_id").cast("string").alias("range_id"), "value")
    return rows.mapInArrow(_fields, "range_id string, status string, path string, new_path string")


def log_rows(lines: DataFrame, bits: int = 18) -> DataFrame:
    """range_id, commit_id, committed_at, is_merge, subject, body of what `log --date=iso-strict` prints.

    Headers stand at the left edge, messages are indented by four spaces. committed_at is
    the date that is shown (CommitDate, if it is, before Date).
    """
    value = F.col("value")
    start = F.when(value.rlike(_COMMIT), F.struct("line_no", F.regexp_extract(value, _COMMIT, 1).alias("id")))
    rows = lines.filter(value.isNotNull() & F.col("log_id").isNotNull())
    told = running(rows, ["log_id"], "line_no", maxes={"_commit": start}, bits=bits).filter(F.col("_commit").isNotNull())
    indented = value.startswith("    ") | (value == "")
    said = F.when(indented, F.struct("line_no", F.substr(value, F.lit(5)).alias("text")))

    def header(name: str) -> Column:
        return F.max(F.when(value.startswith(f"{name}:"), F.trim(F.substr(value, F.lit(len(name) + 2)))))

    # A commit's own lines meet, as its message must fit a row.
    whole = told.groupBy("log_id", "_commit").agg(
        F.coalesce(header("CommitDate"), header("Date")).alias("at"),
        F.coalesce(F.bool_or(value.startswith("Merge: ")), F.lit(False)).alias("is_merge"),
        F.sort_array(F.collect_list(said)).alias("said"),
    )
    message = F.regexp_replace(F.array_join("said.text", "\n"), r"\A\n+|\n+\z", "")
    # The subject ends at the first empty line.
    parts = F.split(message, r"\n\n+", 2)
    subject, body = F.regexp_replace(parts[0], "\n", " "), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    return whole.select(
        F.col("log_id").alias("range_id"),
        F.col("_commit.id").alias("commit_id"),
        F.try_to_timestamp("at").alias("committed_at"),
        "is_merge",
        subject.alias("subject"),
        body.alias("body"),
    )
