"""Parsers of git's texts: logs with name status, name-status diffs, unified diffs. Input: one row for each line, with its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of lines that a header is carried along in one piece; from piece to piece goes one header.
BLOCK = 8192


def parse_log(lines: DataFrame, known: DataFrame | None = None, per_file: int = 20) -> DataFrame:
    """History rows of lines (repo_id, n, line) of ``sha|author|email|date|subject`` headers and status lines.

    A status line belongs to the header before it. A rename counts for its new path. Only
    statuses A, M, D and R are taken, known files (repo_id, file_path) only if they are
    given, and the first per_file commits of each file.
    """
    head = F.col("line").rlike("^[0-9a-f]{7,40}\\|")
    parts = F.split("line", "\\|", 5)
    marked = lines.withColumn("head", F.when(head, F.struct(parts[0].alias("sha"), parts[1].alias("author"), parts[2].alias("email"), parts[3].alias("date"), parts[4].alias("subject"))))
    # A log is many pieces, so no task has a whole one: the last header in a piece, else the last of the pieces before.
    placed = marked.withColumn("block", F.floor(F.col("n") / BLOCK))
    lasts = placed.groupBy("repo_id", "block").agg(F.max(F.when(F.col("head").isNotNull(), F.struct("n", "head"))).alias("last"))
    earlier = Window.partitionBy("repo_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lasts.select("repo_id", "block", F.last("last", ignorenulls=True).over(earlier)["head"].alias("before"))
    so_far = Window.partitionBy("repo_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    carried = placed.withColumn("here", F.last("head", ignorenulls=True).over(so_far)).join(before, ["repo_id", "block"]).withColumn("commit", F.coalesce("here", "before"))
    cells = F.split("line", "\t")
    status = carried.where(F.col("head").isNull() & F.col("commit").isNotNull() & F.col("line").rlike("^[ADMR][0-9]*\t"))
    rows = status.select(
        "repo_id", "n", F.element_at(cells, -1).alias("file_path"), F.col("commit.sha").alias("commit_sha"), F.col("commit.author").alias("author_name"), F.col("commit.email").alias("author_email"),
        F.try_to_timestamp(F.col("commit.date")).alias("commit_date"), F.col("commit.subject").alias("commit_message"), F.substring("line", 1, 1).alias("change_type"),
    )
    if known is not None:
        rows = rows.join(known.select("repo_id", "file_path"), ["repo_id", "file_path"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("repo_id", "file_path").orderBy("n"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= per_file).drop("rank", "n")


def parse_name_status(lines: DataFrame) -> DataFrame:
    """(repo_id, file_path, change): a rename is a deletion and an addition, a copy an addition."""
    cells = F.split("line", "\t")
    kind = F.substring("line", 1, 1)
    pairs = (
        F.when(kind == "R", F.array(F.struct(cells[1].alias("file_path"), F.lit("D").alias("change")), F.struct(cells[2].alias("file_path"), F.lit("A").alias("change"))))
        .when(kind == "C", F.array(F.struct(cells[2].alias("file_path"), F.lit("A").alias("change"))))
        .otherwise(F.array(F.struct(cells[1].alias("file_path"), kind.alias("change"))))
    )
    return lines.where(F.col("line").rlike("^[AMDRC][0-9]*\t")).select("repo_id", F.explode(pairs).alias("p")).select("repo_id", "p.file_path", "p.change")


def parse_diff(lines: DataFrame) -> DataFrame:
    """(diff_id, file_path, line, side): numbers of added lines in the new file and of removed ones in the old, of unified diffs (diff_id, n, line).

    Headers are carried forward; a line's number is its hunk's start and the lines of its
    side before it in the hunk.
    """
    text = F.col("line")
    order = Window.partitionBy("diff_id").orderBy("n")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    hunk = F.when(text.startswith("@@ "), F.struct(F.col("n").alias("at"), F.regexp_extract(text, "-(\\d+)", 1).cast("int").alias("old"), F.regexp_extract(text, "\\+(\\d+)", 1).cast("int").alias("new")))
    marked = lines.withColumns({"file": F.when(text.startswith("diff --git "), F.regexp_extract(text, " b/(.*)$", 1)), "hunk": hunk})
    carried = marked.withColumns({"file_path": F.last("file", ignorenulls=True).over(so_far), "h": F.last("hunk", ignorenulls=True).over(so_far), "f": F.last(F.when(F.col("file").isNotNull(), F.col("n")), ignorenulls=True).over(so_far)})
    body = carried.where("hunk is null and h is not null and h.at > f")
    first = F.substring(text, 1, 1)
    sided = body.withColumns({"new_line": first.isin("+", " ", "").cast("int"), "old_line": first.isin("-", " ", "").cast("int")})
    within = Window.partitionBy("diff_id", "h.at").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = sided.withColumns({"a": F.coalesce(F.sum("new_line").over(within), F.lit(0)), "b": F.coalesce(F.sum("old_line").over(within), F.lit(0))})
    number = F.when(first == "+", F.col("h.new") + F.col("a")).when(first == "-", F.col("h.old") + F.col("b"))
    return placed.where(first.isin("+", "-")).select("diff_id", "file_path", number.cast("int").alias("line"), F.when(first == "+", "added").otherwise("removed").alias("side"))


def text_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line) of whole texts."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
