"""Commit history: what files, authors and days show, and the timeline of commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a history: repo_id, file_path, commit_sha, author_name, author_email, commit_date, commit_message, change_type.


def keep_recent(history: DataFrame, per_file: int = 20) -> DataFrame:
    """At most so many commits of each file, the latest; equal dates by sha."""
    rank = F.row_number().over(Window.partitionBy("repo_id", "file_path").orderBy(F.desc("commit_date"), "commit_sha"))
    return history.withColumn("rank", rank).where(F.col("rank") <= per_file).drop("rank")


def to_store(rows: DataFrame, message_length: int = 500) -> DataFrame:
    """Rows as they are stored: one for each repository, file and commit, messages cut at message_length."""
    return rows.withColumn("commit_message", F.substring("commit_message", 1, message_length)).dropDuplicates(["repo_id", "file_path", "commit_sha"])


def file_summary(history: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """For each file its commits, the last one's date, sha and author (equal dates: largest sha); latest first."""
    last = F.max_by(F.struct("commit_sha", "author_name"), F.struct("commit_date", "commit_sha"))
    out = history.groupBy("repo_id", "file_path").agg(F.count("*").alias("commit_count"), F.max("commit_date").alias("last_commit"), last.alias("last"))
    out = out.select("repo_id", "file_path", "commit_count", "last_commit", F.col("last.commit_sha").alias("last_sha"), F.col("last.author_name").alias("last_author"))
    return out if limit is None else out.orderBy(F.desc("last_commit"), "repo_id", "file_path").offset(offset).limit(limit)


def recent_commits(history: DataFrame, n: int = 5) -> DataFrame:
    """The n latest commits of each file with their rank."""
    rank = F.row_number().over(Window.partitionBy("repo_id", "file_path").orderBy(F.desc("commit_date"), F.desc("commit_sha")))
    return history.withColumn("rank", rank).where(F.col("rank") <= n)


def authors(history: DataFrame) -> DataFrame:
    """Distinct files and commits of each author."""
    return history.groupBy("repo_id", "author_name").agg(F.countDistinct("file_path").alias("files"), F.countDistinct("commit_sha").alias("commits"), F.max("commit_date").alias("last_commit"))


def daily(history: DataFrame, now: Column | None = None, days: int = 90) -> DataFrame:
    """Distinct commits and files of each day, of the days before now only if it is given."""
    rows = history if now is None else history.where(F.col("commit_date") >= now - F.make_interval(days=F.lit(days)))
    return rows.groupBy("repo_id", F.to_date("commit_date").alias("day")).agg(F.countDistinct("commit_sha").alias("commits"), F.countDistinct("file_path").alias("files"))


def total_commits(history: DataFrame) -> DataFrame:
    return history.agg(F.countDistinct("commit_sha").alias("total_commits"))


def timeline(history: DataFrame, since=None, until=None, limit: int = 20) -> DataFrame:
    """Commits with their files, oldest first; since and until are included."""
    rows = history
    if since is not None:
        rows = rows.where(F.col("commit_date") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("commit_date") <= F.lit(until))
    files = F.array_sort(F.collect_list(F.struct("file_path", "change_type")))
    out = rows.groupBy("repo_id", "commit_sha").agg(F.min("commit_date").alias("commit_date"), F.min("author_name").alias("author_name"), F.count("*").alias("n_files"), F.to_json(files).alias("files"))
    return out.orderBy("commit_date", "commit_sha").limit(limit)


def hotspots(history: DataFrame, n: int = 15) -> DataFrame:
    """The files with most commits."""
    return history.groupBy("repo_id", "file_path").agg(F.count("*").alias("commit_count")).orderBy(F.desc("commit_count"), "repo_id", "file_path").limit(n)
