"""Daily activity of a commit feed as a stream: what history.daily gives, kept up to date. An addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_activity(feed: DataFrame, lateness: str = "2 days", ts: str = "commit_date") -> DataFrame:
    """(repo_id, day, commits, files, rows) of a stream of history rows; rows later than lateness are dropped.

    Distinct counts are approximate, as exact ones would keep every sha of a day in state.
    """
    marked = feed.withColumn("ts", F.col(ts).cast("timestamp")).withWatermark("ts", lateness)
    out = marked.groupBy("repo_id", F.window("ts", "1 day")).agg(F.approx_count_distinct("commit_sha", 0.02).alias("commits"), F.approx_count_distinct("file_path", 0.02).alias("files"), F.count("*").alias("rows"))
    return out.select("repo_id", F.to_date("window.start").alias("day"), "commits", "files", "rows")


def latest_rows(feed: DataFrame, key: list[str], ts: str = "commit_date", lateness: str = "2 days") -> DataFrame:
    """The stream without repeats of a key within the watermark."""
    return feed.withColumn("ts", F.col(ts).cast("timestamp")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(key)
