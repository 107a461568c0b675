"""Incremental rebuilds: what changed between snapshots, what that touches, and the graph without it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo_id, file_path, change): A, M or D between snapshots (repo_id, file_path, content_hash); a rename is D and A."""
    a = old.select("repo_id", "file_path", F.col("content_hash").alias("before"))
    b = new.select("repo_id", "file_path", F.col("content_hash").alias("after"))
    both = a.join(b, ["repo_id", "file_path"], "full_outer")
    change = F.when(F.col("before").isNull(), "A").when(F.col("after").isNull(), "D").when(F.col("before") != F.col("after"), "M")
    return both.select("repo_id", "file_path", change.alias("change")).where("change is not null")


def reverse_importers(graph: PropertyGraph, changed: DataFrame) -> DataFrame:
    """(repo_id, file_path) of files that import a changed one and aren't changed themselves."""
    files = graph.nodes.where(F.col("label") == "File").select("repo_id", "id", "file_path")
    paths = changed.select("repo_id", "file_path").distinct()
    targets = files.join(paths, ["repo_id", "file_path"], "left_semi").select("repo_id", F.col("id").alias("dst"))
    sources = graph.edges.where(F.col("label") == "IMPORTS").select("repo_id", "src", "dst").join(targets, ["repo_id", "dst"], "left_semi").select("repo_id", F.col("src").alias("id")).distinct()
    return files.join(sources, ["repo_id", "id"], "left_semi").select("repo_id", "file_path").join(paths, ["repo_id", "file_path"], "left_anti").distinct()


def affected(graph: PropertyGraph, changes: DataFrame) -> DataFrame:
    """Files whose imports and calls are made anew: added, modified, and those that import a changed file."""
    kept = changes.where(F.col("change") != "D").select("repo_id", "file_path")
    return kept.unionByName(reverse_importers(graph, changes)).distinct()


def without(graph: PropertyGraph, changes: DataFrame) -> PropertyGraph:
    """The graph without the vertices of changed files, edges that touched them, and what reverse importers derive anew.

    All derived edges of a reverse importer go, overrides and handlers included, so that a
    rebuild of the affected files gives the graph that a full build gives.
    """
    paths = changes.select("repo_id", "file_path").distinct()
    nodes = graph.nodes.join(paths, ["repo_id", "file_path"], "left_anti").select(*graph.nodes.columns)
    ids = nodes.select("repo_id", "id")
    edges = graph.edges.join(ids.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["repo_id", "dst"], "left_semi")
    again = nodes.join(reverse_importers(graph, changes), ["repo_id", "file_path"], "left_semi").select("repo_id", F.col("id").alias("src"))
    derived = F.col("label").isin("IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "OVERRIDES", "HANDLES")
    kept = edges.where(~derived).unionByName(edges.where(derived).join(again, ["repo_id", "src"], "left_anti").select(*edges.columns))
    return PropertyGraph(nodes, kept.select(*graph.edges.columns))


def mode(changes: DataFrame, asked: str = "incremental") -> str:
    """full if that is asked for or nothing changed, else incremental."""
    return "full" if asked == "full" or changes.isEmpty() else "incremental"
