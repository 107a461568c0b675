"""Tables around the graphs: files with their symbols, repositories with their jobs, connections, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import PropertyGraph
from .text import line_slice

#: Labels whose symbols are embedded.
EMBEDDED_LABELS = ("Function", "Class", "Interface", "Method", "CodeElement", "Struct", "Enum", "Trait", "TypeAlias", "Namespace")


def read_file(contents: DataFrame, graph: PropertyGraph, repo_id: str, file_path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """One row: language, the asked lines, and the symbols that the file defines, by line."""
    rows = contents.where((F.col("repo_id") == repo_id) & (F.col("file_path") == file_path)).select("repo_id", "file_path", "language", line_slice(F.col("content"), first, last).alias("content"))
    home = graph.nodes.where((F.col("repo_id") == repo_id) & (F.col("label") == "File") & (F.col("file_path") == file_path)).select("repo_id", F.col("id").alias("src"))
    own = graph.edges.where(F.col("label") == "DEFINES").select("repo_id", "src", F.col("dst").alias("id")).join(home, ["repo_id", "src"], "left_semi")
    found = graph.nodes.join(own, ["repo_id", "id"], "left_semi").groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "name", "label"))).alias("symbols"))
    return rows.join(found, "repo_id", "left")


def repositories(repos: DataFrame, jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Repositories (repo_id, name) with their newest job's status and time, and their number of files, 0 if none."""
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("created_at"), F.desc("job_id")))
    newest = jobs.withColumn("rank", rank).where("rank = 1").select("repo_id", F.col("status").alias("last_status"), F.col("created_at").alias("last_job"))
    counts = files.groupBy("repo_id").agg(F.count("*").alias("n"))
    return repos.join(newest, "repo_id", "left").join(counts, "repo_id", "left").withColumn("files", F.coalesce("n", F.lit(0))).drop("n")


def job_page(jobs: DataFrame, repo_id: str, limit: int = 20) -> DataFrame:
    return jobs.where(F.col("repo_id") == repo_id).orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def named_connections(connections: DataFrame, edges: DataFrame, repos: DataFrame) -> DataFrame:
    """Connections with the names of both repositories and their number of edges."""
    a, b = (repos.select(F.col("repo_id").alias(f"{s}_repo"), F.col("name").alias(f"{s}_name")) for s in ("source", "target"))
    counts = edges.groupBy("source_repo", "target_repo", F.col("edge_type").alias("connection_type")).agg(F.count("*").alias("n"))
    out = connections.join(a, "source_repo", "left").join(b, "target_repo", "left").join(counts, ["source_repo", "target_repo", "connection_type"], "left")
    return out.withColumn("edge_count", F.coalesce("n", F.lit(0))).drop("n")


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges set by hand; resolving a connection leaves them."""
    return edges.unionByName(new.withColumn("manual", F.lit(True)), allowMissingColumns=True)


def delete_edges(edges: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return edges.join(ids.select(key), key, "left_anti")


def embeddable(graph: PropertyGraph) -> DataFrame:
    """Vertices to embed, each id once: defined symbols, route handlers and files."""
    defined = graph.edges.where(F.col("label") == "DEFINES").select("repo_id", F.col("dst").alias("id"))
    symbols = graph.nodes.where(F.col("label").isin(*EMBEDDED_LABELS)).join(defined, ["repo_id", "id"], "left_semi")
    others = graph.nodes.where(F.col("label").isin("RouteHandler", "File"))
    return symbols.unionByName(others.select(*symbols.columns)).dropDuplicates(["repo_id", "id"])


def embedding_counts(rows: DataFrame) -> DataFrame:
    """Embeddings of each number of dimensions."""
    return rows.groupBy(F.size("embedding").alias("dimensions")).agg(F.count("*").alias("n"))


def members(nodes: DataFrame) -> DataFrame:
    """(repo_id, type_name, members): method names by class; for a type without methods the field names of its signature."""
    methods = nodes.where(F.col("label") == "Method").groupBy("repo_id", F.col("class_name").alias("type_name")).agg(F.sort_array(F.collect_set("name")).alias("members"))
    fields = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("props")["signature"], F.lit("")), F.lit("(\\w+)\\??\\s*:"), F.lit(1)))
    others = nodes.where(F.col("label").isin("Class", "Interface", "Struct", "TypeAlias")).select("repo_id", F.col("name").alias("type_name"), fields.alias("members"))
    return methods.unionByName(others.join(methods.select("repo_id", "type_name"), ["repo_id", "type_name"], "left_anti"))
