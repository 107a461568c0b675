"""Listing and counting: vertices, edges, neighbours, statistics, orphans, routes, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import SYMBOL_LABELS, PropertyGraph


def list_nodes(graph: PropertyGraph, label: str | None = None, file_path: str | None = None, exported: bool | None = None, name_contains: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of vertices by id. The name filter is a case-sensitive substring; limit is 200 at most."""
    out = graph.nodes
    if label is not None:
        out = out.where(F.col("label") == label)
    if file_path is not None:
        out = out.where(F.col("file_path") == file_path)
    if exported is not None:
        out = out.where(F.coalesce("exported", F.lit(False)) == exported)
    if name_contains:
        out = out.where(F.col("name").contains(name_contains))
    return out.orderBy("id").offset(offset).limit(min(limit, 200))


def list_edges(graph: PropertyGraph, label: str | None = None, source_label: str | None = None, limit: int = 50) -> DataFrame:
    """Edges by id, with labels and names of both ends."""
    edges = graph.edges if label is None else graph.edges.where(F.col("label") == label)
    ends = graph.nodes.select("repo_id", F.col("id").alias("n"), F.col("label").alias("l"), "name")
    source = ends.select("repo_id", F.col("n").alias("src"), F.col("l").alias("source_label"), F.col("name").alias("source_name"))
    target = ends.select("repo_id", F.col("n").alias("dst"), F.col("l").alias("target_label"), F.col("name").alias("target_name"))
    if source_label is not None:
        source = source.where(F.col("source_label") == source_label)
    return edges.join(source, ["repo_id", "src"]).join(target, ["repo_id", "dst"]).orderBy("id").limit(min(limit, 500))


def neighbours(graph: PropertyGraph, node_id: int) -> DataFrame:
    """Edges of any label that leave or enter a vertex: direction, edge_label, edge_id, and the other end."""
    at = F.lit(node_id)
    touching = graph.edges.where((F.col("src") == at) | (F.col("dst") == at))
    out = touching.where(F.col("src") == at).select(F.lit("outgoing").alias("direction"), F.col("label").alias("edge_label"), F.col("id").alias("edge_id"), "repo_id", F.col("dst").alias("id"))
    into = touching.where(F.col("dst") == at).select(F.lit("incoming").alias("direction"), F.col("label").alias("edge_label"), F.col("id").alias("edge_id"), "repo_id", F.col("src").alias("id"))
    return out.unionByName(into).join(graph.nodes.select("repo_id", "id", "label", "name", "file_path"), ["repo_id", "id"])


def named_neighbours(graph: PropertyGraph, name: str, labels: tuple[str, ...], direction: str = "both") -> DataFrame:
    """One hop from all vertices of a name over edges of the labels: (repo_id, name, edge_label), each neighbour name once."""
    ends = graph.nodes.select("repo_id", F.col("id"), "name")
    start = ends.where(F.col("name") == name).select("repo_id", "id")
    edges = graph.edges.where(F.col("label").isin(*labels))
    parts = []
    for way, near, far in (("forward", "src", "dst"), ("backward", "dst", "src")):
        if direction in (way, "both"):
            hop = start.join(edges, (edges["repo_id"] == start["repo_id"]) & (edges[near] == start["id"])).select(edges["repo_id"], F.col(far).alias("id"), edges["label"].alias("edge_label"))
            parts.append(hop.join(ends, ["repo_id", "id"]).select("repo_id", "name", "edge_label"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("repo_id", "name").agg(F.min("edge_label").alias("edge_label"))


def context(graph: PropertyGraph, name_contains: str) -> DataFrame:
    """Neighbours of the first vertex, by id, whose name has a substring."""
    first = graph.nodes.where(F.col("name").contains(name_contains)).agg(F.min("id").alias("root"))
    both = [graph.edges.select("repo_id", F.col(near).alias("root"), F.lit(way).alias("direction"), F.col("label").alias("edge_label"), F.col(far).alias("id")) for way, near, far in (("outgoing", "src", "dst"), ("incoming", "dst", "src"))]
    touching = both[0].unionByName(both[1]).join(first, "root")
    return touching.join(graph.nodes.select("repo_id", "id", "label", "name"), ["repo_id", "id"])


def query_across(nodes: DataFrame, name_contains: str, limit: int) -> DataFrame:
    """Vertices of all repositories by name substring; the limit is shared out, and each repository gets its part at most."""
    found = nodes.where(F.col("name").contains(name_contains))
    repos = nodes.select("repo_id").distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("repos")).scalar()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy("id")))
    return ranked.where(F.col("rank") <= F.ceil(F.lit(limit) / repos)).orderBy("repo_id", "id").limit(limit).drop("rank")


def label_counts(rows: DataFrame) -> DataFrame:
    """How many rows each label has; labels without rows are left out."""
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(repo_id, id, out_degree, in_degree) of every vertex that an edge touches."""
    ends = edges.select("repo_id", F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("repo_id", F.col("e.id").alias("id")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def orphans(graph: PropertyGraph, labels: tuple[str, ...] = SYMBOL_LABELS, ignore: tuple[str, ...] = (), offset: int | None = None, limit: int | None = None) -> DataFrame:
    """Vertices of the labels that no edge enters, of any label but those to ignore. Offset and limit hold for each label."""
    entered = graph.edges.where(~F.col("label").isin(*ignore)) if ignore else graph.edges
    out = graph.nodes.where(F.col("label").isin(*labels)).join(entered.select("repo_id", F.col("dst").alias("id")), ["repo_id", "id"], "left_anti")
    if limit is None:
        return out
    rank = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return out.withColumn("rank", rank).where((F.col("rank") > (offset or 0)) & (F.col("rank") <= (offset or 0) + limit)).drop("rank")


def routes(graph: PropertyGraph, method: str | None = None, url_contains: str | None = None) -> DataFrame:
    """Route handlers with the file that exposes them, by method and URL; the filters ignore case and outer blanks."""
    at = F.col
    handlers = graph.nodes.where(at("label") == "RouteHandler").select("repo_id", at("id").alias("dst"), F.coalesce(at("props")["http_method"], F.lit("UNKNOWN")).alias("http_method"), at("props")["url_pattern"].alias("url_pattern"), at("props")["framework"].alias("framework"), F.when(at("props")["handler_name"] != "", at("props")["handler_name"]).alias("handler_name"), "start_line")
    files = graph.nodes.where(at("label") == "File").select("repo_id", at("id").alias("src"), at("file_path").alias("file_path"))
    out = graph.edges.where(at("label") == "EXPOSES").select("repo_id", "src", "dst").join(handlers, ["repo_id", "dst"]).join(files, ["repo_id", "src"])
    if method:
        out = out.where(F.upper(F.trim("http_method")) == method.strip().upper())
    if url_contains:
        out = out.where(F.lower("url_pattern").contains(url_contains.strip().lower()))
    return out.select("http_method", "url_pattern", "framework", "handler_name", "start_line", "file_path").orderBy("http_method", "url_pattern", "file_path", "start_line")


def visible(nodes: DataFrame, edges: DataFrame, node_labels: tuple[str, ...], edge_labels: tuple[str, ...]) -> PropertyGraph:
    """The vertices and edges of the labels; an edge stays only with both its ends."""
    kept = nodes.where(F.col("label").isin(*node_labels))
    ids = kept.select("repo_id", "id")
    ends = edges.where(F.col("label").isin(*edge_labels)).join(ids.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["repo_id", "dst"], "left_semi")
    return PropertyGraph(kept, ends.select(*edges.columns))


def file_collapse(graph: PropertyGraph) -> DataFrame:
    """Edges lifted to the files that define their ends: (repo_id, src, dst, label), each once, without loops."""
    files = graph.nodes.where(F.col("label") == "File").select("repo_id", "id", F.col("id").alias("home"))
    homes = graph.edges.where(F.col("label") == "DEFINES").select("repo_id", F.col("dst").alias("id"), F.col("src").alias("home")).unionByName(files)
    links = graph.edges.where(~F.col("label").isin("DEFINES", "CONTAINS"))
    lifted = links.join(homes.select("repo_id", F.col("id").alias("src"), F.col("home").alias("a")), ["repo_id", "src"]).join(homes.select("repo_id", F.col("id").alias("dst"), F.col("home").alias("b")), ["repo_id", "dst"])
    return lifted.where("a != b").select("repo_id", F.col("a").alias("src"), F.col("b").alias("dst"), "label").distinct()


def children_by_label(graph: PropertyGraph) -> DataFrame:
    """For each file how many symbols of each label it defines: (repo_id, file_id, label, n)."""
    defined = graph.edges.where(F.col("label") == "DEFINES").select("repo_id", F.col("src").alias("file_id"), F.col("dst").alias("id"))
    return defined.join(graph.nodes.select("repo_id", "id", "label"), ["repo_id", "id"]).groupBy("repo_id", "file_id", "label").agg(F.count("*").alias("n"))
