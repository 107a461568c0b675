"""Bounded traversal: reachability, impact, dependencies, shortest paths, neighbourhoods, traces across repositories.

Each hop joins the frontier with the edges and leaves out what was reached before, so a
vertex is visited once however dense the graph. The frontier is kept in the shared
checkpoint folder after every hop; only whether it is empty comes back to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import referenced_name
from ..model import REACHING_LABELS, PropertyGraph
from ..session import cut

MAX_DEPTH = 10


def _hops(steps: DataFrame, roots: DataFrame, keys: list[str], depth: int, seed_visited: bool) -> DataFrame:
    """keys.., node, depth of all that steps (keys.., near, far) reach from roots (keys.., node)."""
    depth = max(0, min(depth, MAX_DEPTH))
    at = [*keys, "node"]
    frontier = cut(roots.select(*at).distinct())
    levels: list[DataFrame] = []
    visited = frontier if seed_visited else None
    for d in range(1, depth + 1):
        near = frontier.withColumnRenamed("node", "near")
        found = near.join(steps, [*keys, "near"]).select(*keys, F.col("far").alias("node")).distinct()
        if visited is not None:
            found = found.join(visited, at, "left_anti")
        frontier = cut(found)
        if frontier.isEmpty():
            break
        visited = frontier if visited is None else visited.unionByName(frontier)
        levels.append(frontier.withColumn("depth", F.lit(d)))
    if not levels:
        return frontier.limit(0).withColumn("depth", F.lit(0))
    return reduce(DataFrame.unionByName, levels)


def reach(edges: DataFrame, roots: DataFrame, depth: int = 3, direction: str = "forward", keep_root: bool = False) -> DataFrame:
    """(node, depth) within depth hops of the roots (node). keep_root: a root counts if a cycle leads back to it."""
    near, far = ("src", "dst") if direction == "forward" else ("dst", "src")
    steps = edges.select(F.col(near).alias("near"), F.col(far).alias("far"))
    if direction == "both":
        steps = edges.select(F.col("src").alias("near"), F.col("dst").alias("far")).unionByName(edges.select(F.col("dst").alias("near"), F.col("src").alias("far")))
    return _hops(steps, roots, [], depth, not keep_root)


def impact(edges: DataFrame, root: int, depth: int = 3, direction: str = "both", labels: tuple[str, ...] = REACHING_LABELS) -> DataFrame:
    """(node, relationship_type, way, depth): all that reaches or is reached from the root over one label at a time.

    A path never mixes labels. A node is given once: for the first label, in their order,
    that reaches it, callers before callees. The root is left out.
    """
    rank = reduce(lambda c, x: c.when(F.col("label") == x[1], F.lit(x[0])), enumerate(labels), F.when(F.lit(False), F.lit(None).cast("int")))
    kept = edges.where(F.col("label").isin(*labels))
    parts = []
    for way, near, far in (("callers", "dst", "src"), ("callees", "src", "dst")):
        if direction in ("both", "backward" if way == "callers" else "forward"):
            parts.append(kept.select("label", F.lit(way).alias("way"), F.col(near).alias("near"), F.col(far).alias("far")))
    steps = reduce(DataFrame.unionByName, parts)
    roots = edges.sparkSession.createDataFrame([(x, w, root) for x in labels for w in ("callers", "callees")], "label string, way string, node long")
    found = _hops(steps, roots, ["label", "way"], depth, True).where(F.col("node") != root)
    order = F.struct(rank.alias("rank"), F.when(F.col("way") == "callers", 0).otherwise(1).alias("side"), F.struct("label", "way", "depth").alias("pick"))
    return found.groupBy("node").agg(F.min(order).alias("m")).select("node", F.col("m.pick.label").alias("relationship_type"), F.col("m.pick.way").alias("way"), F.col("m.pick.depth").alias("depth"))


def impact_summary(found: DataFrame) -> DataFrame:
    """How many nodes each relationship type and side has."""
    return found.groupBy("relationship_type", "way").agg(F.count("*").alias("n"))


def dependencies(edges: DataFrame, root: int, label: str, depth: int = 1) -> DataFrame:
    """(node, way, depth) over edges of one label in both directions; the root counts where it lies on a cycle."""
    kept = edges.where(F.col("label") == label)
    steps = kept.select(F.lit("dependencies").alias("way"), F.col("src").alias("near"), F.col("dst").alias("far")).unionByName(kept.select(F.lit("dependents").alias("way"), F.col("dst").alias("near"), F.col("src").alias("far")))
    roots = edges.sparkSession.createDataFrame([("dependencies", root), ("dependents", root)], "way string, node long")
    return _hops(steps, roots, ["way"], depth, False)


def shortest_path(edges: DataFrame, start: int, end: int, max_depth: int = 5) -> DataFrame:
    """(position, node, edge_id) along a shortest path over all labels, edges taken both ways; empty if there is none of max_depth edges or fewer.

    Two frontiers grow towards each other, the smaller one first, so each is about half of the way deep. Of equal paths
    the one with the smaller node at the first difference, of parallel edges the smallest id. From a node to itself the path is that node. What comes to the driver:
    the size of each frontier, and a node and an edge of each hop.
    """
    spark = edges.sparkSession
    schema = "position int, node long, edge_id long"
    if start == end:
        return spark.createDataFrame([(0, start, None)], schema)
    both = edges.select(F.col("src").alias("near"), F.col("dst").alias("far"), "id").unionByName(edges.select(F.col("dst").alias("near"), F.col("src").alias("far"), "id"))
    links = both.select("near", "far")
    levels = {side: [spark.createDataFrame([(node,)], "node long")] for side, node in (("from", start), ("to", end))}
    seen, sizes = {side: found[0] for side, found in levels.items()}, {"from": 1, "to": 1}
    for _ in range(max(1, min(max_depth, MAX_DEPTH))):
        side = min(sizes, key=sizes.get)
        step = levels[side][-1].join(links, F.col("node") == F.col("near")).select(F.col("far").alias("node")).distinct()
        found = cut(step.join(seen[side], "node", "left_anti"))
        sizes[side] = found.count()
        if not sizes[side]:
            return spark.createDataFrame([], schema)
        levels[side].append(found)
        seen[side] = seen[side].unionByName(found)
        met = levels["from"][-1].join(levels["to"][-1], "node", "left_semi")
        if not met.isEmpty():
            break
    else:
        return spark.createDataFrame([], schema)
    # Nodes of all shortest paths, place by place: those met, and back to both ends those next to them a level below.
    places = [cut(met)]
    for below in reversed(levels["from"][:-1]):
        places.insert(0, cut(below.join(places[0].join(links, F.col("node") == F.col("near")).select(F.col("far").alias("node")).distinct(), "node", "left_semi")))
    for below in reversed(levels["to"][:-1]):
        places.append(cut(below.join(places[-1].join(links, F.col("node") == F.col("near")).select(F.col("far").alias("node")).distinct(), "node", "left_semi")))
    path = [(0, start, None)]
    for place in places[1:]:
        step = both.where(F.col("near") == path[-1][1]).join(place.withColumnRenamed("node", "far"), "far").agg(F.min(F.struct("far", "id")).alias("m")).first()["m"]
        path.append((len(path), step["far"], step["id"]))
    return spark.createDataFrame(path, schema)


def neighbourhood(edges: DataFrame, focus: DataFrame, hops: int = 1, aliases: DataFrame | None = None) -> DataFrame:
    """(node) within hops of the focus nodes over all edges, both ways. aliases (a, b): two ids of one node, as good as no hop apart."""
    if aliases is not None:
        same = aliases.select(F.col("a").alias("id"), "b").unionByName(aliases.select(F.col("b").alias("id"), F.col("a").alias("b")))
        bridged = lambda col: edges.join(same, edges[col] == same["id"]).withColumn(col, F.col("b")).select("src", "dst")
        edges = edges.select("src", "dst").unionByName(bridged("src")).unionByName(bridged("dst"))
        focus = focus.select("node").unionByName(focus.join(same, focus["node"] == same["id"]).select(F.col("b").alias("node")))
    return focus.select("node").unionByName(reach(edges, focus, hops, "both").select("node")).distinct()


def cross_repo_reach(graph: PropertyGraph, cross: DataFrame, repo_id: str, name: str, depth: int = 3, direction: str = "both", local: str | None = None, match: str = "exact") -> DataFrame:
    """(repo_id, name, depth, edge_type) found by name through local edges and edges between repositories.

    A hop follows the local CALLS, EXTENDS and IMPLEMENTS edges of all vertices of a name
    (edge_type LOCAL) and the cross edges whose node matches it; symbols that share a name
    are one. match "exact" wants a cross edge's node to be the name, "ref" also takes
    Label:name:path. local: the direction of local edges if it differs.
    """
    local = local or direction
    ends = graph.nodes.where("name is not null").select("repo_id", "id", "name")
    edges = graph.edges.where(F.col("label").isin(*REACHING_LABELS)).select("repo_id", "src", "dst")
    named = edges.join(ends.select("repo_id", F.col("id").alias("src"), F.col("name").alias("a")), ["repo_id", "src"]).join(ends.select("repo_id", F.col("id").alias("dst"), F.col("name").alias("b")), ["repo_id", "dst"])
    parts = []
    if local in ("forward", "both"):
        parts.append(named.select("repo_id", F.col("a").alias("near"), F.col("repo_id").alias("to_repo"), F.col("b").alias("far"), F.lit("LOCAL").alias("edge_type")))
    if local in ("backward", "both"):
        parts.append(named.select("repo_id", F.col("b").alias("near"), F.col("repo_id").alias("to_repo"), F.col("a").alias("far"), F.lit("LOCAL").alias("edge_type")))
    as_name = (lambda c: F.col(c)) if match == "exact" else (lambda c: referenced_name(F.col(c)))
    if direction in ("forward", "both"):
        parts.append(cross.select(F.col("source_repo").alias("repo_id"), as_name("source_node").alias("near"), F.col("target_repo").alias("to_repo"), as_name("target_node").alias("far"), "edge_type"))
    if direction in ("backward", "both"):
        parts.append(cross.select(F.col("target_repo").alias("repo_id"), as_name("target_node").alias("near"), F.col("source_repo").alias("to_repo"), as_name("source_node").alias("far"), "edge_type"))
    steps = reduce(DataFrame.unionByName, parts).groupBy("repo_id", "near", "to_repo", "far").agg(F.min("edge_type").alias("edge_type"))
    frontier = graph.nodes.sparkSession.createDataFrame([(repo_id, name)], "repo_id string, name string")
    visited, levels = frontier, []
    for d in range(1, max(1, min(depth, MAX_DEPTH)) + 1):
        hop = frontier.withColumnRenamed("name", "near").join(steps, ["repo_id", "near"])
        found = hop.groupBy(F.col("to_repo").alias("repo_id"), F.col("far").alias("name")).agg(F.min("edge_type").alias("edge_type")).join(visited, ["repo_id", "name"], "left_anti")
        found = cut(found)
        if found.isEmpty():
            break
        levels.append(found.withColumn("depth", F.lit(d)))
        frontier = found.select("repo_id", "name")
        visited = visited.unionByName(frontier)
    if not levels:
        return frontier.limit(0).select("repo_id", "name", F.lit("").alias("edge_type"), F.lit(0).alias("depth"))
    return reduce(DataFrame.unionByName, levels)


def cross_repo_impact(graph: PropertyGraph, cross: DataFrame, repo_id: str, name: str, depth: int = 3) -> DataFrame:
    """As cross_repo_reach, with local edges taken backward only and cross edges both ways."""
    return cross_repo_reach(graph, cross, repo_id, name, depth, "both", "backward")


def cross_repo_stats(cross: DataFrame) -> DataFrame:
    """One table of counts: kind total, type, pair or repos; key; n."""
    pair = F.concat_ws("->", "source_repo", "target_repo")
    repos = cross.select(F.col("source_repo").alias("r")).union(cross.select("target_repo")).distinct()
    return (
        cross.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("").alias("key"), "n")
        .unionByName(cross.groupBy(F.col("edge_type").alias("key")).agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), "key", "n"))
        .unionByName(cross.groupBy(pair.alias("key")).agg(F.count("*").alias("n")).select(F.lit("pair").alias("kind"), "key", "n"))
        .unionByName(repos.agg(F.count("*").alias("n")).select(F.lit("repos").alias("kind"), F.lit("").alias("key"), "n"))
    )


def multi_source(edges: DataFrame, direct: DataFrame, depth: int = 3) -> DataFrame:
    """(node, depth, via): callers within depth of the direct nodes (node), those left out; via is the smallest node that found it."""
    frontier = cut(direct.select("node").distinct())
    visited, levels = frontier, []
    for d in range(1, max(1, min(depth, MAX_DEPTH)) + 1):
        hop = frontier.join(edges.select(F.col("dst").alias("node"), F.col("src").alias("caller")), "node")
        found = cut(hop.groupBy(F.col("caller").alias("node")).agg(F.min("node").alias("via")).join(visited, "node", "left_anti"))
        if found.isEmpty():
            break
        levels.append(found.select("node", F.lit(d).alias("depth"), "via"))
        frontier = found.select("node")
        visited = visited.unionByName(frontier)
    if not levels:
        return frontier.limit(0).select("node", F.lit(0).alias("depth"), F.col("node").alias("via"))
    return reduce(DataFrame.unionByName, levels)
