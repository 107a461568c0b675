"""Leiden communities of graphs of any size, as joins and aggregates over edge tables.

One level: local moving, refinement, aggregation, as published; here one half of the vertices, by hash, and then
the other move at once; halves are dealt anew after that. What is summed are whole numbers (edges and degrees), so
a round's outcome doesn't depend on the order of its tasks.

- Moving: a vertex goes to the neighbouring community with the most links beyond those expected by
  degree. A vertex alone moves to another one that is alone only if that has the smaller number,
  so that two don't trade places.
- Refinement: inside each community, vertices that are still alone join a part that they are linked to and
  that stays in this round. Nothing leaves a part of two or more, so every part is connected.
- Aggregation: parts become vertices, links between parts are summed, communities are kept as the start of the next level.

At the end a community that moving has torn is cut into its connected pieces, which never lowers modularity. Every
table is keyed by vertex or community; no task holds a graph. A hub's links or a giant community's vertices are one key in some joins, whose other side has one row for it: left to
adaptive execution, which splits them. Tables keyed so are joined by sorting: adaptive execution takes a table for small by its
compressed bytes, and what it then sends through the driver is many times that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_anew, sorted_join

#: Rounds of moving and of refinement a level, and levels; moving ends earlier when hardly anything moves twice in succession.
MOVES, REFINES, LEVELS = 6, 4, 12
#: A level's moving also ends when fewer than this share of its vertices move.
FEW = 0.01


def cut(df: DataFrame) -> DataFrame:
    return sorted_join(cut_anew(df))


def _turn() -> Column:
    """Whether a vertex moves in this round: each does in one round of two, by the last bit of its `dice`. A plan without the number of the round is compiled once."""
    return F.col("dice").bitwiseAND(F.lit(1)) == F.col("half")


def _next() -> list[Column]:
    """dice and half of the next round; after two rounds the next bit counts."""
    return [F.when(F.col("half") == 1, F.shiftrightunsigned("dice", 1)).otherwise(F.col("dice")).alias("dice"), (1 - F.col("half")).alias("half")]


def _moved(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes after those whose turn it is have moved, with whether each has."""
    totals = nodes.groupBy("repo_id", "c").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("members"))
    going = nodes.where(_turn()).select("repo_id", "id", "k", "m2", "gamma", F.col("c").alias("own"))
    around = links.join(going, ["repo_id", "id"]).join(nodes.select("repo_id", F.col("id").alias("other"), "c"), ["repo_id", "other"]).drop("other")
    near = around.unionByName(going.select("*", F.col("own").alias("c"), F.lit(0).cast("long").alias("w")))
    near = near.groupBy("repo_id", "id", "c").agg(F.sum("w").alias("w"), *(F.max(x).alias(x) for x in ("k", "m2", "gamma", "own")))
    home = F.col("c") == F.col("own")
    gain = F.col("w") * F.col("m2") - F.col("gamma") * F.col("k") * (F.col("total") - F.when(home, F.col("k")).otherwise(0))
    found = near.join(totals, ["repo_id", "c"]).groupBy("repo_id", "id").agg(
        F.max(F.struct(gain.alias("gain"), (-F.col("c")).alias("c"), F.col("members").alias("members"))).alias("best"), F.max(F.when(home, gain)).alias("stay"), F.max(F.when(home, F.col("members"))).alias("alone")
    )
    target = -F.col("best.c")
    goes = (F.col("best.gain") > F.col("stay")) & ((F.col("alone") > 1) | (F.col("best.members") > 1) | (target < F.col("c")))
    moved = F.coalesce(goes, F.lit(False))
    return nodes.join(found, ["repo_id", "id"], "left").select("repo_id", "id", "k", "m2", "gamma", *_next(), F.when(moved, target).otherwise(F.col("c")).alias("c"), moved.alias("moved"))


def _settled(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """nodes after local moving, and whether any has moved."""
    size, quiet, ever = nodes.count(), 0, False
    for _ in range(MOVES):
        stepped = cut(_moved(nodes, links))
        n = stepped.where("moved").count()
        nodes = stepped.drop("moved")
        ever |= n > 0
        quiet = quiet + 1 if n <= FEW * size else 0
        if quiet == 2:
            break
    return nodes, ever


def _refined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with s, the part inside its community that each belongs to: singletons merged along links."""
    inner = links.join(nodes.select("repo_id", "id", "c"), ["repo_id", "id"]).join(nodes.select("repo_id", F.col("id").alias("other"), F.col("c").alias("c2")), ["repo_id", "other"]).where("c = c2").select("repo_id", "id", "other", "w")
    inner = cut(inner)
    whole = nodes.groupBy("repo_id", "c").agg(F.sum("k").alias("whole"))
    # Links of a vertex to the rest of its community decide whether it may join anything at all.
    out = inner.groupBy("repo_id", "id").agg(F.sum("w").alias("out"))
    nodes = cut(nodes.join(whole, ["repo_id", "c"]).join(out, ["repo_id", "id"], "left").na.fill(0, ["out"]).withColumn("s", F.col("id")))
    for _ in range(REFINES):
        ends = inner.join(nodes.select("repo_id", "id", "s"), ["repo_id", "id"]).join(nodes.select("repo_id", F.col("id").alias("other"), F.col("s").alias("s2")), ["repo_id", "other"]).where("s != s2")
        beyond = ends.groupBy("repo_id", "s").agg(F.sum("w").alias("beyond"))
        parts = nodes.groupBy("repo_id", "s").agg(F.sum("k").alias("size"), F.count(F.lit(1)).alias("members"), F.max("dice").alias("dice"), F.max("half").alias("half"), F.max("whole").alias("whole"), F.max("m2").alias("m2"), F.max("gamma").alias("gamma"))
        parts = parts.join(beyond, ["repo_id", "s"], "left").na.fill(0, ["beyond"])
        tied = F.col("beyond") * F.col("m2") >= F.col("gamma") * F.col("size") * (F.col("whole") - F.col("size"))
        stays = (F.col("members") > 1) | ~_turn()
        targets = parts.where(tied & stays).select("repo_id", F.col("s").alias("s2"), "size")
        alone = parts.where("members = 1").select("repo_id", F.col("s").alias("id"))
        joins = F.col("out") * F.col("m2") >= F.col("gamma") * F.col("k") * (F.col("whole") - F.col("k"))
        going = nodes.where(_turn() & joins).select("repo_id", "id", "k", "m2", "gamma").join(alone, ["repo_id", "id"], "left_semi")
        near = ends.groupBy("repo_id", "id", "s2").agg(F.sum("w").alias("w")).join(sorted_join(going), ["repo_id", "id"]).join(sorted_join(targets), ["repo_id", "s2"])
        gain = F.col("w") * F.col("m2") - F.col("gamma") * F.col("k") * F.col("size")
        best = near.withColumn("gain", gain).where("gain >= 0").groupBy("repo_id", "id").agg(F.max(F.struct("gain", (-F.col("s2")).alias("s2"))).alias("m")).select("repo_id", "id", (-F.col("m.s2")).alias("new"))
        rest = [c for c in nodes.columns if c not in ("s", "dice", "half")]
        nodes = cut(nodes.join(best, ["repo_id", "id"], "left").select(*rest, F.coalesce("new", "s").alias("s"), *_next()))
    return nodes


def pieces(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, id, piece): connected components of (repo_id, id, other), each named by its smallest vertex.

    Each round takes the least name around and then the name's own name, so a chain of n takes about log n rounds.
    """
    names = cut(vertices.select("repo_id", "id", F.col("id").alias("piece")))
    while True:
        around = links.join(names.select("repo_id", F.col("id").alias("other"), F.col("piece").alias("seen")), ["repo_id", "other"]).groupBy("repo_id", "id").agg(F.min("seen").alias("seen"))
        low = names.join(around, ["repo_id", "id"], "left").select("repo_id", "id", "piece", F.least("piece", F.coalesce("seen", "piece")).alias("low"))
        # A vertex that its piece is named by hears of the least name that any member has seen.
        heard = low.groupBy("repo_id", F.col("piece").alias("id")).agg(F.min("low").alias("heard"))
        low = cut(low.join(sorted_join(heard), ["repo_id", "id"], "left").select("repo_id", "id", "piece", F.least("low", F.coalesce("heard", "low")).alias("low")))
        jumped = cut(low.join(low.select("repo_id", F.col("id").alias("low"), F.col("low").alias("next")), ["repo_id", "low"]).select("repo_id", "id", F.least("low", "next").alias("piece"), (F.least("low", "next") < F.col("piece")).alias("moved")))
        names = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return names


def leiden(edges: DataFrame, resolution: Column) -> DataFrame:
    """(repo_id, id, community) of undirected pairs (repo_id, a, b), a < b, without repeats; a community is named by its smallest vertex.

    resolution: of the columns repo_id, vertices and pairs of a repository.
    """
    both = edges.select("repo_id", F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select("repo_id", F.col("b").alias("id"), F.col("a").alias("other")))
    kept = cut_anew(both.withColumn("w", F.lit(1).cast("long")))
    # Facts of a repository meet its vertices by no sorted join, whose key would be the repository.
    links, degree = sorted_join(kept), kept.groupBy("repo_id", "id").agg(F.sum("w").alias("k"))
    facts = degree.groupBy("repo_id").agg(F.sum("k").alias("m2"), F.count(F.lit(1)).alias("vertices")).withColumn("pairs", (F.col("m2") / 2).cast("long"))
    facts = facts.select("repo_id", "m2", resolution.cast("double").alias("gamma"))
    nodes = cut(degree.join(facts, "repo_id").withColumns({"c": F.col("id"), "dice": F.xxhash64("id"), "half": F.lit(0)}))
    flat = nodes.select("repo_id", "id", F.col("id").alias("node"))
    for level in range(LEVELS):
        nodes, any_moved = _settled(nodes, links)
        before, left = nodes.agg(F.count(F.lit(1)), F.countDistinct("repo_id", "c")).first()
        if before == left:  # every community is one vertex
            break
        parts = _refined(nodes, links)
        name = parts.select("repo_id", F.col("id").alias("node"), "s")
        flat = cut(flat.join(name, ["repo_id", "node"]).select("repo_id", "id", F.col("s").alias("node")))
        links = cut(
            links.join(parts.select("repo_id", "id", F.col("s").alias("a")), ["repo_id", "id"]).join(parts.select("repo_id", F.col("id").alias("other"), F.col("s").alias("b")), ["repo_id", "other"])
            .where("a != b").groupBy("repo_id", F.col("a").alias("id"), F.col("b").alias("other")).agg(F.sum("w").alias("w"))
        )
        nodes = cut(parts.groupBy("repo_id", F.col("s").alias("id")).agg(F.sum("k").alias("k"), F.max("m2").alias("m2"), F.max("gamma").alias("gamma"), F.max("c").alias("c")).withColumns({"dice": F.xxhash64("id", F.lit(level)), "half": F.lit(0)}))
        if not any_moved and nodes.count() == before:
            break
    c = lambda end, name: nodes.select("repo_id", F.col("id").alias(end), F.col("c").alias(name))
    inner = cut(links.join(c("id", "c"), ["repo_id", "id"]).join(c("other", "c2"), ["repo_id", "other"]).where("c = c2").select("repo_id", "id", "other"))
    named = pieces(nodes, inner).select("repo_id", F.col("id").alias("node"), "piece")
    found = cut(flat.join(named, ["repo_id", "node"]).select("repo_id", "id", "piece"))
    least = found.groupBy("repo_id", "piece").agg(F.min("id").alias("community"))
    return found.join(least, ["repo_id", "piece"]).select("repo_id", "id", "community")
