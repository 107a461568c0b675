"""Communities of a call graph: input graph, clustering, labels, keywords, cohesion, modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import name_words
from ..session import cut, sorted_join
from .leiden import leiden

LARGE = 10_000
#: Folders too general for a label, and words too general for a keyword.
GENERIC_FOLDERS = ("src", "lib", "core", "utils", "common", "shared", "helpers", ".", "", "dist", "build", "node_modules", "vendor", "pkg")
STOP_WORDS = ("get", "set", "is", "has", "do", "on", "the", "a", "an", "to", "of", "in", "for", "new", "from", "with", "by", "id", "fn", "cb", "err", "res", "req", "ctx", "db")


def input_edges(calls: DataFrame, least: float = 0.5, large: int = LARGE) -> DataFrame:
    """(repo_id, a, b), a < b: confident calls without direction, loops and repeats. In repositories of over large vertices, those of degree 1 go."""
    pairs = calls.where((F.col("confidence") >= least) & (F.col("src") != F.col("dst"))).select("repo_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = pairs.select("repo_id", F.explode(F.array("a", "b")).alias("id")).groupBy("repo_id", "id").agg(F.count("*").alias("degree"))
    size = degree.groupBy("repo_id").agg(F.count("*").alias("vertices"))
    leaves = sorted_join(degree.where("degree <= 1").join(size.where(F.col("vertices") > large).select("repo_id"), "repo_id", "left_semi"))
    return pairs.join(leaves.select("repo_id", F.col("id").alias("a")), ["repo_id", "a"], "left_anti").join(leaves.select("repo_id", F.col("id").alias("b")), ["repo_id", "b"], "left_anti").select("repo_id", "a", "b")


def communities(edges: DataFrame, large: int = LARGE) -> DataFrame:
    """(repo_id, id, community) by Leiden, all repositories at once; resolution 2 above large vertices, else 1. A community's number is its smallest vertex."""
    return leiden(edges, F.when(F.col("vertices") > large, 2.0).otherwise(1.0))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(repo_id, id, community): synchronous label propagation, equal counts by the smallest label; all in DataFrames."""
    both = cut(edges.select("repo_id", F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select("repo_id", F.col("b").alias("id"), F.col("a").alias("other"))))
    labels = cut(both.select("repo_id", "id").distinct().withColumn("community", F.col("id")))
    for _ in range(rounds):
        votes = both.join(sorted_join(labels).select("repo_id", F.col("id").alias("other"), "community"), ["repo_id", "other"]).groupBy("repo_id", "id", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("repo_id", "id").agg(F.min(F.struct(-F.col("n"), F.col("community"))).alias("m")).select("repo_id", "id", F.col("m.community").alias("new"))
        stepped = cut(labels.join(sorted_join(best), ["repo_id", "id"]).select("repo_id", "id", F.least("community", "new").alias("community"), (F.col("new") < F.col("community")).alias("moved")))
        labels = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            break
    return labels


def inner_links(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(repo_id, id, other) of pairs within one community, both ways."""
    m = sorted_join(membership.select("repo_id", "id", "community"))
    inner = edges.join(m.select("repo_id", F.col("id").alias("a"), F.col("community").alias("ca")), ["repo_id", "a"]).join(m.select("repo_id", F.col("id").alias("b"), F.col("community").alias("cb")), ["repo_id", "b"]).where("ca = cb")
    return inner.select("repo_id", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("x")).select("repo_id", "x.*")


def kept_communities(membership: DataFrame, symbols: DataFrame, least: int = 2) -> DataFrame:
    """Members that are known symbols (repo_id, id, name, file_path) with a name, of communities that have least of them."""
    known = membership.join(symbols.where("name is not null").select("repo_id", "id", "name", "file_path"), ["repo_id", "id"])
    sizes = known.groupBy("repo_id", "community").agg(F.count("*").alias("symbol_count")).where(F.col("symbol_count") >= least)
    return known.join(sizes, ["repo_id", "community"])


def cohesion(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(repo_id, community, cohesion): internal over all incident edges of all members, an edge counted at each member's end, rounded to 2 places."""
    both = edges.select("repo_id", F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select("repo_id", F.col("b").alias("id"), F.col("a").alias("other")))
    m = sorted_join(membership.select("repo_id", "id", "community"))
    sides = both.join(m, ["repo_id", "id"]).join(m.select("repo_id", F.col("id").alias("other"), F.col("community").alias("c2")), ["repo_id", "other"], "left")
    inside = F.sum(F.when(F.col("community") == F.col("c2"), 1).otherwise(0))
    return sides.groupBy("repo_id", "community").agg(F.round(inside / F.count("*"), 2).alias("cohesion"))


def keywords(members: DataFrame, top: int = 5) -> DataFrame:
    """(repo_id, community, word, n, rank): in how many members' names a word occurs, the top of each community, equal counts by word."""
    words = members.select("repo_id", "community", F.explode(name_words(F.col("name"))).alias("word")).where(~F.col("word").isin(*STOP_WORDS))
    counts = words.groupBy("repo_id", "community", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("repo_id", "community").orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def labels(members: DataFrame, share: float = 0.3) -> DataFrame:
    """(repo_id, community, label): the most frequent nearest folder that isn't generic, if enough members lie there; else their common name prefix of 3 or more; else Cluster_<id>."""
    folders = F.filter(F.slice(F.split("file_path", "/"), 1, F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0))), lambda x: ~F.lower(x).isin(*GENERIC_FOLDERS))
    near = members.withColumn("folder", F.when(F.size(folders) > 0, F.element_at(folders, -1)))
    sizes = members.groupBy("repo_id", "community").agg(F.count("*").alias("size"), F.min("name").alias("first"), F.max("name").alias("last"))
    counts = near.where("folder is not null").groupBy("repo_id", "community", "folder").agg(F.count("*").alias("n"))
    best = counts.groupBy("repo_id", "community").agg(F.min(F.struct(-F.col("n"), F.col("folder"))).alias("m")).select("repo_id", "community", F.col("m.folder").alias("folder"), (-F.col("m.col1")).alias("n"))
    # The common prefix of all names is that of the first and the last in order.
    prefix = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.length("first"), F.length("last")), F.lit(1))), F.lit(""), lambda a, i: F.when((F.length(a) == i - 1) & (F.substring("first", 1, i) == F.substring("last", 1, i)), F.substring("first", 1, i)).otherwise(a))
    return sizes.join(best, ["repo_id", "community"], "left").select(
        "repo_id", "community", F.when(F.col("n") >= F.greatest(F.lit(2), share * F.col("size")), F.col("folder")).when(F.length(prefix) >= 3, prefix).otherwise(F.concat(F.lit("Cluster_"), F.col("community").cast("string"))).alias("label")
    )


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(repo_id, modularity) of a partition: inner edges over all, less the share expected by degree; rounded to 4 places."""
    m = sorted_join(membership.select("repo_id", "id", "community"))
    total = edges.groupBy("repo_id").agg(F.count("*").alias("m"))
    both = edges.select("repo_id", F.explode(F.array("a", "b")).alias("id"))
    degree = both.join(m, ["repo_id", "id"]).groupBy("repo_id", "community").agg(F.count("*").alias("k"))
    inner = edges.join(m.select("repo_id", F.col("id").alias("a"), F.col("community").alias("ca")), ["repo_id", "a"]).join(m.select("repo_id", F.col("id").alias("b"), F.col("community").alias("cb")), ["repo_id", "b"]).where("ca = cb").groupBy("repo_id", F.col("ca").alias("community")).agg(F.count("*").alias("e"))
    parts = degree.join(sorted_join(inner), ["repo_id", "community"], "left").join(total, "repo_id")
    term = F.coalesce("e", F.lit(0)) / F.col("m") - resolution * F.pow(F.col("k") / (2 * F.col("m")), 2)
    return parts.groupBy("repo_id").agg(F.round(F.sum(term), 4).alias("modularity"))
