"""Joins of small sets by Jaccard similarity, on prefixes of sets ordered by rarity.

Of two sets with similarity t or more, the first n - ceil(t n) + 1 items of each in one order share an item. With the rarest first,
an item that many sets have stands in the prefix of few, and those few meet by size besides, so it makes no block of all that have it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _prefixes(items: DataFrame, counts: DataFrame, keys: list[str], tenths: int) -> DataFrame:
    """(keys.., id, n, item): the rarest items of each set, as many as a similar set can't miss all of."""
    of = items.join(counts, [*keys, "item"]).groupBy(*keys, "id").agg(F.sort_array(F.collect_set(F.struct("df", "item"))).alias("s")).withColumn("n", F.size("s"))
    must = F.floor((F.col("n") * tenths + 9) / 10)
    return of.select(*keys, "id", "n", F.explode(F.slice("s", F.lit(1), (F.col("n") - must + 1).cast("int"))["item"]).alias("item"))


def similar_candidates(source: DataFrame, target: DataFrame, keys: list[str], tenths: int) -> DataFrame:
    """(keys.., source_id, target_id), each once: pairs among which are all with a Jaccard similarity of tenths / 10 or more.

    source, target: keys.., id (not null), items. Null items of a set don't count; an empty or null set is like none.
    """
    if not 1 <= tenths <= 10:
        raise ValueError("tenths must be 1 to 10")
    each = lambda df: df.select(*keys, "id", F.explode("items").alias("item")).where("item is not null").distinct()
    a, b = each(source), each(target)
    counts = a.unionByName(b).groupBy(*keys, "item").agg(F.count("*").alias("df"))
    # Sizes of two similar sets differ by a factor of 10 / tenths at most, so by one step of that factor.
    step = F.floor(F.log("n") / math.log(10 / tenths) + 1e-9).cast("int") if tenths < 10 else F.col("n")
    near = F.explode(F.array(*[step + d for d in ((-1, 0, 1) if tenths < 10 else (0,))]))
    left = _prefixes(a, counts, keys, tenths).select(*keys, "item", F.col("id").alias("source_id"), F.col("n").alias("__n"), near.alias("__step"))
    right = _prefixes(b, counts, keys, tenths).select(*keys, "item", F.col("id").alias("target_id"), F.col("n").alias("__m"), step.alias("__step"))
    met = left.join(right, [*keys, "item", "__step"]).where((F.col("__m") * 10 >= F.col("__n") * tenths) & (F.col("__n") * 10 >= F.col("__m") * tenths))
    return met.select(*keys, "source_id", "target_id").distinct()


def set_links(rows: DataFrame, keys: list[str], tenths: int) -> DataFrame:
    """(keys.., id, class_id, links): the smallest id with the same set, and how many other rows have a set of similarity tenths / 10 or more.

    Equal sets are one class, and classes meet, not rows; a class links all its rows with one another. An empty or null set is a
    class of one row without links. Ids are unique within keys.
    """
    sets = rows.select(*keys, "id", F.sort_array(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("items"))
    empty = F.coalesce(F.size("items"), F.lit(0)) <= 0
    full = sets.where(~empty)
    classes = cut(full.groupBy(*keys, "items").agg(F.min("id").alias("id"), F.count("*").alias("size")))
    a = classes.select(*keys, F.col("id").alias("source_id"), F.col("items").alias("__a"))
    b = classes.select(*keys, F.col("id").alias("target_id"), F.col("items").alias("__b"), F.col("size").alias("__size"))
    pairs = similar_candidates(classes, classes, keys, tenths).where("source_id != target_id").join(a, [*keys, "source_id"]).join(b, [*keys, "target_id"])
    # As whole numbers, so that a similarity of just the bound counts.
    both = F.size(F.array_intersect("__a", "__b"))
    links = pairs.where(both * 10 >= (F.size("__a") + F.size("__b") - both) * tenths).groupBy(*keys, F.col("source_id").alias("id")).agg(F.sum("__size").alias("others"))
    each = classes.join(links, [*keys, "id"], "left").select(*keys, "items", F.col("id").alias("class_id"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    alone = sets.where(empty).select(*keys, "id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return full.join(each, [*keys, "items"]).select(*keys, "id", "class_id", "links").unionByName(alone)
