"""Names alike by edit distance, found through shared segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.patterns import edit_similarity
from ..session import cut_anew as cut
from ..session import ship


def _allowed(longest: int, least: float) -> int:
    """Edits that leave two names, the longer of so many letters, a similarity of `least`."""
    return int((1 - least) * longest + 1e-9)


def _cut(length: int, n: int) -> list[tuple[int, int]]:
    """Start and length of n segments; the last ones are a letter longer where n doesn't divide."""
    base, longer = divmod(length, n)
    return [(i * base + max(0, i - (n - longer)), base + (i >= n - longer)) for i in range(n)]


def segments(name: str, partners: list[int], least: float) -> Iterator[tuple[bool, int, int, int, str]]:
    """(as the longer, longer, shorter, place, text) under which a name meets those of the lengths `partners`.

    As the shorter one it gives its segments; as the longer one the parts at which a partner's segments may stand: the
    i-th is moved by at most the edits before it, and by what the edits after it leave.
    """
    n = len(name)
    for m in partners:
        edits = _allowed(max(n, m), least)
        if abs(n - m) > edits:
            continue
        if m >= n:
            for i, (start, size) in enumerate(_cut(n, edits + 1)):
                yield False, m, n, i, name[start : start + size]
        if m <= n:
            for i, (start, size) in enumerate(_cut(m, edits + 1)):
                moved = start + n - m
                low, high = max(start - i, moved - (edits - i), 0), min(start + i, moved + (edits - i), n - size)
                for text in {name[p : p + size] for p in range(low, high + 1)}:
                    yield True, n, m, i, text


def _met(names: DataFrame, keys: list[str], column: str, partners: str, least: float, second: bool) -> DataFrame:
    """names with their segments. Pairs whose longer name is of the second side, or neither, are of kind 0, others of kind 1."""
    fields = [names.schema[c] for c in (*keys, column)]
    schema = StructType([*fields, *(StructField(c, IntegerType()) for c in ("kind", "longer", "shorter", "place")), StructField("text", StringType())])

    def run(batches):
        for b in batches:
            rows, found = [], []
            for i, (name, lengths) in enumerate(zip(b.column(column).to_pylist(), b.column(partners).to_pylist(), strict=True)):
                for longer, n, m, place, text in segments(name, lengths, least):
                    if n > m or longer == second:
                        rows.append(i)
                        found.append((0 if longer == second else 1, n, m, place, text))
            at = pa.array(rows, pa.int64())
            parts = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (*[pa.int32()] * 4, pa.string()), strict=True)] if found else [pa.array([], pa.int32())] * 4 + [pa.array([], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in (*keys, column)), *parts], names=schema.names)

    ship(names.sparkSession)
    return names.mapInArrow(run, schema)


def similar_names(left: DataFrame, right: DataFrame, keys: list[str], least: float = 0.7) -> DataFrame:
    """(keys.., a, b, similarity) of all pairs, a of left and b of right, without case, whose edit similarity is `least` or more.

    Of two names within d edits, one cut into d + 1 segments, one segment stands in the other unchanged, near its
    place. So names meet on a segment, its place and both lengths, and no name meets all others of its key. left has keys and
    a, right keys and b; repeats don't matter. A null name is like no other.
    """
    if not 0.5 < least <= 1:
        raise ValueError("least must be above 0.5: below, a name may share no letter with one like it")
    # Both sides are read several times; distinct names are few beside what they come from.
    a = cut(left.where("a is not null").select(*keys, "a", F.lower("a").alias("x")).distinct())
    b = cut(right.where("b is not null").select(*keys, "b", F.lower("b").alias("y")).distinct())
    # Lengths that occur, so that keys are made for those only: one row of small numbers for each key.
    sizes = lambda df, name, out: df.groupBy(*keys).agg(F.array_sort(F.collect_set(F.length(name))).alias(out))
    both = sizes(a, "x", "in_a").join(sizes(b, "y", "in_b"), keys) if keys else sizes(a, "x", "in_a").join(sizes(b, "y", "in_b"), F.lit(True))
    spread = lambda df, name: (df.select(*keys, name).distinct().join(both, keys) if keys else df.select(name).distinct().join(both, F.lit(True)))
    meet = [*keys, "kind", "longer", "shorter", "place", "text"]
    met = _met(spread(a, "x"), keys, "x", "in_b", least, False).join(_met(spread(b, "y"), keys, "y", "in_a", least, True), meet).select(*keys, "x", "y").distinct()
    near = met.withColumn("similarity", edit_similarity(F.col("x"), F.col("y"))).where(F.col("similarity") >= least)
    return near.join(a, [*keys, "x"]).join(b, [*keys, "y"]).select(*keys, "a", "b", "similarity")


def name_links(names: DataFrame, keys: list[str], least: float = 0.7) -> DataFrame:
    """(keys.., name, links): how many other names of its key each name is like; no pairs leave the operator."""
    pairs = similar_names(names.select(*keys, F.col("name").alias("a")), names.select(*keys, F.col("name").alias("b")), keys, least).where("a != b")
    counts = pairs.groupBy(*keys, F.col("a").alias("name")).agg(F.count("*").alias("links"))
    return names.select(*keys, "name").distinct().join(counts, [*keys, "name"], "left").na.fill(0, ["links"])
