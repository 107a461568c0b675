"""Structural checks: layers and deny rules, interval containment, change impact and risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import glob_regex
from ..model import PropertyGraph
from .traverse import multi_source


def layer_of(path: Column, layers: list[tuple[str, str]]) -> Column:
    """The first layer (name, glob) whose glob a path matches; null if none does."""
    return F.coalesce(*[F.when(path.rlike(glob_regex(glob)), F.lit(name)) for name, glob in layers], F.lit(None).cast("string"))


def checked_rules(layers: list[tuple[str, str]], rules: list[tuple[str, list[str]]]) -> list[tuple[str, str]]:
    """Denied pairs of layers. The last rule of a layer holds; a layer that isn't declared is an error."""
    known = {n for n, _ in layers}
    last = dict(rules)
    for a, denied in last.items():
        if unknown := ({a} | set(denied)) - known:
            raise ValueError(f"unknown layer: {', '.join(sorted(unknown))}")
    return [(a, b) for a, denied in last.items() for b in denied]


def violations(links: DataFrame, layers: list[tuple[str, str]], rules: list[tuple[str, list[str]]]) -> DataFrame:
    """The links (source_file, target_file and more) that go from a layer to one denied to it, with both layers."""
    denied = checked_rules(layers, rules)
    sides = links.withColumns({"source_layer": layer_of(F.col("source_file"), layers), "target_layer": layer_of(F.col("target_file"), layers)})
    bad = reduce(lambda c, x: c | ((F.col("source_layer") == x[0]) & (F.col("target_layer") == x[1])), denied, F.lit(False))
    return sides.where(bad)


def file_links(graph: PropertyGraph) -> DataFrame:
    """Calls between symbols of different files, and imports: source_file, target_file, source_symbol, target_symbol, line, kind.

    An import has its file paths as symbols and no line.
    """
    files = graph.nodes.where(F.col("label") == "File").select("repo_id", F.col("id").alias("f"), F.col("file_path").alias("path"))
    symbols = graph.nodes.select("repo_id", F.col("id").alias("s"), "name", "start_line")
    homes = graph.edges.where(F.col("label") == "DEFINES").select("repo_id", F.col("src").alias("f"), F.col("dst").alias("s")).join(files, ["repo_id", "f"]).join(symbols, ["repo_id", "s"])
    a = homes.select("repo_id", F.col("s").alias("src"), F.col("f").alias("fa"), F.col("path").alias("source_file"), F.col("name").alias("source_symbol"), F.col("start_line").alias("line"))
    b = homes.select("repo_id", F.col("s").alias("dst"), F.col("f").alias("fb"), F.col("path").alias("target_file"), F.col("name").alias("target_symbol"))
    calls = graph.edges.where(F.col("label") == "CALLS").select("repo_id", "src", "dst").join(a, ["repo_id", "src"]).join(b, ["repo_id", "dst"]).where("fa != fb")
    fa, fb = files.select("repo_id", F.col("f").alias("src"), F.col("path").alias("source_file")), files.select("repo_id", F.col("f").alias("dst"), F.col("path").alias("target_file"))
    imports = graph.edges.where(F.col("label") == "IMPORTS").select("repo_id", "src", "dst").join(fa, ["repo_id", "src"]).join(fb, ["repo_id", "dst"])
    cols = ["source_file", "target_file", "source_symbol", "target_symbol", "line"]
    return calls.select(*cols, F.lit("CALLS").alias("kind")).unionByName(imports.select("source_file", "target_file", F.col("source_file").alias("source_symbol"), F.col("target_file").alias("target_symbol"), F.lit(None).cast("int").alias("line"), F.lit("IMPORTS").alias("kind")))


def layer_counts(paths: DataFrame, layers: list[tuple[str, str]], path: str = "file_path") -> DataFrame:
    """(layer, n): how many files each layer has; those of no layer are left out."""
    return paths.select(layer_of(F.col(path), layers).alias("layer")).where("layer is not null").groupBy("layer").agg(F.count("*").alias("n"))


#: Lines that share a bucket of spans.
BUCKET = 128


def enclosing(points: DataFrame, spans: DataFrame, keys: list[str], point: str = "line", id_col: str = "point_id") -> DataFrame:
    """Each point with the shortest span (span_id, start_line, end_line) of the same keys that holds it; equal ones by start, then id.

    A point in no span is left out. Lines that have points and the first span of each extent meet, each once, on the keys
    and a bucket of lines, of which a span has few: many points on a line or many equal spans make no product.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    extents = spans.where("start_line <= end_line").groupBy(*keys, "start_line", "end_line").agg(F.min("span_id").alias("span_id"))
    parts = extents.withColumn("__bucket", F.explode(F.sequence(bucket("start_line"), bucket("end_line"))))
    each = points.select(*keys, id_col, point).distinct()
    held = each.select(*keys, point).distinct().withColumn("__bucket", bucket(point)).join(parts, [*keys, "__bucket"]).where(F.col(point).between(F.col("start_line"), F.col("end_line")))
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "start_line", "span_id", "end_line"))
    found = held.groupBy(*keys, point).agg(best.alias("b")).select(*keys, point, F.col("b.span_id").alias("span_id"), F.col("b.size").alias("size"))
    return each.join(found, [*keys, point]).select(*keys, id_col, point, "span_id", "size")


def merged_ranges(lines: DataFrame, keys: list[str], line: str = "line", gap: int = 3) -> DataFrame:
    """(keys.., first, last): runs of lines of a key that are at most gap apart."""
    w = Window.partitionBy(*keys).orderBy(line)
    distinct = lines.select(*keys, line).distinct()
    breaks = distinct.withColumn("new", (F.coalesce(F.col(line) - F.lag(line).over(w), F.lit(gap + 1)) > gap).cast("int"))
    runs = breaks.withColumn("run", F.sum("new").over(w))
    return runs.groupBy(*keys, "run").agg(F.min(line).alias("first"), F.max(line).alias("last")).drop("run")


#: Labels that a change in a file can touch.
CHANGED_LABELS = ("Function", "Class", "Interface", "Method", "CodeElement", "RouteHandler", "Struct", "Enum", "Trait", "TypeAlias", "Namespace")


def direct_symbols(symbols: DataFrame, ranges: DataFrame, keys: list[str], line: str = "start_line", near: int = 5) -> DataFrame:
    """The symbols whose line is within near of a range of their keys, each once: a band join on the keys."""
    r = ranges.select(*[F.col(k).alias(f"__{k}") for k in keys], "first", "last")
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys])
    return symbols.join(r, same & F.col(line).between(F.col("first") - near, F.col("last") + near), "left_semi")


def change_impact(graph: PropertyGraph, ranges: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(direct symbols, callers within depth as node, depth, via, affected processes) of changed ranges (repo_id, file_path, first, last)."""
    direct = direct_symbols(graph.nodes.where(F.col("label").isin(*CHANGED_LABELS)), ranges, ["repo_id", "file_path"])
    roots = direct.select(F.col("id").alias("node"))
    calls = graph.edges.where(F.col("label") == "CALLS").select("src", "dst")
    indirect = multi_source(calls, roots, depth)
    touched = roots.unionByName(indirect.select("node")).distinct()
    steps = graph.edges.where(F.col("label") == "STEP_IN_PROCESS").select(F.col("src").alias("node"), F.col("dst").alias("process"))
    processes = steps.join(touched, "node", "left_semi").select("process").distinct()
    return direct, indirect, processes


def risk(affected: Column, processes: Column) -> Column:
    return F.when((affected > 20) | (processes > 3), "CRITICAL").when((affected > 10) | (processes > 1), "HIGH").when(affected > 3, "MEDIUM").otherwise("LOW")
