"""Rename plans: candidates, references, whole-word positions and edits."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..session import ship

MIN_CONFIDENCE, NEAR = 0.8, 5


def candidates(graph: PropertyGraph, name: str, file_path: str | None = None, label: str | None = None) -> DataFrame:
    """Defined symbols of a name. More than one without a filter is ambiguous, which the caller sees from the count."""
    out = graph.nodes.where(F.col("name") == name).join(graph.edges.where(F.col("label") == "DEFINES").select("repo_id", F.col("dst").alias("id")), ["repo_id", "id"], "left_semi")
    if file_path is not None:
        out = out.where(F.col("file_path") == file_path)
    return out if label is None else out.where(F.col("label") == label)


def references(graph: PropertyGraph, symbol_id: int) -> DataFrame:
    """(repo_id, file_path, line, kind, confidence): where a symbol's name may stand. Line 0 asks for the whole file.

    Definition 1.0, importing files 0.95, subclasses 0.95, callers 0.9, overriding and
    overridden methods 0.9. Of rows with one file, line and kind the most confident stays.
    """
    nodes = graph.nodes.select("repo_id", "id", "file_path", F.coalesce("start_line", F.lit(0)).alias("line"))
    me = nodes.where(F.col("id") == symbol_id)
    edges = graph.edges.select("repo_id", "label", "src", "dst")
    at = lambda found, kind, confidence: found.join(nodes, ["repo_id", "id"]).select("repo_id", "file_path", "line", F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
    into = lambda *labels: edges.where(F.col("label").isin(*labels) & (F.col("dst") == symbol_id)).select("repo_id", F.col("src").alias("id"))
    out = edges.where((F.col("label") == "OVERRIDES") & (F.col("src") == symbol_id)).select("repo_id", F.col("dst").alias("id"))
    home = edges.where((F.col("label") == "DEFINES") & (F.col("dst") == symbol_id)).select("repo_id", F.col("src").alias("dst"))
    importers = edges.where(F.col("label") == "IMPORTS").select("repo_id", "src", "dst").join(home, ["repo_id", "dst"], "left_semi").select("repo_id", F.col("src").alias("id")).distinct()
    parts = [
        me.select("repo_id", "file_path", "line", F.lit("definition").alias("kind"), F.lit(1.0).alias("confidence")),
        at(into("CALLS"), "call", 0.9),
        at(importers, "import", 0.95).withColumn("line", F.lit(0)),
        at(into("EXTENDS", "IMPLEMENTS"), "inheritance", 0.95),
        at(into("OVERRIDES").unionByName(out), "override", 0.9),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("repo_id", "file_path", "line", "kind").agg(F.max("confidence").alias("confidence"))


def positions(refs: DataFrame, contents: DataFrame, name: str, near: int = NEAR) -> DataFrame:
    """refs with the line and columns (from 1, end exclusive) of whole-word occurrences of name.

    A reference with a line takes the occurrence on the closest line within near, the
    first on a tie; one with line 0 takes all of the file.
    """
    word = f"(?<![\\p{{L}}\\p{{N}}_$]){re.escape(name)}(?![\\p{{L}}\\p{{N}}_$])"
    files = contents.where(F.col("content").contains(name)).join(refs.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_semi")
    lines = files.select("repo_id", "file_path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).where(F.col("text").rlike(word))
    # What stands before each occurrence gives its column.
    before = F.split("text", word)
    starts = F.transform(F.sequence(F.lit(1), F.size(before) - 1), lambda i: F.length(F.array_join(F.slice(before, F.lit(1), i), name)) + 1)
    each = lines.select("repo_id", "file_path", (F.col("pos") + 1).alias("at_line"), F.explode(starts).alias("start_column"))
    met = refs.join(each, ["repo_id", "file_path"]).where((F.col("line") == 0) | (F.abs(F.col("at_line") - F.col("line")) <= near))
    close = Window.partitionBy("repo_id", "file_path", "line", "kind").orderBy(F.abs(F.col("at_line") - F.col("line")), "at_line", "start_column")
    out = met.withColumn("rank", F.row_number().over(close)).where((F.col("line") == 0) | (F.col("rank") == 1))
    return out.select("repo_id", "file_path", "kind", "confidence", F.col("at_line").alias("line_number"), "start_column", (F.col("start_column") + len(name)).alias("end_column"))


def edits(found: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """Positions that are confident enough, each place once with its highest confidence; most confident first."""
    out = found.where(F.col("confidence") >= least).groupBy("repo_id", "file_path", "line_number", "start_column", "end_column").agg(F.max("confidence").alias("confidence"))
    return out.orderBy(F.desc("confidence"), "repo_id", "file_path", "line_number", "start_column")


def applied(plan: DataFrame, contents: DataFrame, new_name: str) -> DataFrame:
    """(repo_id, file_path, content) of the files that change; edits are made from the end of a file to its start."""
    places = plan.groupBy("repo_id", "file_path").agg(F.sort_array(F.collect_list(F.struct("line_number", "start_column", "end_column")), asc=False).alias("places"))
    rows = contents.select("repo_id", "file_path", "content").join(places, ["repo_id", "file_path"])

    def work(batches):
        for b in batches:
            out = []
            for text, places_ in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                lines = text.split("\n")
                for p in places_:
                    i = p["line_number"] - 1
                    lines[i] = lines[i][: p["start_column"] - 1] + new_name + lines[i][p["end_column"] - 1 :]
                out.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["repo_id", "file_path", "content"])

    ship(rows.sparkSession)
    return rows.mapInArrow(work, "repo_id string, file_path string, content string")
