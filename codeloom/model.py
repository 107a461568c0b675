"""The property graph: vertices and edges of all repositories in two DataFrames.

One partition key, repo_id, takes the place of a graph for each repository. Properties
that operators use are columns; the rest are a map. An absent label is no error, it
matches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_SCHEMA = T.StructType(
    [
        T.StructField("repo_id", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("exported", T.BooleanType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("props", T.MapType(T.StringType(), T.StringType())),
    ]
)
EDGE_SCHEMA = T.StructType(
    [
        T.StructField("repo_id", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("resolution_method", T.StringType()),
        T.StructField("step", T.IntegerType()),
    ]
)
#: The vocabulary of the graph.
NODE_LABELS = ("File", "Folder", "Function", "Class", "Interface", "Method", "CodeElement", "RouteHandler", "Struct", "Enum", "Trait", "TypeAlias", "Namespace", "Community", "Process")
EDGE_LABELS = ("CONTAINS", "DEFINES", "EXPOSES", "IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "OVERRIDES", "HANDLES", "MEMBER_OF", "STEP_IN_PROCESS")
REACHING_LABELS = ("CALLS", "EXTENDS", "IMPLEMENTS")
SYMBOL_LABELS = ("Function", "Class", "Interface", "Method", "CodeElement")


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    def repo(self, repo_id: str) -> "PropertyGraph":
        """The graph of one repository; the filter prunes partitions."""
        return PropertyGraph(self.nodes.where(F.col("repo_id") == repo_id), self.edges.where(F.col("repo_id") == repo_id))

    def write(self, path: str) -> None:
        for part, name in ((self.nodes, "nodes"), (self.edges, "edges")):
            part.write.mode("overwrite").partitionBy("repo_id", "label").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "PropertyGraph":
        return cls(*(spark.read.schema(s).parquet(f"{path}/{n}") for s, n in ((NODE_SCHEMA, "nodes"), (EDGE_SCHEMA, "edges"))))

    def create_views(self, prefix: str = "") -> None:
        self.nodes.createOrReplaceTempView(f"{prefix}nodes")
        self.edges.createOrReplaceTempView(f"{prefix}edges")


def drop_repo(graph: PropertyGraph, repo_id: str) -> PropertyGraph:
    """The graph without a repository's partition."""
    return PropertyGraph(graph.nodes.where(F.col("repo_id") != repo_id), graph.edges.where(F.col("repo_id") != repo_id))


def repo_exists(graph: PropertyGraph, repo_id: str) -> bool:
    return not graph.nodes.where(F.col("repo_id") == repo_id).isEmpty()


def append(graph: PropertyGraph, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> PropertyGraph:
    """Vertices and edges added; columns that they lack are null."""
    return PropertyGraph(
        graph.nodes if nodes is None else graph.nodes.unionByName(nodes, allowMissingColumns=True),
        graph.edges if edges is None else graph.edges.unionByName(edges, allowMissingColumns=True),
    )


def stable_id(*columns: Column | str) -> Column:
    """An id that depends on the natural key alone."""
    return F.xxhash64(*columns)
