"""From file contents to a property graph: structure, symbols, imports, calls, inheritance, routes, communities, processes.

Each phase is a DataFrame over the ones before; nothing is written row by row, and a
phase that is kept in the shared folder can be resumed from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph, stable_id
from ..operators import community, process, resolve
from ..session import cut, cut_anew
from ..sources import code, files


def _node(df: DataFrame, **columns) -> DataFrame:
    names = ("repo_id", "id", "label", "name", "file_path", "start_line", "end_line", "exported", "class_name")
    kinds = ("string", "long", "string", "string", "string", "int", "int", "boolean", "string")
    cells = [columns.get(n, F.col(n) if n == "repo_id" else F.lit(None)).cast(k).alias(n) for n, k in zip(names, kinds)]
    return df.select(*cells, columns.get("props", F.lit(None)).cast("map<string,string>").alias("props"))


def file_id(path="file_path") -> F.Column:
    return stable_id(F.col("repo_id"), F.lit("File"), F.col(path))


def build(contents: DataFrame, aliases: dict[str, str] | None = None, module: str = "") -> PropertyGraph:
    """The graph of contents (repo_id, file_path, language, content)."""
    c = F.col
    # What is extracted is kept, so that texts are parsed once, and its size unknown to the planner: by that of the texts' own
    # table, which is read compressed, it would be sent whole to the driver and from there to every executor.
    listed = cut_anew(contents.select("repo_id", "file_path", "language"))
    folder_id = lambda p: stable_id(c("repo_id"), F.lit("Folder"), c(p))
    dirs = _node(files.folders(listed), id=folder_id("path"), label=F.lit("Folder"), name=c("name"), file_path=c("path"))
    leaves = _node(listed, id=file_id(), label=F.lit("File"), name=files.base_name(c("file_path")), file_path=c("file_path"), props=F.create_map(F.lit("language"), c("language")))

    found = code.symbols(contents)
    symbol_id = stable_id(c("repo_id"), c("kind"), c("file_path"), c("name"), c("start_line"))
    extra = F.create_map(*[x for k in ("params", "signature", "decorators", "visibility", "element_type") for x in (F.lit(k), c(k))])
    symbols = cut_anew(_node(found, id=symbol_id, label=c("kind"), name=c("name"), file_path=c("file_path"), start_line=c("start_line"), end_line=c("end_line"), exported=c("exported"), class_name=c("class_name"), props=F.map_filter(extra, lambda k, v: v != "")).dropDuplicates(["repo_id", "id"]))
    handlers = cut_anew(code.routes(contents))
    route_id = stable_id(c("repo_id"), F.lit("RouteHandler"), c("file_path"), c("http_method"), c("url_pattern"), c("start_line"))
    route_props = F.create_map(*[x for k in ("http_method", "url_pattern", "framework", "handler_name") for x in (F.lit(k), c(k))])
    routes = _node(handlers, id=route_id, label=F.lit("RouteHandler"), file_path=c("file_path"), start_line=c("start_line"), props=route_props)

    def edge(df: DataFrame, label, src, dst, confidence=None, method=None) -> DataFrame:
        none = F.lit(None)
        return df.select("repo_id", stable_id(F.lit("edge"), c("repo_id"), label, src, dst).alias("id"), label.alias("label"), src.cast("long").alias("src"), dst.cast("long").alias("dst"), (none if confidence is None else confidence).cast("double").alias("confidence"), (none if method is None else method).cast("string").alias("resolution_method"), none.cast("int").alias("step"))

    inside = files.contains_edges(listed)
    contains = edge(inside, F.lit("CONTAINS"), folder_id("parent"), F.when(c("kind") == "File", stable_id(c("repo_id"), F.lit("File"), c("child"))).otherwise(folder_id("child")))
    defines = edge(symbols, F.lit("DEFINES"), file_id(), c("id"))
    exposes = edge(routes, F.lit("EXPOSES"), file_id(), c("id"))
    links = cut_anew(resolve.resolved_imports(cut_anew(code.imports(contents, aliases, module)), listed))
    imports = edge(links, F.lit("IMPORTS"), file_id(), file_id("target_path"))

    sites = cut_anew(code.calls(contents).withColumn("call_id", F.xxhash64("file_path", "line", "callee_name", "qualifier", "caller_name")))
    types = cut_anew(code.property_types(contents).drop("file_path").dropDuplicates(["repo_id", "class_name", "property"]))
    resolved = cut_anew(resolve.resolved_calls(cut_anew(resolve.callers(sites, symbols)), symbols, links, types))
    calls = edge(resolved.groupBy("repo_id", "src", "dst").agg(F.max(F.struct("confidence", "resolution_method")).alias("m")), F.lit("CALLS"), c("src"), c("dst"), c("m.confidence"), c("m.resolution_method"))
    up = cut_anew(resolve.inheritance_edges(cut_anew(code.inheritance(contents)), symbols, links))
    parents = edge(up, c("label"), c("src"), c("dst"))
    overrides = edge(resolve.override_edges(symbols, up), c("label"), c("src"), c("dst"))
    handles = edge(resolve.handler_edges(routes.select("repo_id", "id", "file_path", "start_line", c("props")["handler_name"].alias("handler_name")), symbols), c("label"), c("src"), c("dst"), c("confidence"))
    edges = reduce(DataFrame.unionByName, [contains, defines, exposes, imports, calls, parents, overrides, handles])
    return PropertyGraph(reduce(DataFrame.unionByName, [dirs, leaves, symbols, routes]), edges)


def with_analytics(graph: PropertyGraph, large: int = community.LARGE) -> PropertyGraph:
    """The graph with Community and Process vertices, MEMBER_OF and STEP_IN_PROCESS edges. In repositories of over large vertices, those of one call are in no community."""
    c = F.col
    symbols = graph.nodes.where("name is not null")
    calls = cut(graph.edges.where("label = 'CALLS'"))
    pairs = cut(community.input_edges(calls, large=large))
    members = cut(community.kept_communities(community.communities(pairs, large), symbols))
    community_id = stable_id(c("repo_id"), F.lit("Community"), c("community"))
    words = community.keywords(members).groupBy("repo_id", "community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ",").alias("keywords"))
    facts = members.groupBy("repo_id", "community").agg(F.first("symbol_count").alias("n")).join(community.labels(members), ["repo_id", "community"]).join(community.cohesion(pairs, members), ["repo_id", "community"], "left").join(words, ["repo_id", "community"], "left")
    props = F.create_map(F.lit("community_id"), F.concat(F.lit("community_"), c("community").cast("string")), F.lit("symbol_count"), c("n").cast("string"), F.lit("cohesion"), c("cohesion").cast("string"), F.lit("keywords"), c("keywords"))
    groups = _node(facts, id=community_id, label=F.lit("Community"), name=c("label"), props=props)
    found = process.distinct_processes(process.traces(calls, process.entry_points(symbols, calls)))
    found = cut(process.typed_processes(found, symbols, members))
    process_id = stable_id(c("repo_id"), F.lit("Process"), c("path"))
    flows = _node(found, id=process_id, label=F.lit("Process"), name=c("label"), props=F.create_map(F.lit("process_type"), c("process_type"), F.lit("step_count"), c("steps").cast("string")))
    none = F.lit(None)

    def edge(df, label, src, dst, step=none):
        return df.select("repo_id", stable_id(F.lit("edge"), c("repo_id"), F.lit(label), src, dst, step).alias("id"), F.lit(label).alias("label"), src.alias("src"), dst.alias("dst"), none.cast("double").alias("confidence"), none.cast("string").alias("resolution_method"), step.cast("int").alias("step"))

    member_of = edge(members, "MEMBER_OF", c("id"), community_id)
    steps = edge(process.process_steps(found), "STEP_IN_PROCESS", c("id"), process_id, c("step"))
    return PropertyGraph(graph.nodes.unionByName(groups).unionByName(flows), graph.edges.unionByName(member_of).unionByName(steps))


def community_list(graph: PropertyGraph) -> DataFrame:
    """Communities by symbol count, equal ones by id."""
    return graph.nodes.where("label = 'Community'").withColumn("symbol_count", F.col("props")["symbol_count"].cast("int")).orderBy(F.desc("symbol_count"), "id")


def process_list(graph: PropertyGraph, process_type: str | None = None) -> DataFrame:
    """Processes by step count, equal ones by id, of one type only if that is given."""
    out = graph.nodes.where("label = 'Process'").withColumns({"step_count": F.col("props")["step_count"].cast("int"), "process_type": F.col("props")["process_type"]})
    return (out if process_type is None else out.where(F.col("process_type") == process_type)).orderBy(F.desc("step_count"), "id")


def members_of(graph: PropertyGraph, community_id: int) -> DataFrame:
    ids = graph.edges.where((F.col("label") == "MEMBER_OF") & (F.col("dst") == community_id)).select("repo_id", F.col("src").alias("id"))
    return graph.nodes.join(ids, ["repo_id", "id"], "left_semi")


def steps_of(graph: PropertyGraph, process_id: int) -> DataFrame:
    ids = graph.edges.where((F.col("label") == "STEP_IN_PROCESS") & (F.col("dst") == process_id)).select("repo_id", F.col("src").alias("id"), "step")
    return graph.nodes.join(ids, ["repo_id", "id"]).orderBy("step")
