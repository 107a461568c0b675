"""Export of graphs: JSON rows, CSV lines, Cypher statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph

NODE_HEADER = "id,label,name,file_path,exported,kind,properties"
EDGE_HEADER = "id,label,start_id,end_id,source_name,target_name,properties"


def csv_cell(value: Column) -> Column:
    """Quoted only if it has a quote, a comma or a newline."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def properties(nodes: DataFrame) -> Column:
    """All properties of a vertex as JSON: promoted columns that aren't null, and the map."""
    promoted = [c for c in ("name", "file_path", "start_line", "end_line", "exported", "class_name") if c in nodes.columns]
    own = F.to_json(F.struct(*[F.col(c) for c in promoted]))
    if "props" not in nodes.columns:
        return own
    return F.when(F.size(F.coalesce("props", F.create_map().cast("map<string,string>"))) > 0, F.concat(F.regexp_replace(own, "\\}$", ""), F.when(own == "{}", "").otherwise(","), F.regexp_replace(F.to_json("props"), "^\\{", ""))).otherwise(own)


def nodes_csv(nodes: DataFrame) -> DataFrame:
    """(id, line): the lines under NODE_HEADER."""
    kind = F.col("props")["kind"] if "props" in nodes.columns else F.lit("")
    cells = [F.col("id").cast("string"), csv_cell(F.col("label")), csv_cell(F.col("name")), csv_cell(F.col("file_path")), F.coalesce(F.col("exported").cast("string"), F.lit("")), csv_cell(kind), csv_cell(properties(nodes))]
    return nodes.select("id", F.concat_ws(",", *cells).alias("line"))


def with_ends(graph: PropertyGraph) -> DataFrame:
    """Edges with label and name of both ends."""
    n = graph.nodes
    a = n.select("repo_id", F.col("id").alias("src"), F.col("label").alias("source_label"), F.coalesce("name", F.lit("")).alias("source_name"))
    b = n.select("repo_id", F.col("id").alias("dst"), F.col("label").alias("target_label"), F.coalesce("name", F.lit("")).alias("target_name"))
    return graph.edges.join(a, ["repo_id", "src"]).join(b, ["repo_id", "dst"])


def edge_properties() -> Column:
    return F.to_json(F.struct("confidence", "resolution_method", "step"))


def edges_csv(graph: PropertyGraph) -> DataFrame:
    """(id, line): the lines under EDGE_HEADER."""
    cells = [F.col("id").cast("string"), csv_cell(F.col("label")), F.col("src").cast("string"), F.col("dst").cast("string"), csv_cell(F.col("source_name")), csv_cell(F.col("target_name")), csv_cell(edge_properties())]
    return with_ends(graph).select("id", F.concat_ws(",", *cells).alias("line"))


def cypher_text(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher_map(pairs: list[tuple[str, Column, bool]]) -> Column:
    """{key: value, ..} of the pairs (key, value, is a text) whose value is neither null nor empty; nothing if all are."""
    parts = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), cypher_text(v) if text else v.cast("string"))) for k, v, text in pairs]
    body = F.concat_ws(", ", *parts)
    return F.when(body != "", F.concat(F.lit(" {"), body, F.lit("}"))).otherwise("")


def nodes_cypher(nodes: DataFrame) -> DataFrame:
    """(id, statement) that creates each vertex."""
    c = F.col
    props = cypher_map([("name", c("name"), True), ("file_path", c("file_path"), True), ("start_line", c("start_line"), False), ("end_line", c("end_line"), False), ("exported", c("exported"), False), ("class_name", c("class_name"), True)])
    return nodes.select("id", F.concat(F.lit("CREATE (:"), c("label"), props, F.lit(");")).alias("statement"))


def edges_cypher(graph: PropertyGraph) -> DataFrame:
    """(id, statement) that finds both ends by name and creates the edge."""
    c = F.col
    props = cypher_map([("confidence", c("confidence"), False), ("resolution_method", c("resolution_method"), True), ("step", c("step"), False)])
    end = lambda v, label, name: F.concat(F.lit(f"({v}:"), c(label), F.lit(" {name: "), cypher_text(c(name)), F.lit("})"))
    statement = F.concat(F.lit("MATCH "), end("a", "source_label", "source_name"), F.lit(", "), end("b", "target_label", "target_name"), F.lit(" CREATE (a)-[:"), c("label"), props, F.lit("]->(b);"))
    return with_ends(graph).select("id", statement.alias("statement"))


def write_json(graph: PropertyGraph, path: str) -> None:
    for df, name in ((graph.nodes, "nodes"), (graph.edges, "edges")):
        df.write.mode("overwrite").partitionBy("repo_id").json(f"{path}/{name}")


def project_rows(graph: PropertyGraph, cross: DataFrame) -> DataFrame:
    """One table of a whole project: kind node, edge or cross_edge, repo_id and the row as JSON."""
    rows = lambda df, kind, repo: df.select(F.lit(kind).alias("kind"), F.col(repo).alias("repo_id"), F.to_json(F.struct(*df.columns)).alias("json"))
    return rows(graph.nodes, "node", "repo_id").unionByName(rows(graph.edges, "edge", "repo_id")).unionByName(rows(cross, "cross_edge", "source_repo"))
