"""Graphs, contents and histories made of the driver tables, each as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..session import sorted_join

REPO = "tpch"
#: p_type -> label of the symbol that a part stands for.
LABELS = {"STANDARD": "Function", "MEDIUM": "Class", "PROMO": "Interface", "LARGE": "Method", "SMALL": "CodeElement", "ECONOMY": "Struct"}
#: Edge label -> line numbers of an urgent order whose parts it links.
STEPS = {"CALLS": (1, 2), "EXTENDS": (2, 3), "IMPLEMENTS": (3, 4)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    """repo_id, id, label, src, dst, confidence between parts of urgent orders."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount").join(sorted_join(urgent), "l_orderkey", "left_semi")
    parts = []
    for label in labels:
        a, b = STEPS[label]
        left = items.where(F.col("l_linenumber") == a).select("l_orderkey", F.col("l_partkey").alias("src"), "l_discount")
        right = items.where(F.col("l_linenumber") == b).select("l_orderkey", F.col("l_partkey").alias("dst"))
        pairs = left.join(sorted_join(right), "l_orderkey").where("src != dst").groupBy("src", "dst").agg(F.round(0.4 + 0.6 * F.avg(1 - 10 * F.col("l_discount")), 4).alias("confidence"))
        parts.append(pairs.withColumn("label", F.lit(label)))
    rank = F.when(F.col("label") == "CALLS", 0).when(F.col("label") == "EXTENDS", 1).otherwise(2)
    return reduce(DataFrame.unionByName, parts).select(F.lit(REPO).alias("repo_id"), ((rank * 10**6 + F.col("src")) * 10**6 + F.col("dst")).cast("long").alias("id"), "label", "src", "dst", "confidence", F.lit("derived").alias("resolution_method"), F.lit(None).cast("int").alias("step"))


def edges_sql(labels: tuple[str, ...] = ("CALLS",)) -> str:
    """CTE text: edges(id, label, src, dst, confidence)."""
    parts = " UNION ALL ".join(
        f"""SELECT '{label}' AS label, a.l_partkey AS src, b.l_partkey AS dst, round(0.4 + 0.6 * avg(1 - 10 * a.l_discount), 4) AS confidence
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey JOIN orders o ON o.o_orderkey = a.l_orderkey
        WHERE a.l_linenumber = {STEPS[label][0]} AND b.l_linenumber = {STEPS[label][1]} AND o.o_orderpriority = '1-URGENT' AND a.l_partkey <> b.l_partkey
        GROUP BY a.l_partkey, b.l_partkey"""
        for label in labels
    )
    return f"edges AS (SELECT CAST(((CASE label WHEN 'CALLS' THEN 0 WHEN 'EXTENDS' THEN 1 ELSE 2 END) * 1000000 + src) * 1000000 + dst AS BIGINT) AS id, * FROM ({parts}))"


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: name, label by type, exported by an even size, file by brand, lines from size."""
    label = F.coalesce(*[F.when(F.col("p_type") == k, v) for k, v in LABELS.items()], F.lit("TypeAlias"))
    return table(spark, sf_dir, "part").select(
        F.lit(REPO).alias("repo_id"), F.col("p_partkey").alias("id"), label.alias("label"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"),
        (F.col("p_size") % 2 == 0).alias("exported"), F.lit(None).cast("string").alias("class_name"), F.lit(None).cast("map<string,string>").alias("props"),
    )


NODES_SQL = (
    "nodes AS (SELECT p_partkey AS id, CASE p_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())
    + " ELSE 'TypeAlias' END AS label, p_name AS name, p_brand AS file_path, p_size AS start_line, p_size + 10 AS end_line, p_size % 2 = 0 AS exported FROM part)"
)


def part_graph(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = ("CALLS",)) -> PropertyGraph:
    return PropertyGraph(part_nodes(spark, sf_dir), part_edges(spark, sf_dir, labels))


#: The rule for a root that has callers and callees: most on the weaker side, most in all, smallest id.
ROOT_SQL = """root AS (SELECT id FROM (SELECT id, sum(o) AS o, sum(i) AS i FROM (
    SELECT src AS id, 1 AS o, 0 AS i FROM edges WHERE label = 'CALLS' UNION ALL SELECT dst, 0, 1 FROM edges WHERE label = 'CALLS') GROUP BY id)
    WHERE least(o, i) > 0 ORDER BY least(o, i) DESC, o + i DESC, id LIMIT 1)"""


def root(edges: DataFrame) -> int:
    """One id comes to the driver."""
    from ..operators.listing import degrees

    d = degrees(edges.where("label = 'CALLS'")).where("out_degree > 0 and in_degree > 0")
    return d.orderBy(F.desc(F.least("out_degree", "in_degree")), F.desc(F.col("out_degree") + F.col("in_degree")), "id").select("id").first()[0]


def trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions contain nations (folders, files), nations define customers and suppliers (functions, methods), customers call suppliers they order from; a nation imports those its customers call."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    path = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_regionkey", "n_name", F.concat_ws("/", "r_name", "n_name").alias("path"))

    def node(df, id_, label, name, file_path, exported):
        return df.select(F.lit(REPO).alias("repo_id"), id_.cast("long").alias("id"), F.lit(label).alias("label"), name.alias("name"), file_path.alias("file_path"), F.lit(None).cast("int").alias("start_line"), exported.alias("exported"))

    c = F.col
    nodes = (
        node(region, c("r_regionkey") + 1, "Folder", c("r_name"), c("r_name"), F.lit(False))
        .unionByName(node(path, c("n_nationkey") + 100, "File", c("n_name"), c("path"), F.lit(False)))
        .unionByName(node(customer.join(path, c("c_nationkey") == c("n_nationkey")), c("c_custkey") + 10**6, "Function", c("c_name"), c("path"), c("c_acctbal") > 0))
        .unionByName(node(supplier.join(path, c("s_nationkey") == c("n_nationkey")), c("s_suppkey") + 10**8, "Method", c("s_name"), c("path"), c("s_acctbal") > 0))
    )
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), c("o_orderkey") == c("l_orderkey")).where("o_orderpriority = '1-URGENT'").select("o_custkey", "l_suppkey").distinct()
    sided = bought.join(customer.select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey")).join(supplier.select("s_suppkey", "s_nationkey"), c("l_suppkey") == c("s_suppkey"))

    def edge(df, label, src, dst):
        return df.select(F.lit(REPO).alias("repo_id"), F.lit(label).alias("label"), src.cast("long").alias("src"), dst.cast("long").alias("dst")).distinct()

    edges = (
        edge(nation, "CONTAINS", c("n_regionkey") + 1, c("n_nationkey") + 100)
        .unionByName(edge(customer, "DEFINES", c("c_nationkey") + 100, c("c_custkey") + 10**6))
        .unionByName(edge(supplier, "DEFINES", c("s_nationkey") + 100, c("s_suppkey") + 10**8))
        .unionByName(edge(sided, "CALLS", c("o_custkey") + 10**6, c("l_suppkey") + 10**8))
        .unionByName(edge(sided.where("c_nationkey < s_nationkey"), "IMPORTS", c("c_nationkey") + 100, c("s_nationkey") + 100))
    )
    edges = edges.withColumns({"id": F.xxhash64("label", "src", "dst"), "confidence": F.lit(1.0), "resolution_method": F.lit("derived"), "step": F.lit(None).cast("int")})
    return PropertyGraph(nodes, edges)


TRADE_SQL = """
paths AS (SELECT n_nationkey, n_regionkey, n_name, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, 'Folder' AS label, r_name AS name, r_name AS file_path, FALSE AS exported FROM region
    UNION ALL SELECT n_nationkey + 100, 'File', n_name, path, FALSE FROM paths
    UNION ALL SELECT c_custkey + 1000000, 'Function', c_name, path, c_acctbal > 0 FROM customer JOIN paths ON c_nationkey = n_nationkey
    UNION ALL SELECT s_suppkey + 100000000, 'Method', s_name, path, s_acctbal > 0 FROM supplier JOIN paths ON s_nationkey = n_nationkey),
bought AS (SELECT DISTINCT o_custkey, l_suppkey, c_nationkey, s_nationkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderpriority = '1-URGENT'),
edges AS (SELECT 'CONTAINS' AS label, CAST(n_regionkey + 1 AS BIGINT) AS src, CAST(n_nationkey + 100 AS BIGINT) AS dst FROM nation
    UNION SELECT 'DEFINES', c_nationkey + 100, c_custkey + 1000000 FROM customer
    UNION SELECT 'DEFINES', s_nationkey + 100, s_suppkey + 100000000 FROM supplier
    UNION SELECT 'CALLS', o_custkey + 1000000, l_suppkey + 100000000 FROM bought
    UNION SELECT 'IMPORTS', c_nationkey + 100, s_nationkey + 100 FROM bought WHERE c_nationkey < s_nationkey)"""


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: repository by source, path lang/doc_<id>.txt."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), F.concat(F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("lang").alias("language"), F.col("text").alias("content"), "doc_id")


CONTENTS_SQL = "contents AS (SELECT source AS repo_id, lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS file_path, lang AS language, text AS content, doc_id FROM documents)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits: file by user, author by type, change by its first letter."""
    return table(spark, sf_dir, "events").select(
        F.lit(REPO).alias("repo_id"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("file_path"), F.col("event_id").cast("string").alias("commit_sha"), F.col("event_type").alias("author_name"), F.lit("").alias("author_email"),
        F.col("ts").alias("commit_date"), F.col("props").alias("commit_message"), F.upper(F.substring("event_type", 1, 1)).alias("change_type"),
    )


HISTORY_SQL = "history AS (SELECT 'user_' || CAST(user_id AS VARCHAR) AS file_path, CAST(event_id AS VARCHAR) AS commit_sha, event_type AS author_name, ts AS commit_date, upper(substr(event_type, 1, 1)) AS change_type FROM events)"


def cross_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between regions: from the nation of a customer to that of a supplier of another region, for urgent orders."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).where("l_linenumber = 1")
    sided = urgent.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("c_nationkey", "s_nationkey", "l_returnflag").distinct()
    a = places.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("source_node"), F.col("r_name").alias("source_repo"))
    b = places.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("target_node"), F.col("r_name").alias("target_repo"))
    kind = F.when(F.col("l_returnflag") == "A", "CROSS_REPO_CALLS").when(F.col("l_returnflag") == "N", "CROSS_REPO_IMPORTS").otherwise("CROSS_REPO_DEPENDS")
    return sided.join(a, "c_nationkey").join(b, "s_nationkey").where("source_repo != target_repo").select("source_repo", "source_node", "target_repo", "target_node", kind.alias("edge_type"))


CROSS_SQL = """places AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
cross_edges AS (SELECT a.r_name AS source_repo, a.n_name AS source_node, b.r_name AS target_repo, b.n_name AS target_node,
    CASE l_returnflag WHEN 'A' THEN 'CROSS_REPO_CALLS' WHEN 'N' THEN 'CROSS_REPO_IMPORTS' ELSE 'CROSS_REPO_DEPENDS' END AS edge_type
    FROM (SELECT DISTINCT c_nationkey, s_nationkey, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderpriority = '1-URGENT' AND l_linenumber = 1) x
    JOIN places a ON a.n_nationkey = c_nationkey JOIN places b ON b.n_nationkey = s_nationkey WHERE a.r_name <> b.r_name)"""
