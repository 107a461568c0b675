"""Steps whose work must grow with their rows: what many rows have in common makes no product and no single task."""

from __future__ import annotations

import random

import pytest
from plan_rows import most_rows, nodes_of

from codeloom import session
from codeloom.operators import community, crossrepo, product, resolve, structure
from codeloom.plans import build, catalogue, inputs
from codeloom.sources import gitlog


def test_calls_through_a_property_meet_one_method(spark):
    """300 calls and 300 methods of one type and name."""
    n = spark.range(300)
    symbols = n.selectExpr("'r' repo_id", "id", "'Method' label", "'run' name", "concat('f', id) file_path", "'T' class_name", "1 start_line", "2 end_line", "true exported")
    calls = n.selectExpr("'r' repo_id", "id call_id", "'a' file_path", "id + 1000 caller_id", "'C' caller_class", "'run' callee_name", "'this.x' qualifier")
    imports = spark.createDataFrame([], "repo_id string, file_path string, target_path string")
    types = spark.createDataFrame([("r", "C", "x", "T")], "repo_id string, class_name string, property string, type_name string")
    found = resolve.resolved_calls(calls, symbols, imports, types)
    assert {(r["dst"], r["resolution_method"]) for r in found.collect()} == {(0, "property_type")} and found.count() == 300
    assert most_rows(found) < 3000


def test_files_of_folders_are_not_shuffled(spark):
    """a folder's files meet its importers in the last join, and nothing groups them afterwards."""
    files = [("r", f"pkg/u{i}.go") for i in range(60)] + [("r", f"cmd/m{i}.go") for i in range(60)] + [("r", "pkg/u_test.go")]
    imports = [("r", f"cmd/m{i}.go", ["pkg/"]) for i in range(60)] + [("r", "cmd/m0.go", ["none/", "pkg/u3.go"]), ("r", "cmd/m0.go", ["pkg/u_test.go"]), ("r", "pkg/u1.go", ["pkg/"]), ("r", "x.py", ["pkg/u3.go", "pkg/"])]
    found = resolve.resolved_imports(spark.createDataFrame(imports, "repo_id string, file_path string, candidates array<string>"), spark.createDataFrame(files, "repo_id string, file_path string"))
    want = [(f"cmd/m{i}.go", f"pkg/u{j}.go") for i in range(60) for j in range(60)] + [("cmd/m0.go", "pkg/u_test.go"), ("x.py", "pkg/u3.go")] + [("pkg/u1.go", f"pkg/u{j}.go") for j in range(60) if j != 1]
    assert sorted((r["file_path"], r["target_path"]) for r in found.collect()) == sorted(want)
    wide = [name for name, n in nodes_of(found) if n and n >= 3600]
    assert wide and not any("Aggregate" in name for name in wide)


def test_many_points_and_equal_spans_make_no_product(spark):
    """300 calls on one line of a file with 300 functions of one extent."""
    n = spark.range(300)
    points = n.selectExpr("'r' k", "id point_id", "7 line")
    spans = n.selectExpr("'r' k", "id span_id", "5 start_line", "9 end_line").union(n.selectExpr("'r' k", "id + 1000 span_id", "1 start_line", "20 end_line"))
    found = structure.enclosing(points, spans, ["k"])
    assert {(r["span_id"], r["size"]) for r in found.collect()} == {(0, 4)} and found.count() == 300
    assert most_rows(found) <= 600


def test_a_log_is_parsed_in_pieces(spark, monkeypatch):
    """headers reach status lines several pieces later, and no window has a whole repository's lines."""
    monkeypatch.setattr(gitlog, "BLOCK", 4)
    r, lines, want = random.Random(3), [], []
    for repo in ("a", "b"):
        sha = None
        for n in range(200):
            if n > 9 and (r.random() < 0.1 or n == 150):
                sha = f"{r.randrange(16**8):08x}"
                lines.append((repo, n, f"{sha}|me|m@x|2024-01-01 00:00:00|s"))
            else:
                lines.append((repo, n, f"M\tf{n}"))
                want += [(repo, f"f{n}", sha)] if sha else []
    df = spark.createDataFrame(lines, "repo_id string, n long, line string")
    got = [(x["repo_id"], x["file_path"], x["commit_sha"]) for x in gitlog.parse_log(df).collect()]
    assert sorted(got) == sorted(want)


def test_types_of_one_name_meet_on_nothing_else(spark):
    """300 types of 300 names with equal members, against type_pairs."""
    n = spark.range(300)
    side = lambda first: n.selectExpr("'x' k", f"id + {first} id", "concat('Name', id) name", "'Class' label", "cast(null as string) element_type", "id % 3 != 0 exported", "array('a', 'b') members", "'f' file_path")
    found = crossrepo.exact_type_pairs(side(0), side(1000), ["k"])
    rows = lambda df: sorted((r["source_id"], r["target_id"], float(r["confidence"])) for r in df.collect())
    assert rows(found) == [(i, i + 1000, 0.8 if i % 3 == 0 else 0.95) for i in range(300)]
    assert most_rows(found) <= 300


def test_a_built_graph_is_not_broadcast_by_its_estimate(spark, tmp_path):
    """the planner takes no side of a join for small because the texts' table is."""
    rows = [("r", f"pkg/f{i}.py", "python", f"from .f{i + 1} import x\n\ndef x(a):\n    return x(a)\n") for i in range(6)]
    spark.createDataFrame(rows, "repo_id string, file_path string, language string, content string").write.parquet(f"{tmp_path}/t")
    graph = build.build(spark.read.parquet(f"{tmp_path}/t"))
    assert "BroadcastHashJoin" not in graph.edges._jdf.queryExecution().sparkPlan().toString()
    assert {r["label"]: r["count"] for r in graph.edges.groupBy("label").count().collect()}["IMPORTS"] == 5


def test_chains_keep_their_ends_in_large_tables(spark, data, monkeypatch):
    """the rule for repositories of over 10,000 vertices leaves out those of one call, which the query's SQL has."""
    seen = []

    def input_edges(calls, least=0.5, large=community.LARGE):
        seen.append(large)
        raise StopIteration

    monkeypatch.setattr(community, "input_edges", input_edges)
    with pytest.raises(StopIteration):
        catalogue.QUERIES["communities_listed"](spark, data)
    assert seen[0] > 10**9


def test_mirrors_keep_no_pairs_of_types(spark, data, tmp_path, monkeypatch):
    """with six times the types, none of the tables that are kept is over eight times as large; scored pairs are 36 times as many."""
    kept, cut_anew = [], crossrepo.cut_anew

    def counted(df):
        out = cut_anew(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(crossrepo, "cut_anew", counted)
    most = []
    for n in (1, 6):
        part = spark.read.parquet(f"{data}/part.parquet").crossJoin(spark.range(n).withColumnRenamed("id", "copy"))
        part.withColumn("p_partkey", (part["p_partkey"] + part["copy"] * 200).cast(dict(part.dtypes)["p_partkey"])).drop("copy").write.parquet(f"{tmp_path}/{n}/part.parquet")
        kept.clear()
        catalogue.QUERIES["type_mirrors"](spark, f"{tmp_path}/{n}").collect()
        most.append(max(kept))
    assert most[1] <= 8 * most[0]


@pytest.mark.parametrize("seed", range(3))
def test_mirrors_are_the_matching_of_all_pairs(spark, seed):
    """classes and tiers give what sources in order take of all scored pairs, whatever is null."""
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)

    def side(first, n):
        rows = [(pick("a", "b"), first + i, pick("", "I") + pick("User", "Order", "OrderLine", "LineOrder", "UserOrder", "BigUserOrder", "Impl", "") + pick("", "", "Impl"), pick("Class", "Interface", "Enum", None), pick(None, "record", "x"), pick(True, True, True, False, None), pick(None, [], ["a", "b"], ["B", "a"], ["a", "b", "c"], ["x"]), pick("f", "g", None)) for i in range(n)]
        return spark.createDataFrame([x if x[2] else (*x[:2], None, *x[3:]) for x in rows], "k string, id long, name string, label string, element_type string, exported boolean, members array<string>, file_path string")

    a, b = side(0, 60), side(1000, 50)
    pairs = crossrepo.type_pairs(a, b, ["k"]).collect()
    want = set()
    for k in ("a", "b"):
        mine = [p for p in pairs if p["k"] == k]
        order = {p["source_id"]: (not p["source_exported"], -len(p["source_name"]), p["source_name"], p["source_path"] or "", p["source_id"]) for p in mine}
        used = set()
        for s in sorted(order, key=order.get):
            left = [(-p["confidence"], p["target_id"]) for p in mine if p["source_id"] == s and p["target_id"] not in used]
            if left:
                used.add(min(left)[1])
                want.add((k, s, min(left)[1], round(-min(left)[0], 6)))
    got = crossrepo.mirrors(a, b, ["k"])
    assert {(x["k"], x["source_id"], x["target_id"], round(float(x["confidence"]), 6)) for x in got.collect()} == want and want


def test_clustering_sends_no_table_of_vertices_through_the_driver(spark, data, monkeypatch):
    """F16: however small the tables are, only those of a row for each repository are broadcast."""
    seen, cut = [], session.cut

    def watched(df):
        out = cut(df)
        seen.extend(line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line)
        return out

    monkeypatch.setattr(session, "cut", watched)
    pairs = community.input_edges(inputs.part_edges(spark, data))
    assert community.modularity(pairs, community.communities(pairs)).count() == 1
    assert not [x for x in seen if "," in x.split("[")[1].split("]")[0] or "repo_id" not in x]


def test_places_and_files_are_not_broadcast(spark):
    """F1 of r05: no table of places or files goes through the driver, however small it is taken for."""
    imports = [("r", f"cmd/m{i}.go", ["pkg/"]) for i in range(9)]
    files = [("r", f"pkg/u{i}.go") for i in range(9)]
    found = resolve.resolved_imports(spark.createDataFrame(imports, "repo_id string, file_path string, candidates array<string>"), spark.createDataFrame(files, "repo_id string, file_path string"))
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert found.count() == 81 and not any("Broadcast" in name for name, _ in nodes_of(found))


@pytest.mark.parametrize("block", [3, 4096])
def test_products_are_joins(spark, monkeypatch, block):
    """Blocks of three rows, or all rows of a deal in one; keys of one side only and null ones meet nothing."""
    for name, value in (("BLOCK", block), ("RUN", 2), ("ROWS", 2)):
        monkeypatch.setattr(product, name, value)
    r = random.Random(5)
    left = spark.createDataFrame([("r", r.choice(["a", "a", "b", "c", None]), i % 90, f"v{i}") for i in range(100)], "k string, key string, x long, v string")
    right = spark.createDataFrame([("r", r.choice(["a", "a", "b", "d", None]), i % 90) for i in range(100)], "k string, key string, y long")
    rows = lambda df: sorted(map(tuple, df.select("k", "key", "x", "v", "y").collect()))
    assert rows(product.products(left, right, ["k", "key"])) == rows(left.join(right, ["k", "key"]))


def test_pairs_of_names_take_little_room(spark, tmp_path):
    """F2 of r05: 400 types of each of 40 names on each side are 6.4 million pairs, and a file of them has less than a byte for each."""
    n = spark.range(16_000)
    side = lambda first: n.selectExpr("'x' k", f"id * 7 + {first} id", "concat('Name', id % 40) name", "'Class' label", "cast(null as string) element_type", "id % 3 != 0 exported", "array('a') members", "'f' file_path")
    crossrepo.exact_type_pairs(side(0), side(10**6), ["k"]).select("source_id", "target_id", "confidence").write.parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs")
    assert found.count() == 400 * 400 * 40 and found.where("(source_id - (target_id - 1000000)) % 280 != 0").count() == 0
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert size < 6_400_000, size
