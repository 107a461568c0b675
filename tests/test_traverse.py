"""Cycles, self-loops, ties, missing labels and empty inputs on hand-made graphs."""

import pytest

from codeloom.model import PropertyGraph
from codeloom.operators import listing, traverse
from codeloom.plans.match import match


def edges(spark, rows):
    """(src, dst, label): ids in order."""
    return spark.createDataFrame([("r", i, b[2] if len(b) > 2 else "CALLS", b[0], b[1], 0.9) for i, b in enumerate(rows)], "repo_id string, id long, label string, src long, dst long, confidence double")


def nodes(spark, rows):
    return spark.createDataFrame([("r", i, label, name, f"f{i}", i, i + 1, i % 2 == 0) for i, label, name in rows], "repo_id string, id long, label string, name string, file_path string, start_line int, end_line int, exported boolean")


def test_cycle_and_self_loop(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 3), (3, 4)])
    roots = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in traverse.reach(e, roots, 5).collect()} == {(2, 1), (3, 2), (4, 3)}
    assert {tuple(r) for r in traverse.reach(e, roots, 5, keep_root=True).collect()} == {(2, 1), (3, 2), (1, 3), (4, 3)}
    assert {tuple(r) for r in traverse.reach(e, roots, 1, "both").collect()} == {(2, 1), (3, 1)}


def test_impact_keeps_labels_apart_and_prefers_the_first(spark):
    e = edges(spark, [(2, 1, "CALLS"), (3, 2, "EXTENDS"), (2, 1, "EXTENDS"), (1, 4, "IMPLEMENTS"), (4, 1, "CALLS")])
    got = {tuple(r) for r in traverse.impact(e, 1, 3).collect()}
    assert got == {(2, "CALLS", "callers", 1), (3, "EXTENDS", "callers", 2), (4, "CALLS", "callers", 1)}


def test_dependencies_keep_the_root_on_a_cycle(spark):
    e = edges(spark, [(1, 2, "IMPORTS"), (2, 1, "IMPORTS"), (2, 9, "CALLS")])
    assert {tuple(r) for r in traverse.dependencies(e, 1, "IMPORTS", 2).collect()} == {("dependencies", 2, 1), ("dependencies", 1, 2), ("dependents", 2, 1), ("dependents", 1, 2)}
    assert traverse.dependencies(e, 1, "NONE", 2).count() == 0


def test_shortest_path_takes_the_smallest_edges(spark):
    e = edges(spark, [(1, 3), (1, 2), (2, 4), (3, 4), (4, 5)])
    got = [tuple(r) for r in traverse.shortest_path(e, 1, 5).orderBy("position").collect()]
    assert got == [(0, 1, None), (1, 2, 1), (2, 4, 2), (3, 5, 4)]
    assert [tuple(r) for r in traverse.shortest_path(e, 5, 5).collect()] == [(0, 5, None)]
    assert traverse.shortest_path(e, 1, 99).count() == 0


def test_multi_source_and_neighbourhood(spark):
    e = edges(spark, [(1, 2), (3, 1), (4, 3), (1, 1)])
    direct = spark.createDataFrame([(2,), (1,)], "node long")
    assert {tuple(r) for r in traverse.multi_source(e, direct, 3).collect()} == {(3, 1, 1), (4, 2, 3)}
    alias = spark.createDataFrame([(4, 40)], "a long, b long")
    got = {r[0] for r in traverse.neighbourhood(edges(spark, [(40, 50), (3, 4)]), spark.createDataFrame([(3,)], "node long"), 2, alias).collect()}
    assert {3, 4, 50} <= got


def test_cross_repo_by_name(spark):
    g = PropertyGraph(
        spark.createDataFrame([("a", 1, "Function", "x"), ("a", 2, "Function", "y"), ("b", 1, "Function", "x"), ("b", 2, "Function", "z")], "repo_id string, id long, label string, name string"),
        spark.createDataFrame([("a", "CALLS", 1, 2), ("b", "CALLS", 1, 2)], "repo_id string, label string, src long, dst long"),
    )
    cross = spark.createDataFrame([("a", "y", "b", "x", "CROSS_REPO_CALLS"), ("a", "Function:y:p", "b", "Function:z:q", "CROSS_REPO_CALLS")], "source_repo string, source_node string, target_repo string, target_node string, edge_type string")
    exact = {tuple(r)[:2] for r in traverse.cross_repo_reach(g, cross, "a", "x", 3, "forward").collect()}
    assert exact == {("a", "y"), ("b", "x"), ("b", "z")}
    assert ("b", "z", "CROSS_REPO_CALLS", 2) in {tuple(r) for r in traverse.cross_repo_reach(g, cross, "a", "x", 2, "forward", match="ref").collect()}


def test_listing_edge_cases(spark):
    g = PropertyGraph(nodes(spark, [(1, "Function", "a"), (2, "Class", None), (3, "Function", "ab")]), edges(spark, [(1, 3), (3, 3)]))
    assert [r["id"] for r in listing.orphans(g).orderBy("id").collect()] == [1, 2]
    assert listing.list_nodes(g, "Nothing").count() == 0
    assert [r["id"] for r in listing.list_nodes(g, name_contains="a", offset=1).collect()] == [3]
    assert {(r["direction"], r["id"]) for r in listing.neighbours(g, 3).collect()} == {("incoming", 1), ("outgoing", 3), ("incoming", 3)}
    empty = PropertyGraph(g.nodes.limit(0), g.edges.limit(0))
    assert listing.label_counts(empty.nodes).count() == 0 and listing.degrees(empty.edges).count() == 0


def test_match(spark):
    g = PropertyGraph(nodes(spark, [(1, "Function", "a"), (2, "Class", "b"), (4, "Function", "c'd")]), edges(spark, [(1, 2), (4, 2), (2, 1, "EXTENDS")]))
    assert [tuple(r) for r in match(g, "MATCH (a:Function)-[e:CALLS]->(b {name: 'b'}) WHERE e.confidence >= 0.5 RETURN a.name AS x ORDER BY x DESC LIMIT 1").collect()] == [("c'd",)]
    assert [tuple(r) for r in match(g, "MATCH (a)-[e]-(b) RETURN label(e) AS l, count(*) AS n ORDER BY l").collect()] == [("CALLS", 4), ("EXTENDS", 2)]
    assert match(g, "MATCH (a:Function)<-[:EXTENDS]-(b)<-[:CALLS]-(c {name: $n}) RETURN DISTINCT c.name AS n", {"n": "c'd"}).count() == 1
    for bad in ("RETURN 1", "MATCH (a) WHERE a.x ~ 1 RETURN a.name AS x", "MATCH (a)-[e]-> RETURN a.name AS x", "MATCH (a)-[e]->(a) RETURN a.name AS x"):
        with pytest.raises(ValueError):
            match(g, bad)


def test_conditions_and_paths_of_match(spark):
    nodes = spark.createDataFrame([("r", i, "F" if i < 4 else "C", n) for i, n in enumerate(["a", "b", "x AND y", "it's", "e"])], "repo_id string, id long, label string, name string")
    edges = spark.createDataFrame([("r", 10 + i, "CALLS", a, b) for i, (a, b) in enumerate([(0, 1), (1, 2), (2, 0), (3, 4)])], "repo_id string, id long, label string, src long, dst long")
    g = PropertyGraph(nodes, edges)
    rows = lambda text: sorted(tuple(r) for r in match(g, text).collect())
    assert rows("MATCH (a) WHERE a.name = 'x AND y' OR a.name = 'it\\'s' RETURN a.id AS i") == [(2,), (3,)]
    assert rows("MATCH (a) WHERE NOT (a.name = 'a' OR a.label = 'C') AND a.id < 3 RETURN a.id AS i") == [(1,), (2,)]
    # OR binds less than AND.
    assert rows("MATCH (a) WHERE a.id = 0 OR a.id = 1 AND a.name = 'a' RETURN a.id AS i") == [(0,)]
    # A circle of three edges: paths end where an edge would come twice.
    assert rows("MATCH (a {name: 'a'})-[:CALLS*]->(b) RETURN b.id AS i") == [(0,), (1,), (2,)]
    assert rows("MATCH (a)-[:CALLS*2]->(b) RETURN a.id AS i, b.id AS j") == [(0, 2), (1, 0), (2, 1)] and rows("MATCH (a)-[*2..3]->(b {id: 0}) RETURN a.id AS i") == [(0,), (1,)]
    assert rows("MATCH (a) WHERE EXISTS((a)-[:CALLS]->(:C)) RETURN a.id AS i") == [(3,)] and rows("MATCH (a:F) WHERE NOT EXISTS((a)<-[:CALLS]-()) RETURN a.id AS i") == [(3,)]
    for bad in ("MATCH (a)-[e:CALLS*2]->(b) RETURN a.id", "MATCH (a)-[*0..2]->(b) RETURN a.id", "MATCH (a)-[*1..99]->(b) RETURN a.id", "MATCH (a) WHERE (a.id = 1 RETURN a.id", "MATCH (a) WHERE EXISTS((b)-[]->(c)) RETURN a.id", "MATCH (a) WHERE a.id = 1 a.id = 2 RETURN a.id"):
        with pytest.raises(ValueError):
            match(g, bad)


def test_shortest_paths_equal_breadth_first_search(spark):
    """All pairs of a sparse random graph with parallel edges: length, smallest nodes, smallest parallel edge."""
    import random

    r = random.Random(8)
    rows = [(i, "CALLS", r.randrange(24), r.randrange(24)) for i in range(34)]
    edges = spark.createDataFrame(rows, "id long, label string, src long, dst long")
    near = {}
    for i, _, a, b in rows:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {}).setdefault(y, []).append(i)
    for start, end in [(r.randrange(24), r.randrange(24)) for _ in range(8)]:
        far, todo = {end: 0}, [end]
        for x in todo:
            for y in near.get(x, ()):
                if y not in far:
                    far[y] = far[x] + 1
                    todo.append(y)
        want = []
        if far.get(start, 99) <= 4:
            want = [(0, start, None)]
            while want[-1][1] != end:
                x = want[-1][1]
                y = min(y for y in near[x] if far.get(y) == far[x] - 1)
                want.append((len(want), y, min(near[x][y])))
        assert [tuple(x) for x in traverse.shortest_path(edges, start, end, 4).orderBy("position").collect()] == want
