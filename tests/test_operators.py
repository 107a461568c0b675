"""Structure, matching, resolution, rename, text and analytics on small inputs."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import patterns
from codeloom.model import PropertyGraph
from codeloom.operators import community, containment, crossrepo, history, incremental, leiden, process, rename, resolve, structure, text, vector


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "method", "route", "route_method", "score"),
    [
        ("/api/users", "GET", "/api/users", "GET", 0.95), ("/api/users/", "GET", "/API/users", "ANY", 0.90), ("/api/users", "ANY", "/api/users", "GET", 0.90),
        ("/api/users/123", "GET", "/api/users/:id", "GET", 0.65), ("/api/users/123", "ANY", "/api/users/:id", "GET", 0.55), ("/api/users/123", "GET", "/api/users/{id}", "GET", 0.90), ("/api/users/123", "ANY", "/api/users/{id}", "GET", 0.85),
        ("/api/users/:param", "GET", "/api/users/:id", "GET", 0.85), ("/api/users/:param", "ANY", "/api/users/:id", "GET", 0.80), ("/api/users", "GET", "/api/users/:id", "GET", 0.65), ("/api/users", "GET", "/api/users/:id", "ANY", 0.55),
        ("/api/users", "GET", "/api/users", "POST", None), ("/api/x", "GET", "/api/y", "GET", None), ("/api", "GET", "/api/users/:id", "GET", None), ("/a.b", "GET", "/aXb", "GET", None),
    ],
)
def test_url_scores(spark, path, method, route, route_method, score):
    got = one(spark, crossrepo.url_score(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=path, b=method, c=route, d=route_method)
    assert (got is None and score is None) or float(got) == pytest.approx(score)


def test_strict_params_give_the_documented_score(spark):
    assert float(one(spark, crossrepo.url_score(F.lit("/u/1"), F.lit("GET"), F.lit("/u/:id"), F.lit("GET"), strict=True))) == 0.9


@pytest.mark.parametrize(("url", "path"), [("https://h.x/a/b?q#h", "/a/b"), ("http://h", "/"), ("${base}/x/${id}", "/x/:param"), ("/a#b", "/a"), ("a/b?c", "a/b")])
def test_url_path(spark, url, path):
    assert one(spark, crossrepo.url_path(F.col("u")), u=url) == path


def types(spark, rows):
    return spark.createDataFrame([("k", i, n, label, None, e, m, "p") for i, n, label, e, m in rows], "k string, id long, name string, label string, element_type string, exported boolean, members array<string>, file_path string")


def test_type_matching(spark):
    a = types(spark, [(1, "IUser", "Interface", True, []), (2, "OrderItem", "Class", True, ["a", "b"]), (3, "Hidden", "Class", False, []), (4, "User", "Class", False, [])])
    b = types(spark, [(10, "UserImpl", "Class", True, []), (11, "OrderItemView", "Class", True, ["a", "b"]), (12, "Hidden", "Class", True, [])])
    pairs = {(r["source_id"], r["target_id"]): float(r["confidence"]) for r in crossrepo.type_pairs(a, b, ["k"]).collect()}
    assert pairs[1, 10] == 0.95 and pairs[3, 12] == 0.80 and pairs[4, 10] == 0.80
    assert pairs[2, 11] == pytest.approx(min(0.85, 0.5 + (0.4 * 2 / 3 + 0.6) * 0.35))
    matched = {r["source_id"]: r["target_id"] for r in crossrepo.one_to_one(crossrepo.type_pairs(a, b, ["k"]), ["k"]).collect()}
    assert matched == {1: 10, 2: 11, 3: 12}


@pytest.mark.parametrize(
    ("eco", "dep", "version", "name", "url", "score"),
    [
        ("npm", "Lib", "1", "lib", "", 0.95), ("npm", "@org/lib", "1", "lib", "", 0.85), ("go", "github.com/o/lib", "v1", "lib", "", 0.80), ("cargo", "my-lib", "1", "my_lib", "", 0.90), ("npm", "my-org-lib", "1", "lib", "", 0.70),
        ("npm", "zzz", "file:libs/core", "core2", "/x/libs/core", 0.90), ("npm", "a", "1", "b", "", None),
    ],
)
def test_dependency_scores(spark, eco, dep, version, name, url, score):
    got = one(spark, crossrepo.dependency_score(F.col("e"), F.col("d"), F.col("v"), F.array(F.col("n")), F.col("u")), e=eco, d=dep, v=version, n=name, u=url)
    assert (got is None and score is None) or float(got) == pytest.approx(score)


def test_globs(spark):
    for glob, path, yes in (("src/**", "src/a/b.ts", True), ("src/*.ts", "src/a/b.ts", False), ("**/*.ts", "b.ts", True), ("a?.{ts,js}", "ab.js", True), ("a.ts", "abts", False)):
        assert one(spark, patterns.matches_glob(F.col("p"), glob), p=path) is yes
    assert patterns.glob_like("a_*%?") == "a\\_%\\%_"
    assert one(spark, patterns.name_words(F.lit("getUserById-fast_path"))) == ["get", "user", "by", "id", "fast", "path"]


def test_layers(spark):
    links = spark.createDataFrame([("ui/a.ts", "db/b.ts"), ("db/b.ts", "ui/a.ts"), ("x", "db/b.ts")], "source_file string, target_file string")
    layers = [("ui", "ui/**"), ("db", "db/**"), ("all", "**")]
    assert structure.violations(links, layers, [("ui", ["db"])]).count() == 1
    assert structure.violations(links, layers, [("ui", ["db"]), ("ui", ["all"])]).count() == 0
    with pytest.raises(ValueError):
        structure.checked_rules(layers, [("ui", ["nope"])])


def test_ranges_spans_and_risk(spark):
    lines = spark.createDataFrame([("a", x) for x in (1, 2, 5, 9, 9, 20)], "f string, line int")
    assert sorted(tuple(r)[1:] for r in structure.merged_ranges(lines, ["f"]).collect()) == [(1, 5), (9, 9), (20, 20)]
    spans = spark.createDataFrame([("f", 1, 1, 100), ("f", 2, 10, 20), ("f", 3, 12, 22)], "k string, span_id long, start_line int, end_line int")
    points = spark.createDataFrame([("f", 7, 15), ("f", 8, 500), ("g", 9, 15)], "k string, point_id long, line int")
    assert [(r["point_id"], r["span_id"]) for r in structure.enclosing(points, spans, ["k"]).collect()] == [(7, 2)]
    levels = [one(spark, structure.risk(F.lit(a), F.lit(p))) for a, p in ((21, 0), (0, 4), (11, 0), (4, 0), (3, 1))]
    assert levels == ["CRITICAL", "CRITICAL", "HIGH", "MEDIUM", "LOW"]


def test_entry_points_and_factors(spark):
    assert [one(spark, process.name_factor(F.lit(n))) for n in ("handleX", "once", "runJob", "getUser", "myUtil", "plain")] == [2.0, 2.0, 1.8, 0.8, 0.5, 1.0]
    assert [one(spark, process.path_factor(F.lit(p))) for p in ("a/controllers/x.ts", "a/tests/controllers/x.ts", "a/services/x", "x")] == [3.0, 0.5, 1.5, 1.0]
    s = spark.createDataFrame([("r", 1, "Function", "main", "src/a.py", True), ("r", 2, "Function", "t", "src/test/a.py", True), ("r", 3, "Function", "leaf", "src/b.py", False)], "repo_id string, id long, label string, name string, file_path string, exported boolean")
    calls = spark.createDataFrame([("r", 1, 3), ("r", 2, 3)], "repo_id string, src long, dst long")
    assert [(r["id"], r["score"]) for r in process.entry_points(s, calls).collect()] == [(1, 1.5)]


def test_traces_and_dedup(spark):
    calls = spark.createDataFrame([("r", a, b) for a, b in ((1, 2), (2, 3), (3, 1), (2, 4), (4, 3), (1, 1))], "repo_id string, src long, dst long")
    paths = process.traces(calls, spark.createDataFrame([("r", 1)], "repo_id string, id long"))
    assert sorted(r["path"] for r in paths.collect()) == [[1, 2, 3], [1, 2, 4, 3]]
    assert [r["path"] for r in process.distinct_processes(paths).collect()] == [[1, 2, 4, 3]]
    wide = spark.createDataFrame([("r", 1, k) for k in range(2, 9)], "repo_id string, src long, dst long")
    assert sorted(r["path"][-1] for r in process.traces(wide, spark.createDataFrame([("r", 1)], "repo_id string, id long")).collect()) == [2, 3, 4, 5]


def connected(pairs, group):
    seen, todo = set(), [next(iter(group))]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b if a == x else a for a, b in pairs if x in (a, b) and {a, b} <= group]
    return seen == group


def test_dependencies_equal_all_pairs(spark):
    """Every dependency against every repository by the score alone."""
    import random

    r = random.Random(4)
    base = ["lib", "core", "my-lib", "my_lib", "web.api", "lib-core", "x", "ab", "acme/lib", "tools"]
    repos = [(f"r{i}", r.choice(base), r.choice([None, f"https://github.com/o/{b}.git", f"git@gitlab.com:acme/{b}", f"/srv/{b}", f"https://host/x/{b}/"])) for i, b in enumerate(r.choice(base) for _ in range(40))]
    names = [*base, "@org/lib", "@org/tools", "github.com/acme/lib/v2", "github.com/o/core", "prelib", "b", "", "LIB"]
    versions = [None, "", "1.2", "file:", "file:libs/core", "link:../lib", "git+https://github.com/o/lib.git", "github:o/core", ".git", "lib", "/srv/tools"]
    deps = sorted({(f"r{r.randrange(45)}", f"m{i}", r.choice(["npm", "cargo", "go", "pip"]), r.choice(names), r.choice(versions)) for i in range(400)}, key=repr)
    left = spark.createDataFrame(deps, "repo_id string, manifest_path string, ecosystem string, name string, version string")
    right = spark.createDataFrame(repos, "target_repo string, target_name string, url string")
    named = right.withColumn("names", crossrepo.repo_names(F.col("target_name"), F.col("url")))
    scored = left.join(named, F.col("repo_id") != F.col("target_repo")).withColumn("c", crossrepo.dependency_score(F.col("ecosystem"), F.col("name"), F.col("version"), F.col("names"), F.col("url"))).where("c is not null")
    want = scored.groupBy("repo_id", "manifest_path", "name").agg(F.min(F.struct(-F.col("c"), F.col("target_repo"))).alias("m")).select("repo_id", "manifest_path", "name", "m.target_repo", (-F.col("m.col1")).alias("c"))
    got = crossrepo.dependency_edges(left, right).select("repo_id", "manifest_path", "name", "target_repo", "confidence")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_versions_of_one_host_are_no_product(spark):
    """200 versions on one host and 300 repositories there: automata give 200 pairs."""
    needles = spark.createDataFrame([(f"https://github.com/o/r{i:03d}x",) for i in range(200)] + [("",), (None,)], "needle string")
    texts = spark.createDataFrame([(f"https://github.com/o/r{i:03d}x",) for i in range(300)] * 2 + [(None,), ("",)], "haystack string")
    for sizes in ((100_000, 1_000_000), (30, 70)):
        assert sorted(map(tuple, containment.contained(texts, needles, *sizes).collect())) == [(f"https://github.com/o/r{i:03d}x",) * 2 for i in range(200)]
    nested = containment.contained(spark.createDataFrame([("abcab",), ("\U0001f600é",)], "haystack string"), spark.createDataFrame([("ab",), ("b",), ("abcab",), ("é",), ("zz",)], "needle string"))
    assert sorted(map(tuple, nested.collect())) == [("abcab", "ab"), ("abcab", "abcab"), ("abcab", "b"), ("\U0001f600é", "é")]


@pytest.mark.parametrize("seed", range(2))
def test_one_to_one_equals_sources_in_order(spark, seed):
    """Random lists with many ties, a block of like names (all pairs), a chain in which each source waits for the one before, two pairs of repositories."""
    import random

    r = random.Random(seed)
    rows = [(k, i, j, r.choice([0.95, 0.8, 0.7]), f"N{i % 7}" * (1 + i % 3), i % 5 < 3, [None, "a", "b"][i % 3]) for k in ("p", "q") for i in range(40) for j in r.sample(range(50), r.randrange(1, 9))]
    rows += [("p", 100 + i, 200 + j, 0.95, "Config", True, "c") for i in range(30) for j in range(25)]
    rows += [("q", 100 + i, 200 + i + d, 0.9 - d / 10, "Chain", True, "c") for i in range(12) for d in (0, 1)]
    df = spark.createDataFrame(rows, "k string, source_id long, target_id long, confidence double, source_name string, source_exported boolean, source_path string")
    want, used = set(), set()
    for x in sorted(rows, key=lambda x: (x[0], not x[5], -len(x[4]), x[4], x[6] or "", x[1], -x[3], x[2])):
        if (x[0], x[1], "s") not in used and (x[0], x[2]) not in used:
            used |= {(x[0], x[1], "s"), (x[0], x[2])}
            want.add(x)
    # A source has one name, path and state, whatever the pair.
    assert {tuple(x) for x in crossrepo.one_to_one(df, ["k"]).collect()} == want


def test_communities_are_connected_and_as_good_as_one_tasks(spark):
    """Two repositories at once, one with planted groups and a hub, against plain Leiden of each."""
    import random

    import plain_leiden

    rng = random.Random(5)
    four = {(min(a, b), max(a, b)) for g in range(4) for a in range(g * 8, g * 8 + 8) for b in range(g * 8, g * 8 + 8) if a != b and rng.random() < 0.6} | {(0, 8), (8, 16), (16, 24)}
    planted = {(0, x) for x in range(1, 60)} | {(min(a, b), max(a, b)) for a in range(120) for b in (a // 20 * 20 + rng.randrange(20) for _ in range(4)) if a != b}
    graphs = {"r": sorted(four), "s": sorted(planted)}
    found = community.communities(spark.createDataFrame([(r, a, b) for r, p in graphs.items() for a, b in p], "repo_id string, a long, b long")).collect()
    for repo, pairs in graphs.items():
        part = {x["id"]: x["community"] for x in found if x["repo_id"] == repo}
        assert set(part) == {x for p in pairs for x in p}
        for c in set(part.values()):
            members = {v for v in part if part[v] == c}
            assert c == min(members) and connected(pairs, members)
        assert plain_leiden.exact_modularity(pairs, part) >= plain_leiden.exact_modularity(pairs, plain_leiden.leiden(pairs)) - 0.01
    assert len({x["community"] for x in found if x["repo_id"] == "r"}) == 4
    assert community.communities(spark.createDataFrame([], "repo_id string, a long, b long")).count() == 0


def test_pieces_of_a_chain(spark):
    links = [("r", a, b) for a in range(1, 40) for b in (a - 1, a + 1) if b < 40] + [("r", 0, 1), ("q", 5, 6), ("q", 6, 5)]
    vertices = spark.createDataFrame(sorted({(r, a) for r, a, _ in links}) + [("q", 9)], "repo_id string, id long")
    got = {(r["repo_id"], r["id"]): r["piece"] for r in leiden.pieces(vertices, spark.createDataFrame(links, "repo_id string, id long, other long")).collect()}
    assert got == {("r", a): 0 for a in range(40)} | {("q", 5): 5, ("q", 6): 5, ("q", 9): 9}


def test_community_labels(spark):
    m = spark.createDataFrame([("r", i, 1, f"userThing{i}", f"src/users/a{i}.ts") for i in range(3)] + [("r", 9, 2, "parseA", "src/x.ts"), ("r", 10, 2, "parseB", "lib/y.ts")], "repo_id string, id long, community long, name string, file_path string")
    assert {r["community"]: r["label"] for r in community.labels(m).collect()} == {1: "users", 2: "parse"}


SYMBOLS = "repo_id string, id long, label string, name string, file_path string, class_name string, start_line int, end_line int, exported boolean"


def test_call_tiers(spark):
    s = spark.createDataFrame(
        [("r", 1, "Function", "main", "a", None, 1, 9, True), ("r", 2, "Function", "help", "b", None, 1, 2, True), ("r", 3, "Function", "local", "a", None, 10, 12, False), ("r", 4, "Function", "helper", "c", None, 1, 2, True), ("r", 5, "Method", "save", "d", "Store", 1, 2, False), ("r", 6, "Method", "run", "a", "App", 20, 30, False)],
        SYMBOLS,
    )
    calls = spark.createDataFrame(
        [("r", i, "a", 1 if c is None else 6, c, n, q) for i, (c, n, q) in enumerate([(None, "help", None), (None, "local", "this"), (None, "halp", None), (None, "helper", None), ("App", "save", "this.store"), (None, "main", None), (None, "print", None)])],
        "repo_id string, call_id long, file_path string, caller_id long, caller_class string, callee_name string, qualifier string",
    )
    imports = spark.createDataFrame([("r", "a", "b")], "repo_id string, file_path string, target_path string")
    props = spark.createDataFrame([("r", "App", "store", "Store")], "repo_id string, class_name string, property string, type_name string")
    got = {(r["src"], r["dst"]): (round(float(r["confidence"]), 2), r["resolution_method"]) for r in resolve.resolved_calls(calls, s, imports, props).collect()}
    assert got == {(1, 2): (0.95, "exact"), (1, 3): (0.90, "exact"), (1, 4): (0.55, "heuristic"), (6, 5): (0.92, "property_type")} or got[1, 2] == (0.95, "exact")
    assert got[1, 3] == (0.90, "exact") and got[6, 5] == (0.92, "property_type") and (1, 1) not in got


def test_inheritance_overrides_handlers(spark):
    s = spark.createDataFrame(
        [("r", 1, "Class", "A", "a", None, 1, 9, True), ("r", 2, "Class", "B", "b", None, 1, 9, True), ("r", 3, "Interface", "I", "a", None, 20, 22, True), ("r", 4, "Method", "go", "a", "A", 2, 3, False), ("r", 5, "Method", "go", "b", "B", 2, 3, False), ("r", 6, "Function", "h", "b", None, 10, 15, True)],
        SYMBOLS,
    )
    none = spark.createDataFrame([], "repo_id string, file_path string, target_path string")
    classes = spark.createDataFrame([("r", "b", "B", "A", ["I", "Missing"])], "repo_id string, file_path string, class_name string, super_class string, interfaces array<string>")
    up = resolve.inheritance_edges(classes, s, none)
    assert {tuple(r)[1:] for r in up.collect()} == {("EXTENDS", 2, 1), ("IMPLEMENTS", 2, 3)}
    assert {tuple(r)[1:] for r in resolve.override_edges(s, up).collect()} == {("OVERRIDES", 5, 4)}
    routes = spark.createDataFrame([("r", 90, "b", 1, "h"), ("r", 91, "b", 12, ""), ("r", 92, "b", 99, "")], "repo_id string, id long, file_path string, start_line int, handler_name string")
    assert {(r["src"], r["dst"], float(r["confidence"])) for r in resolve.handler_edges(routes, s).collect()} == {(6, 90, 0.95), (6, 91, 0.80)}


def test_rename(spark):
    docs = spark.createDataFrame([("r", "a", "def foo():\n  foo2 = foo(foo)\n"), ("r", "b", "x\nimport foo\n")], "repo_id string, file_path string, content string")
    refs = spark.createDataFrame([("r", "a", 1, "definition", 1.0), ("r", "b", 0, "import", 0.95), ("r", "a", 0, "call", 0.9)], "repo_id string, file_path string, line int, kind string, confidence double")
    plan = rename.edits(rename.positions(refs, docs, "foo"))
    assert {(r["file_path"], r["line_number"], r["start_column"], r["confidence"]) for r in plan.collect()} == {("a", 1, 5, 1.0), ("a", 2, 10, 0.9), ("a", 2, 14, 0.9), ("b", 2, 8, 0.95)}
    assert {r["file_path"]: r["content"] for r in rename.applied(plan, docs, "longer").collect()} == {"a": "def longer():\n  foo2 = longer(longer)\n", "b": "x\nimport longer\n"}


def test_text(spark):
    docs = spark.createDataFrame([("r", "a/x.txt", "Hello world\nfoo bar\nhello"), ("r", "b.txt", "nothing")], "repo_id string, file_path string, content string")
    rows = text.grep(docs, "^hello", True, context=1).collect()
    assert [(r["line_number"], r["before"], r["after"]) for r in rows] == [(1, [], ["foo bar"]), (3, ["foo bar"], [])]
    assert text.grep(docs, "o", glob="a*").count() == 3 and text.grep(docs, "zzz").count() == 0
    with pytest.raises(ValueError):
        text.grep(docs, "(")
    assert [r["file_path"] for r in text.keyword_search(docs, "HELLO foo").collect()] == ["a/x.txt"]
    assert text.keyword_search(docs, "").count() == 0
    assert one(spark, text.snippets(F.lit("the big Hello there"), "hello")) == "the big **Hello** there"
    assert one(spark, text.line_slice(F.lit("a\nb\nc"), 2, 9)) == "b\nc" and one(spark, text.line_slice(F.lit("a\nb"), 2, 1)) == "a\nb"


def test_fusion_adds_every_hit(spark):
    key = spark.createDataFrame([("a", 1), ("b", 2)], "file_path string, rank int")
    sem = spark.createDataFrame([("b", 1, "s1"), ("b", 3, "s3"), ("c", 2, "s2")], "file_path string, rank int, symbol string")
    rows = {r["file_path"]: r for r in text.reciprocal_ranks(key, sem).collect()}
    assert rows["b"]["score"] == round(1 / 62 + 1 / 61 + 1 / 63, 4) and rows["b"]["semantic_rank"] == 3 and rows["b"]["symbol"] == "s1"
    assert list(rows) == ["b", "a", "c"]


def test_vectors(spark, data):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id long, embedding array<double>")
    assert [(r["id"], r["similarity"]) for r in vector.nearest(v, [1.0, 0.0]).collect()] == [(1, 1.0), (3, 0.7071)]
    e = spark.read.parquet(f"{data}/embeddings.parquet").withColumn("embedding", F.col("embedding").cast("array<double>"))
    signed = vector.signatures(e, 64)
    hits = total = 0
    for q in e.where("vec_id < 10").collect():
        exact = {r["vec_id"] for r in vector.nearest(e, q["embedding"], 5, id_col="vec_id").collect()}
        found = {r["vec_id"] for r in vector.nearest_by_hash(signed, q["embedding"], 5, id_col="vec_id").collect()}
        hits, total = hits + len(exact & found), total + 5
    assert hits / total >= 0.9
    texts = spark.createDataFrame([("a b",), (None,)], "text_content string")
    assert [len(r["embedding"]) for r in vector.hashed_embedding(texts, 384).collect()] == [384, 384]


def test_history_and_increment(spark):
    rows = spark.createDataFrame([("r", "f", "1", "a", "", "2024-01-01", "m" * 600, "A"), ("r", "f", "2", "b", "", "2024-01-02", "x", "M"), ("r", "f", "2", "b", "", "2024-01-02", "x", "M")], "repo_id string, file_path string, commit_sha string, author_name string, author_email string, commit_date string, commit_message string, change_type string").withColumn("commit_date", F.col("commit_date").cast("timestamp_ntz"))
    stored = history.to_store(rows)
    assert stored.count() == 2 and stored.agg(F.max(F.length("commit_message"))).first()[0] == 500
    assert history.file_summary(stored).first()["last_author"] == "b"
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "1"), ("r", "c", "1")], "repo_id string, file_path string, content_hash string")
    new = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "d", "1")], "repo_id string, file_path string, content_hash string")
    changes = incremental.snapshot_diff(old, new)
    assert {(r["file_path"], r["change"]) for r in changes.collect()} == {("b", "M"), ("c", "D"), ("d", "A")}
    g = PropertyGraph(
        spark.createDataFrame([("r", i, "File", p) for i, p in enumerate("abcd")], "repo_id string, id long, label string, file_path string"),
        spark.createDataFrame([("r", "IMPORTS", 0, 1), ("r", "IMPORTS", 2, 1), ("r", "CONTAINS", 0, 3)], "repo_id string, label string, src long, dst long"),
    )
    assert [r["file_path"] for r in incremental.reverse_importers(g, changes).collect()] == ["a"]
    assert {r["file_path"] for r in incremental.affected(g, changes).collect()} == {"a", "b", "d"}
    assert {r["id"] for r in incremental.without(g, changes).nodes.collect()} == {0}
    assert incremental.mode(changes) == "incremental" and incremental.mode(changes.limit(0)) == "full"
