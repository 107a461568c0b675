"""Readers, parsers, extractors, exports and the stream, on small inputs."""

import hashlib

from pyspark.sql import functions as F

from codeloom.model import PropertyGraph
from codeloom.operators import resolve
from codeloom.plans import build
from codeloom.sources import code, export, files, gitlog, manifests
from codeloom.streaming import activity

FILES = [
    ("app/views.py", "python", "import os\nfrom .models import User\n\nLIMIT = 5\n\n@app.get('/users/{id}')\ndef show(id: int):\n    return User().load(id)\n\nclass View(Base):\n    store: Store\n    def run(self):\n        self.store.save(1)\n        show(2)\n"),
    ("app/models.py", "python", "class Store:\n    def save(self, x):\n        pass\n\nclass User:\n    def load(self, id):\n        return id\n"),
    ("app/broken.py", "python", "def (:\n"),
    ("web/api.ts", "typescript", "import { helper } from './util';\nexport class Api extends Base implements Face {\n  private store: Store;\n  load(id: string) {\n    return helper(id);\n  }\n}\nexport const run = async (x) => {\n  fetch(`/users/${x}`);\n};\nrouter.get('/things/:id', run);\n"),
    ("web/util.ts", "typescript", "export function helper(x: string) {\n  return x;\n}\nfunction hidden() {}\n"),
    ("main.go", "go", 'package main\nimport (\n  "x/y"\n)\ntype Srv struct {\n  db *Store\n}\nfunc (s *Srv) Serve(a int) {\n  s.db.Save(a)\n}\nfunc main() {\n  http.HandleFunc("/ping", ping)\n}\n'),
    ("lib.rs", "rust", "pub struct Cfg {\n    inner: Store,\n}\nimpl Cfg {\n    pub fn new(a: u8) -> Self {\n        build(a)\n    }\n}\nfn build(a: u8) {}\n"),
    ("A.java", "java", "public class A extends B implements C {\n    private Store store;\n    public void go(int x) {\n        store.save(x);\n    }\n}\n"),
]


def contents(spark):
    return spark.createDataFrame([("r", p, lang, t) for p, lang, t in FILES], "repo_id string, file_path string, language string, content string")


def test_symbols(spark):
    got = {(r["file_path"], r["kind"], r["name"], r["class_name"], r["exported"]) for r in code.symbols(contents(spark)).collect()}
    assert {
        ("app/views.py", "Function", "show", None, True), ("app/views.py", "Class", "View", None, True), ("app/views.py", "Method", "run", "View", False), ("app/views.py", "CodeElement", "LIMIT", None, True),
        ("web/api.ts", "Class", "Api", None, True), ("web/api.ts", "Method", "load", "Api", False), ("web/api.ts", "Function", "run", None, True), ("web/util.ts", "Function", "hidden", None, False),
        ("main.go", "Struct", "Srv", None, True), ("main.go", "Method", "Serve", "Srv", True), ("main.go", "Function", "main", None, False),
        ("lib.rs", "Struct", "Cfg", None, True), ("lib.rs", "Method", "new", "Cfg", False), ("lib.rs", "Function", "build", None, False),
        ("A.java", "Class", "A", None, True), ("A.java", "Method", "go", "A", False),
    } <= got
    assert not any(p == "app/broken.py" for p, *_ in got)


def test_calls_parents_properties(spark):
    c = contents(spark)
    calls = {(r["file_path"], r["caller_name"], r["callee_name"], r["qualifier"]) for r in code.calls(c).collect()}
    assert {("app/views.py", "run", "save", "self.store"), ("app/views.py", "show", "User", None), ("web/api.ts", "load", "helper", None), ("main.go", "Serve", "Save", "s.db"), ("lib.rs", "new", "build", None), ("A.java", "go", "save", "store")} <= calls
    up = {(r["class_name"], r["super_class"], tuple(r["interfaces"])) for r in code.inheritance(c).collect()}
    assert {("View", "Base", ()), ("Api", "Base", ("Face",)), ("A", "B", ("C",))} <= up
    props = {(r["class_name"], r["property"], r["type_name"]) for r in code.property_types(c).collect()}
    assert {("View", "store", "Store"), ("Api", "store", "Store"), ("Srv", "db", "Store"), ("Cfg", "inner", "Store"), ("A", "store", "Store")} <= props


def test_routes_and_http_calls(spark):
    c = contents(spark)
    got = {(r["file_path"], r["http_method"], r["url_pattern"], r["framework"], r["handler_name"]) for r in code.routes(c).collect()}
    assert {("app/views.py", "GET", "/users/{id}", "fastapi", "show"), ("web/api.ts", "GET", "/things/:id", "express", "run"), ("main.go", "ANY", "/ping", "go-net-http", "ping")} <= got
    assert {("web/api.ts", "ANY", "/users/:param")} <= {(r["file_path"], r["method"], r["path"]) for r in code.http_calls(c).collect()}
    flask = "@app.route('/x', methods=['POST', 'PUT'])\ndef f():\n  pass\n"
    assert {(m, u, f) for m, u, f, _, _ in code.detected_routes("python", flask)} == {("POST", "/x", "flask"), ("PUT", "/x", "flask")}
    assert len(code.detected_routes("ruby", "resources :posts\n")) == len(code.detected_routes("ruby", "resource :post\n")) == 8
    go = 'http.Handle("/files/", http.FileServer(dir))\nhttp.HandleFunc("/a", show)\nhttp.HandleFunc(path, show)\nhttp.HandleFunc("/b", func(w W, r R) {})\n'
    assert [(u, line, h) for _, u, _, line, h in code.detected_routes("go", go)] == [("/files/", 1, ""), ("/a", 2, "show"), ("/b", 4, "")]
    spring = '@GetMapping("/a")\npublic String show(int x) {\n'
    assert code.detected_routes("java", spring)[0][:2] == ("GET", "/a") and code.inferred_method("PostLogin") == "POST"


def test_paths_in_strings():
    found = {v: code.is_api_path(v) for _, v in code.literals("a = '/users/list' b = \"/TMP/x\" c = '/song.mp3' d = `/v1/{id}/:x` e = '//x' f = '/a b' g = '/é'")}
    assert found == {"/users/list": True, "/TMP/x": False, "/song.mp3": False, "/v1/{id}/:x": True, "//x": False, "/a b": False, "/é": False}
    assert code.assigned_name("  postLogin.PATH = '/x'", 19) == "postLogin" and code.assigned_name("f('/x')", 2) == "" and code.assigned_name("getUsers: '/x'", 10) == "getUsers"


def test_http_calls_of_no_language(spark):
    rows = spark.createDataFrame([("r", "a.bin", "unknown", "x = '/users/list'"), ("r", "a.rb", "ruby", "createUser = '/users/list'")], "repo_id string, file_path string, language string, content string")
    assert [tuple(r) for r in code.http_calls(rows).collect()] == [("r", "a.rb", "POST", "/users/list", 1)]


def test_folder_imports(spark):
    """Go and C# import folders, Java packages, each all of its files."""
    rows = [
        ("cmd/main.go", "go", 'import (\n  "fmt"\n  "example.com/app/store"\n  "other.org/x/util"\n)\n'), ("store/a.go", "go", "package store\n"), ("store/b.go", "go", "package store\n"), ("store/b_test.go", "go", "package store\n"), ("store/notes.txt", "text", ""), ("util/u.go", "go", "package util\n"),
        ("Main.cs", "csharp", "using App.Core;\nusing Lib.Deep;\n"), ("App/Core/X.cs", "csharp", ""), ("App/Core/Y.cs", "csharp", ""), ("src/Lib/Deep/Z.cs", "csharp", ""),
        ("A.java", "java", "import com.x.*;\nimport com.y.B.Inner;\n"), ("src/main/java/com/x/P.java", "java", ""), ("src/test/java/com/x/Q.java", "java", ""), ("src/main/java/com/y/B.java", "java", ""),
    ]
    df = spark.createDataFrame([("r", p, lang, t) for p, lang, t in rows], "repo_id string, file_path string, language string, content string")
    got = {(r["file_path"], r["target_path"]) for r in resolve.resolved_imports(code.imports(df, module="example.com/app"), df).collect()}
    assert got == {
        ("cmd/main.go", "store/a.go"), ("cmd/main.go", "store/b.go"), ("cmd/main.go", "util/u.go"), ("Main.cs", "App/Core/X.cs"), ("Main.cs", "App/Core/Y.cs"), ("Main.cs", "src/Lib/Deep/Z.cs"),
        ("A.java", "src/main/java/com/x/P.java"), ("A.java", "src/test/java/com/x/Q.java"), ("A.java", "src/main/java/com/y/B.java"),
    }


def test_import_candidates():
    c = code.import_candidates
    assert c("web/api.ts", "typescript", "./util")[:2] == ["web/util", "web/util.ts"] and "web/util/index.ts" in c("web/api.ts", "typescript", "./util")
    assert "src/x/y.ts" in c("a.ts", "typescript", "@/x/y", {"@/*": "src/*"}) and c("a.ts", "typescript", "react") == []
    assert c("a/b/c.py", "python", "..m.n") == ["a/m/n.py", "a/m/n/__init__.py", "a/m/n.pyi"]
    assert c("src/a.rs", "rust", "crate::x::y")[0] == "src/x/y.rs" and "src/main/java/a/B.java" in c("X.java", "java", "a.B", roots=("src/main/java",))


def test_build(spark):
    g = build.build(contents(spark))
    name = {r["id"]: r["name"] for r in g.nodes.collect()}
    got = {(r["label"], name.get(r["src"]), name.get(r["dst"])) for r in g.edges.collect()}
    assert {("CALLS", "run", "save"), ("CALLS", "run", "show"), ("CALLS", "load", "helper"), ("IMPORTS", "views.py", "models.py"), ("IMPORTS", "api.ts", "util.ts"), ("DEFINES", "util.ts", "helper"), ("CONTAINS", "app", "views.py")} <= got
    assert any(x[0] == "HANDLES" and x[1] == "show" for x in got) and any(x[0] == "EXPOSES" for x in got)
    full = build.with_analytics(g)
    assert full.nodes.where("label = 'Community'").count() >= 0 and full.nodes.count() >= g.nodes.count()
    assert build.build(contents(spark).limit(0)).nodes.count() == 0


def test_files(spark):
    rows = spark.createDataFrame([("r", "src/a.ts", bytearray(b"x\ny"), 3), ("r", "src/deep/b.py", bytearray(b"x\n"), 2), ("r", "node_modules/c.js", bytearray(b""), 0), ("r", "bin.dat", bytearray(b"a\0b"), 3), ("r", "Makefile", bytearray(b"all:"), 9_000_000)], "repo_id string, file_path string, data binary, size long")
    scan = files.scanned(rows, "node_modules/\n# no\n*.log\n", exclude=("*.dat",))
    assert {r["file_path"]: r["verdict"] for r in scan.collect()} == {"src/a.ts": "kept", "src/deep/b.py": "kept", "node_modules/c.js": "ignored", "bin.dat": "excluded", "Makefile": "too_large"}
    assert tuple(files.scan_counts(scan).first()) == (4, 2)
    meta = {r["file_path"]: r for r in files.with_metadata(rows).collect()}
    assert meta["src/a.ts"]["line_count"] == 2 and meta["src/deep/b.py"]["line_count"] == 1 and meta["node_modules/c.js"]["line_count"] == 0
    assert meta["bin.dat"]["content"] is None and meta["Makefile"]["language"] == "makefile" and meta["src/a.ts"]["language"] == "typescript" and meta["bin.dat"]["language"] == "unknown"
    assert {(r["path"], r["depth"]) for r in files.folders(rows).collect()} == {("", 0), ("src", 1), ("src/deep", 2), ("node_modules", 1)}
    assert {(r["parent"], r["child"]) for r in files.contains_edges(rows).collect()} >= {("", "src"), ("src", "src/deep"), ("src/deep", "src/deep/b.py"), ("", "Makefile")}
    tree = files.nested([r.asDict() for r in files.tree(files.with_metadata(rows), prefix="src").collect()])
    assert tree[0]["name"] == "src" and [x["name"] for x in tree[0]["children"]] == ["a.ts", "deep"]


def test_read_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("pass\n")
    assert [(r["file_path"], r["size"]) for r in files.read_folder(spark, f"file://{tmp_path}", "r").collect()] == [("a/x.py", 5)]
    # Names that Spark's own readers hide, and bytes that are no text.
    for name, data in (("a/__init__.py", b""), ("a/_util.py", b"x = 1"), (".env", b"K=1\n"), ("a/p.png", b"\x89PNG\r\n\x00\xff"), ("a/latin.txt", b"caf\xe9\n")):
        (tmp_path / name).write_bytes(data)
    got = {r["file_path"]: r for r in files.with_metadata(files.read_folder(spark, str(tmp_path), "r")).collect()}
    assert set(got) == {"a/x.py", "a/__init__.py", "a/_util.py", ".env", "a/p.png", "a/latin.txt"}
    assert got["a/p.png"]["content"] is None and got["a/p.png"]["line_count"] == 2 and got["a/__init__.py"]["line_count"] == 0 and got["a/__init__.py"]["content"] == ""
    assert got["a/latin.txt"]["content"] == "caf\ufffd\n" and got[".env"]["language"] == "unknown" and got["a/_util.py"]["content_hash"] == hashlib.sha256(b"x = 1").hexdigest()
    assert [r["file_path"] for r in files.read_folder(spark, str(tmp_path), "r", "*.py", 2).where("data is not null").collect()] == ["a/__init__.py"]
    (tmp_path / "none").mkdir()
    assert files.read_folder(spark, str(tmp_path / "none"), "r").count() == 0


LOG = "aaaaaaa1|Ann|a@x|2024-01-02T00:00:00Z|first | with bar\n\nM\tsrc/a.ts\nR100\told.ts\tnew.ts\nX\tskip\nbbbbbbb2|Bob|b@x|2024-01-01T00:00:00Z|second\nA\tsrc/a.ts\n"
DIFF = "diff --git a/x.ts b/x.ts\n--- a/x.ts\n+++ b/x.ts\n@@ -1,2 +1,3 @@\n keep\n-gone\n+new\n+more\ndiff --git a/y b/y\n--- a/y\n+++ b/y\n@@ -10 +10 @@\n-a\n+b\n"


def test_git(spark):
    lines = gitlog.text_lines(spark.createDataFrame([("r", LOG)], "repo_id string, t string"), "repo_id", "t")
    got = {(r["file_path"], r["commit_sha"], r["change_type"]) for r in gitlog.parse_log(lines).collect()}
    assert got == {("src/a.ts", "aaaaaaa1", "M"), ("new.ts", "aaaaaaa1", "R"), ("src/a.ts", "bbbbbbb2", "A")}
    assert gitlog.parse_log(lines, per_file=1).count() == 2 and gitlog.parse_log(lines.limit(0)).count() == 0
    status = gitlog.text_lines(spark.createDataFrame([("r", "A\ta\nR090\tb\tc\nC75\td\te\nD\tf")], "repo_id string, t string"), "repo_id", "t")
    assert {(r["file_path"], r["change"]) for r in gitlog.parse_name_status(status).collect()} == {("a", "A"), ("b", "D"), ("c", "A"), ("e", "A"), ("f", "D")}
    diff = gitlog.text_lines(spark.createDataFrame([("d", DIFF)], "diff_id string, t string"), "diff_id", "t")
    assert {(r["file_path"], r["line"], r["side"]) for r in gitlog.parse_diff(diff).collect()} == {("x.ts", 2, "removed"), ("x.ts", 2, "added"), ("x.ts", 3, "added"), ("y", 10, "removed"), ("y", 10, "added")}


def test_manifests(spark):
    rows = [
        ("r", "package.json", '{"dependencies": {"a": "^1", "@o/b": "file:../b"}, "devDependencies": {"c": "2"}}'),
        ("r", "x/Cargo.toml", '[package]\nname = "z"\n[dependencies]\nserde = "1.0"\nlocal = { path = "../l", features = ["f"] }\n[dev-dependencies.big]\nversion = "3"\n'),
        ("r", "go.mod", "module m\nrequire one/two v1.2.3\nrequire (\n\tthree v0.1 // indirect\n)\nreplace x => y v1\n"),
        ("r", "bad/package.json", "{oops"),
    ]
    got = {(r["ecosystem"], r["name"], r["version"], r["is_dev"]) for r in manifests.dependencies(spark.createDataFrame(rows, "repo_id string, file_path string, content string")).collect()}
    assert got == {("npm", "a", "^1", False), ("npm", "@o/b", "file:../b", False), ("npm", "c", "2", True), ("cargo", "serde", "1.0", False), ("cargo", "local", "../l", False), ("cargo", "big", "3", True), ("go", "one/two", "v1.2.3", False), ("go", "three", "v0.1", False)}


def test_export(spark):
    n = spark.createDataFrame([("r", 1, "Function", 'a "b", c', "p", 1, 2, True, None, None), ("r", 2, "Class", "it's", None, None, None, None, None, {"kind": "k"})], "repo_id string, id long, label string, name string, file_path string, start_line int, end_line int, exported boolean, class_name string, props map<string,string>")
    e = spark.createDataFrame([("r", 5, "CALLS", 1, 2, 0.5, "exact", None)], "repo_id string, id long, label string, src long, dst long, confidence double, resolution_method string, step int")
    lines = {r["id"]: r["line"] for r in export.nodes_csv(n).collect()}
    assert lines[1].startswith('1,Function,"a ""b"", c",p,true,,') and lines[2].startswith("2,Class,it's,,,k,")
    g = PropertyGraph(n, e)
    assert export.edges_csv(g).first()["line"].startswith('5,CALLS,1,2,"a ""b"", c",it\'s,')
    assert {r["statement"] for r in export.nodes_cypher(n).collect()} >= {"CREATE (:Class {name: 'it\\'s'});"}
    assert export.edges_cypher(g).first()["statement"].endswith("CREATE (a)-[:CALLS {confidence: 0.5, resolution_method: 'exact'}]->(b);")
    assert export.project_rows(g, spark.createDataFrame([("r", "x")], "source_repo string, t string")).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("r", f"f{i % 3}", str(i), f"2024-01-0{1 + i % 4} 10:00:00") for i in range(40)], "repo_id string, file_path string, commit_sha string, commit_date string").withColumn("commit_date", F.col("commit_date").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = activity.daily_activity(feed).writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    got = {(str(r["day"]), r["rows"]) for r in spark.sql("select * from daily").collect()}
    q.stop()
    assert got == {(str(r["d"]), r["n"]) for r in rows.groupBy(F.to_date("commit_date").alias("d")).agg(F.count("*").alias("n")).collect()}
