"""Aliases, modules and roots read from repositories' own files."""

from codeloom.sources import configs

SCHEMA = "repo_id string, file_path string, content string"


def test_path_aliases(spark):
    text = """{ // a comment
      /* another
         one */
      "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["*", "lib/*"], "x": ["y"]}}, "include": ["src"]
    }"""
    rows = [
        ("a", "tsconfig.json", text), ("b", "tsconfig.json", '{"compilerOptions": {}}'), ("c", "tsconfig.json", "{ no json"), ("d", "tsconfig.json", '{"files": []}'),
        ("e", "sub/tsconfig.json", text), ("f", "tsconfig.json", None), ("g", "tsconfig.json", '{"compilerOptions": {"paths": {"e": []}}}'),
    ]
    got = {tuple(r) for r in configs.path_aliases(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "./src", "@/*", 0, "*"), ("a", "./src", "@/*", 1, "lib/*"), ("a", "./src", "x", 0, "y"), ("b", ".", None, None, None), ("g", ".", "e", None, None)}


def test_go_modules(spark):
    rows = [("a", "go.mod", "// x\nmodule  example.com/a\n\ngo 1.22\n"), ("b", "go.mod", "go 1.22"), ("c", "sub/go.mod", "module m"), ("d", "go.mod", None)]
    assert [tuple(r) for r in configs.go_modules(spark.createDataFrame(rows, SCHEMA)).collect()] == [("a", "example.com/a")]


def test_java_roots(spark):
    paths = [("a", "src/main/java/A.java"), ("a", "src/main/java/p/B.java"), ("a", "C.java"), ("b", "p/q/D.java"), ("c", "src/x.py"), ("d", "src/E.java")]
    got = {tuple(r) for r in configs.java_roots(spark.createDataFrame([(r, p, None) for r, p in paths], SCHEMA)).collect()}
    assert got == {("a", "src/main/java"), ("a", ""), ("b", ""), ("c", ""), ("d", "src")}
