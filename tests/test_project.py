"""Repositories on disk and the tables around the graphs."""

import subprocess
import zipfile

import pytest

from codeloom.model import PropertyGraph, append, drop_repo, repo_exists
from codeloom.operators import project
from codeloom.sources import gitlog, repository


def git(folder, *args):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=A", "-c", "user.email=a@b", *args], check=True, capture_output=True)


def test_git_texts(spark, tmp_path):
    git(tmp_path, "init", "-b", "main")
    (tmp_path / "a.py").write_text("x\ny\n")
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-m", "one | two")
    (tmp_path / "a.py").write_text("x\nz\nw\n")
    (tmp_path / "b.py").write_text("q\n")
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-m", "three")
    rows = repository.history(spark, str(tmp_path), "r").collect()
    assert {(r["file_path"], r["change_type"], r["commit_message"]) for r in rows} == {("a.py", "A", "one | two"), ("a.py", "M", "three"), ("b.py", "A", "three")}
    changed = gitlog.parse_diff(repository.diff_lines(spark, str(tmp_path), "d", "compare", "HEAD~1"))
    assert {(r["file_path"], r["line"], r["side"]) for r in changed.collect()} == {("a.py", 2, "removed"), ("a.py", 2, "added"), ("a.py", 3, "added"), ("b.py", 1, "added")}
    assert {(r["file_path"], r["change"]) for r in repository.changed_files(spark, str(tmp_path), "r", "HEAD~1", "HEAD").collect()} == {("a.py", "M"), ("b.py", "A")}
    assert {(r["file_path"], r["change_type"]) for r in repository.history(spark, str(tmp_path), "r", path="a.py").collect()} == {("a.py", "M")}
    with pytest.raises(subprocess.CalledProcessError):
        repository.changed_files(spark, str(tmp_path), "r", "HEAD~7", "HEAD")
    for bad in (("compare", "--x"), ("compare", None), ("nope", None)):
        with pytest.raises(ValueError):
            repository.diff_lines(spark, str(tmp_path), "d", *bad)


def test_git_output_in_pieces(spark, tmp_path):
    """Numbers go on from piece to piece, and a line is never cut."""
    git(tmp_path, "init", "-b", "main")
    texts = [f"line {i} ünd \r in the middle" for i in range(500)]
    (tmp_path / "a.txt").write_text("\n".join(texts) + "\n", newline="")
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-m", "one")
    rows = repository._git_lines(spark, str(tmp_path), "show", "HEAD:a.txt", size=4000).orderBy("n").collect()
    assert [tuple(r) for r in rows] == list(enumerate(texts))
    assert list(repository._pieces([], 10)) == []


def test_zip(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("top/x.py", "pass")
    assert repository.unzip(str(tmp_path / "a.zip"), str(tmp_path / "out")).endswith("out/top")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../x.py", "pass")
    with pytest.raises(ValueError):
        repository.unzip(str(tmp_path / "b.zip"), str(tmp_path / "out2"))
    with pytest.raises(ValueError):
        repository.local(str(tmp_path / "none"))


def graph(spark):
    nodes = spark.createDataFrame([("r", 1, "File", "a", "a.ts", None, None, None), ("r", 2, "Class", "T", "a.ts", 3, None, {"signature": "class T { id: string; name?: x }"}), ("r", 3, "Method", "go", "a.ts", 1, "U", None), ("s", 4, "File", "b", "b.ts", None, None, None)], "repo_id string, id long, label string, name string, file_path string, start_line int, class_name string, props map<string,string>")
    edges = spark.createDataFrame([("r", "DEFINES", 1, 2), ("r", "DEFINES", 1, 3)], "repo_id string, label string, src long, dst long")
    return PropertyGraph(nodes, edges)


def test_files_members_embeddings(spark):
    g = graph(spark)
    contents = spark.createDataFrame([("r", "a.ts", "typescript", "1\n2\n3\n4")], "repo_id string, file_path string, language string, content string")
    row = project.read_file(contents, g, "r", "a.ts", 2, 3).first()
    assert row["content"] == "2\n3" and [s["name"] for s in row["symbols"]] == ["go", "T"]
    assert {r["type_name"]: r["members"] for r in project.members(g.nodes).collect()} == {"U": ["go"], "T": ["id", "name"]}
    assert {r["id"] for r in project.embeddable(g).collect()} == {1, 2, 3, 4}


def test_lifecycle(spark, tmp_path):
    g = graph(spark)
    assert repo_exists(g, "s") and not repo_exists(drop_repo(g, "s"), "s")
    assert append(g, g.nodes.where("id = 4").withColumn("id", g.nodes["id"] + 1)).nodes.count() == 5
    g.write(str(tmp_path / "g"))
    assert PropertyGraph.read(spark, str(tmp_path / "g")).repo("r").nodes.count() == 3
    edges = spark.createDataFrame([(1, "x")], "id long, source_node string")
    more = project.add_edges(edges, spark.createDataFrame([(2, "y")], "id long, source_node string"))
    assert more.where("manual").count() == 1 and project.delete_edges(more, spark.createDataFrame([(1,)], "id long")).count() == 1
