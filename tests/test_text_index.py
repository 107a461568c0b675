"""The stored index against scans of the texts."""

from __future__ import annotations

import random
import re

import pytest

from codeloom.operators import text, text_index


@pytest.fixture(scope="module")
def files(spark):
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "Über", "x_1"]
    rows = [("r", f"f{i:03d}", " ".join(r.choices(words, [8, 4, 2, 1, 1, 1], k=r.randrange(1, 60)))) for i in range(300)]
    return [*rows, ("r", "null", None), ("r", "empty", ""), ("s", "f000", "beta, ALPHA beta-alpha"), ("s", "long", "alpha " * 5000 + "delta")]


@pytest.fixture(scope="module")
def built(spark, files, tmp_path_factory):
    df = spark.createDataFrame(files, "repo_id string, file_path string, content string")
    folder = str(tmp_path_factory.mktemp("index") / "t")
    text_index.build(df, folder, docs=20)
    return df, text_index.open_index(spark, folder)


@pytest.mark.parametrize("query", ["alpha", "delta beta", "alpha beta gamma delta", "x_1 über", "nothing", "alpha nothing", "", "The ALPHA"])
@pytest.mark.parametrize("limit", [3, 1000])
def test_search_and_total_equal_a_scan(built, query, limit):
    df, index = built
    rows = lambda d: [(r["repo_id"], r["file_path"], pytest.approx(float(r["score"]), abs=1.1e-4)) for r in d.collect()]
    assert rows(text_index.search(index, query, limit)) == rows(text.keyword_search(df, query, limit))
    assert text_index.total(index, query).first()["total"] == text.keyword_total(df, query).first()["total"]


@pytest.mark.parametrize("words", ["alpha beta", "beta alpha beta", "alpha alpha", "delta", "none here"])
def test_phrases(built, files, words):
    got = {(r["repo_id"], r["file_path"]): r["times"] for r in text_index.phrase(built[1], words).collect()}
    want = {}
    for repo, path, content in files:
        t, w = re.findall(r"\w+", (content or "").lower()), words.split()
        n = sum(t[i : i + len(w)] == w for i in range(len(t) - len(w) + 1))
        if n:
            want[repo, path] = n
    assert got == want


def test_a_search_reads_its_terms_and_best_blocks_only(spark, tmp_path):
    """One block has files that are far better; the others' lists stay unread."""
    rows = [("r", f"f{i}", "common " + "other " * 30) for i in range(200)] + [("r", f"best{i}", "common " * 9) for i in range(3)]
    folder = str(tmp_path / "t")
    text_index.build(spark.createDataFrame(rows, "repo_id string, file_path string, content string"), folder, docs=10)
    index = text_index.open_index(spark, folder)
    plan = text_index._rows(index, ["common"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [(folder" in plan
    assert re.search(r"PushedFilters: \[[^\]]*(EqualTo|In)\(term", plan)
    q = text_index._Query(index, "common")
    bounds = sorted((r["bound"] for r in q.bounds().collect()), reverse=True)
    found = text_index.search(index, "common", 3).collect()
    assert {r["file_path"] for r in found} == {"best0", "best1", "best2"}
    assert sum(b >= found[-1]["score"] - 1e-4 for b in bounds) <= 3 < len(bounds)


def test_a_block_of_many_tokens_is_ended_between_files():
    """A block's rows leave whole; no posting is shuffled."""
    import pyarrow as pa

    given = [("r", "a", 0, ["x", "y", "x"]), ("r", "b", 0, []), ("r", "c", 0, ["y"]), ("r", "a", 1, ["x"])]
    batch = pa.RecordBatch.from_arrays([*(pa.array([g[i] for g in given]) for i in range(3)), pa.array([2] * 4), pa.array([g[3] for g in given], pa.list_(pa.string()))], names=["repo_id", "file_path", "block", "blocks", "t"])
    rows = lambda: sorted((r["term"], r["block"], r["n"], r["most"], r["shortest"], r["lengths"], [(f["file_path"], f["len"], f["tf"], f["positions"]) for f in r["files"]]) for b in text_index._postings([batch]) for r in b.to_pylist())
    assert rows() == [
        ("", 0, 3, 1, 0, 4, [("a", 3, 1, [-1]), ("b", 0, 1, [-1]), ("c", 1, 1, [-1])]),
        ("", 1, 1, 1, 1, 1, [("a", 1, 1, [-1])]),
        ("x", 0, 1, 2, 3, 3, [("a", 3, 2, [0, 2])]),
        ("x", 1, 1, 1, 1, 1, [("a", 1, 1, [0])]),
        ("y", 0, 2, 1, 1, 4, [("a", 3, 1, [1]), ("c", 1, 1, [0])]),
    ]
    whole, text_index.GATHERED = text_index.GATHERED, 1
    try:
        assert {(r[0], r[1]) for r in rows()} == {("", 0), ("x", 0), ("y", 0), ("", 2), ("y", 2), ("", 1), ("x", 1)}
    finally:
        text_index.GATHERED = whole
