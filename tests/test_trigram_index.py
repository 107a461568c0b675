"""Conditions of patterns, and grep through stored trigrams against a scan."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.operators import text, trigram_index as ti

FOLD = str.maketrans(ti._UPPER, ti._UPPER.lower())


def grams(s):
    s = s.translate(FOLD)
    return {s[i : i + 3] for i in range(len(s) - 2)}


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("abc", "abc"),
        ("ABCD", ("and", "abc", "bcd")),
        ("(abc|xyz)", ("or", "abc", "xyz")),
        ("ab[cd]", ("or", "abc", "abd")),
        ("abc.*xyz", ("and", "abc", "xyz")),
        ("ab?cd", ("or", "acd", ("and", "abc", "bcd"))),
        ("x(abc)+y", "abc"),
        ("a{4}", "aaa"),
        ("abc(?=xyz)", ("and", "abc", "xyz")),
        ("abc(?!xyz)", "abc"),
        ("^abc$", "abc"),
        ("a\\.bc", ("and", ".bc", "a.b")),
    ],
)
def test_conditions(pattern, want):
    assert ti.condition(pattern) == want


@pytest.mark.parametrize("pattern", ["", "a.b", "[0-9]+", "abc|x", "(abc)*", "[^a]bc", "(a)\\1abc", "[a[bc]]def", "[a-z&&[b]]cde", "(?x) a b c", "(?u)abc", "\\vabc", "[]abc]def"])
def test_no_condition(pattern):
    assert ti.condition(pattern) is None


def test_bad_pattern():
    with pytest.raises(ValueError):
        ti.condition("(abc")


atoms = st.sampled_from(["a", "b", "C", ".", "[ab]", "[^a]", "\\w", "ab", "bca", "(?:ab|c)", "(a|bc|)", "é", "\\."])
pieces = st.tuples(atoms, st.sampled_from(["", "", "", "?", "*", "+", "{2}", "{1,3}", "+?"])).map(lambda p: f"(?:{p[0]}){p[1]}" if p[1] else p[0])
sequences = st.lists(pieces, min_size=1, max_size=6).map("".join)
patterns = st.lists(sequences, min_size=1, max_size=3).map("|".join)


@settings(max_examples=400, deadline=None)
@given(patterns, st.text("abcCé. ", max_size=14))
def test_every_match_satisfies_the_condition(pattern, s):
    for flags in (0, re.I | re.A if pattern.isascii() else 0):
        if re.search(pattern, s, flags):
            assert ti.holds(ti.condition(pattern), grams(s))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    r = random.Random(4)
    words = ["alpha", "beta", "Gamma", "delta=1", "straße", "x_1", "😀ok", "\n", "\n"]
    rows = [("r", f"f{i:03d}", " ".join(r.choices(words, [8, 4, 2, 1, 1, 1, 1, 3, 3], k=r.randrange(1, 40))), i) for i in range(400)]
    rows += [("r", "null", None, 1), ("r", "empty", "", 2), ("r", "short", "xy", 3), ("s", "f000", "GAMMA needle", 4), ("s", "f000", "another needle", 5), ("s", "long", "alpha " * 20000 + "haystack", 6)]
    df = spark.createDataFrame(rows, "repo_id string, file_path string, content string, block long")
    folder = str(tmp_path_factory.mktemp("trigrams") / "t")
    ti.build(df, folder, files=30)
    return df, ti.open_index(spark, folder)


@pytest.mark.parametrize("pattern, ignore", [("needle", False), ("gamma", True), ("delta=1 (alpha|beta)", False), ("haystack$", False), ("straße|😀ok x", False), ("[0-9]", False), ("nothing", False)])
def test_grep_equals_a_scan(built, pattern, ignore):
    df, index = built
    rows = lambda d: sorted(map(repr, map(tuple, d.collect())))
    want = rows(text.grep(df, pattern, ignore, context=1, limit=None))
    assert rows(ti.grep(index, pattern, ignore, context=1, limit=None)) == want
    said = ti.searched(index, pattern, ignore).first()
    cond = ti.condition(pattern)
    assert said["prefilter"] == ("none" if cond is None else "trigrams")
    assert said["files"] == df.count()
    assert said["files_read"] == sum(cond is None or ti.holds(cond, grams(r[0] or "")) for r in df.where("file_path != 'f000' or repo_id != 's'").select("content").collect()) + (2 if cond is None or any(ti.holds(cond, grams(c)) for c in ("GAMMA needle", "another needle")) else 0)
    assert said["files_hit"] <= said["files_read"]


def test_glob_and_limit(built):
    df, index = built
    rows = lambda d: list(map(repr, map(tuple, d.collect())))
    assert rows(ti.grep(index, "alpha", glob="f0*", limit=5)) == rows(text.grep(df, "alpha", glob="f0*", limit=5))


def test_rare_patterns_read_few_folders(built):
    _, index = built
    plan = ti.texts_to_read(index, "haystack")
    assert plan.count() == 1
    assert len(plan.select("part").distinct().collect()) == 1
    assert all("part=" in f for f in plan.inputFiles()) and len({f.split("part=")[1].split("/")[0] for f in plan.inputFiles()}) <= 1 + index.grams.select("folder").distinct().count()


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "repo_id string, file_path string, content string")
    ti.build(df, f"{tmp_path}/t")
    grams_, texts = spark.read.schema("gram string, block long, files array<bigint>, parts int, folder int").parquet(f"{tmp_path}/t/grams"), spark.read.schema("repo_id string, file_path string, content string, file long, part int").parquet(f"{tmp_path}/t/texts")
    index = ti.Index(grams_, texts)
    assert ti.grep(index, "abc").count() == 0
    assert ti.searched(index, "abc").first()["files"] == 0


def test_a_block_of_many_trigrams_is_ended_between_files():
    """lists leave whole, by block; no posting is shuffled."""
    import pyarrow as pa

    rows = [(f, b, 2, t) for b, f, t in [(0, 1, "abcd"), (0, 2, "abce"), (0, 2, "zabc"), (0, 3, "abc"), (1, 9, "abc"), (1, 9, "abc")]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["file", "block", "blocks", "content"])
    out = lambda: [tuple(r.values()) for b in ti._postings([batch]) for r in b.to_pylist()]
    assert sorted(out()) == [("abc", 0, [1, 2, 3]), ("abc", 1, [9]), ("bcd", 0, [1]), ("bce", 0, [2]), ("zab", 0, [2])]
    whole, ti.GATHERED = ti.GATHERED, 1
    try:
        found = sorted(out())
    finally:
        ti.GATHERED = whole
    assert found == [("abc", 0, [1]), ("abc", 1, [9]), ("abc", 2, [2]), ("abc", 4, [3]), ("bcd", 0, [1]), ("bce", 2, [2]), ("zab", 2, [2])]
