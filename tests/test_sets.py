"""Set joins against all pairs compared."""

from __future__ import annotations

import random

import pytest

from codeloom.operators import crossrepo, sets

SCHEMA = "k string, id long, items array<string>"


def made(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(14)]
    weights = [60, 30, 15, 8, *[2] * 10]
    return [(r.choice("xy"), i, r.choices(words, weights, k=r.randrange(0, 9))) for i in range(n)]


def alike(a, b, tenths):
    a, b = set(a or []) - {None}, set(b or []) - {None}
    return bool(a and b) and len(a & b) * 10 >= len(a | b) * tenths


@pytest.mark.parametrize("tenths", [3, 6, 7, 10])
def test_candidates_hold_all_similar_pairs(spark, tenths):
    rows = made(tenths)
    a, b = [r for r in rows if r[1] % 2], [r for r in rows if r[1] % 2 == 0] + [("x", 1000, None), ("x", 1002, ["w1", None])]
    got = [tuple(r) for r in sets.similar_candidates(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["k"], tenths).collect()]
    assert len(got) == len(set(got))
    assert {(x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and alike(x[2], y[2], tenths)} <= set(got)


def test_links_equal_all_pairs(spark):
    rows = [*made(9), ("x", 1000, None), ("x", 1001, []), ("x", 1002, ["w1", None, "w1"])]
    got = {(r["k"], r["id"]): (r["class_id"], r["links"]) for r in sets.set_links(spark.createDataFrame(rows, SCHEMA), ["k"], 6).collect()}
    same = lambda x, y: bool(set(x[2] or []) - {None}) and set(x[2] or []) - {None} == set(y[2] or []) - {None}
    assert got == {(x[0], x[1]): (min([y[1] for y in rows if y[0] == x[0] and same(x, y)], default=x[1]), sum(y[0] == x[0] and y[1] != x[1] and alike(x[2], y[2], 6) for y in rows)) for x in rows}
    assert sets.set_links(spark.createDataFrame([], SCHEMA), ["k"], 6).count() == 0


def test_a_common_word_makes_no_block(spark):
    """All 3,000 sets have one word, and each has two of its own: none is a candidate of another."""
    df = spark.range(3000).selectExpr("'x' AS k", "id", "array('common', concat('a', id), concat('b', id)) AS items")
    assert sets.similar_candidates(df, df.withColumn("id", df["id"] + 10000), ["k"], 6).count() == 3000


def test_types_equal_all_pairs(spark):
    r = random.Random(5)
    words, members = ["User", "Order", "Service", "Item", "View", "DTO"], list("abcdefgh")
    name = lambda: "".join(r.choices(words, [2, 2, 6, 1, 1, 1], k=r.randrange(1, 5)))
    row = lambda i: ("k", i, r.choice(["I", ""]) + name() + r.choice(["", "Impl"]), r.choice(["Class", "Interface", "Enum", None]), r.choice([None, "struct", "x"]), r.choice([True, True, True, False, None]), r.choice([None, r.sample(members, r.randrange(0, 7)), ["A", "b", "c"]]), "p")
    schema = "k string, id long, name string, label string, element_type string, exported boolean, members array<string>, file_path string"
    a = spark.createDataFrame([row(i) for i in range(60)] + [("k", 90, None, "Class", None, True, ["a", "b"], "p"), ("k", 91, "", "Class", None, True, None, "p")], schema)
    b = spark.createDataFrame([row(i) for i in range(100, 160)] + [("k", 190, None, "Class", None, True, ["a", "b"], "p"), ("k", 191, "", "Class", None, True, None, "p")], schema)
    from pyspark.sql import functions as F

    got = sorted((x["source_id"], x["target_id"], float(x["confidence"])) for x in crossrepo.type_pairs(a, b, ["k"]).collect())
    every = a.select(F.struct("*").alias("s")).crossJoin(b.select(F.struct("*").alias("t"))).withColumn("c", crossrepo.type_score()).where("c is not null")
    assert got == sorted((x["s"]["id"], x["t"]["id"], float(x["c"])) for x in every.collect())
    assert len(got) > 100
