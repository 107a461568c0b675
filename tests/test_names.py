"""Names alike by edit distance against all pairs."""

from __future__ import annotations

import random

import pytest

from codeloom.operators import names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b):
    a, b = a.lower(), b.lower()
    return 1 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0


def made(seed, n=160):
    r = random.Random(seed)
    out = {"", "a", "B", "ab", "getUser", "getUsers", "setUser", "GETUSER", "x" * 40, "x" * 31 + "y" * 9}
    while len(out) < n:
        w = r.choice(sorted(out)) if r.random() < 0.6 else "".join(r.choice("abcd") for _ in range(r.randrange(1, 18)))
        for _ in range(r.randrange(0, 4)):
            i = r.randrange(len(w) + 1)
            w = r.choice([w[:i] + r.choice("abcD") + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice("abcd") + w[i + 1 :]])
        out.add(w)
    return sorted(out)


@pytest.mark.parametrize(("least", "seed"), [(0.7, 1), (0.55, 2), (0.9, 3), (1.0, 4)])
def test_all_pairs_are_found(spark, least, seed):
    left, right = made(seed), made(seed + 50)
    df = lambda rows, c: spark.createDataFrame([("k", x) for x in rows] + [("k", None), ("other", rows[3])], f"k string, {c} string")
    got = {(r["a"], r["b"]) for r in names.similar_names(df(left, "a"), df(right, "b"), ["k"], least).where("k = 'k'").collect()}
    assert got == {(a, b) for a in left for b in right if similarity(a, b) >= least}


def test_links_and_bounds(spark):
    rows = made(9, 80)
    got = {r["name"]: r["links"] for r in names.name_links(spark.createDataFrame([("k", x) for x in rows * 2], "k string, name string"), ["k"]).collect()}
    assert got == {a: sum(b != a and similarity(a, b) >= 0.7 for b in rows) for a in rows}
    with pytest.raises(ValueError):
        names.similar_names(None, None, [], 0.5)


def test_unlike_names_do_not_meet():
    """Of 3,000 names without likeness few pairs share a segment, where all pairs would be 4.5 million."""
    r = random.Random(3)
    made_up = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(16)) for _ in range(3000)]
    short, pairs = {}, set()
    for x in made_up:
        for longer, *key in names.segments(x, [16], 0.8):
            if not longer:
                short.setdefault(tuple(key), []).append(x)
    for y in made_up:
        for longer, *key in names.segments(y, [16], 0.8):
            if longer:
                pairs |= {(x, y) for x in short.get(tuple(key), ()) if x < y}
    assert len(pairs) < 20_000
