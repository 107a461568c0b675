"""Prefix tries, centroid clustering and nearest neighbours against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from codeloom.llm import ann, centroids, prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string"
VECTORS = "vec_id bigint, embedding array<double>"


def plain_trie(rows):
    """Every prefix of every rebuilt conversation in a dictionary."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append(((t is not None, t or 0, digest), (role, text)))
    turns = {c: [y for _, y in sorted(v)] for c, v in turns.items()}
    node, children = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        s = turns.get(base, [])[:h] + own[h:]
        for d in range(len(s) + 1):
            node[tuple(s[:d])].append((c, len(s) == d))
    for k in node:
        if k:
            children[k[:-1]].append(k)
    leaves, kept = {}, {}
    for k in sorted(node, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        kept[k] = (len(node[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(kept[x] for x in children[k])
    least = {k: min(c for c, _ in v) for k, v in node.items()}
    out = [
        (least[k], len(k), least[k[:-1]] if k else None, len(v), len(children[k]), leaves[k], kept[k], hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in v if e)).encode()).hexdigest())
        for k, v in node.items()
    ]
    return sorted(out, key=repr)


def made_turns(seed: int, roles, texts, lengths, ids=range(-120, 420)):
    r = random.Random(seed)
    return [(c, r.choice([t, t, t, None]), r.choice(roles), r.choice(texts)) for c in ids if r.random() > 0.05 for t in range(r.choice(lengths))]


@pytest.mark.parametrize(
    "rows",
    [
        made_turns(1, ["u", "a", None], ["x", "yy", "", None], [1, 2, 3, 7, 30]),
        made_turns(2, ["u"], ["x"], [1, 1, 2, 3, 60]),  # every conversation is a prefix of the longest
        made_turns(3, ["u"], ["x", "é" * 9], [1, 2, 9]),
        [(c, t, "u", "same") for c in range(1, 90) for t in range(8)],  # one list of ends over all blocks
        [(0, 0, None, None)],
        [(7, t, "u", "long " * 2000) for t in range(500)] + [(None, 0, "u", "x")] + [(8, 0, "u", "x")] * 3,
        [],
    ],
)
@pytest.mark.parametrize("blocks", ["1", "13"])
def test_trie_equals_all_prefixes(spark, rows, blocks):
    df = spark.createDataFrame(rows, TURNS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", blocks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in prefix_trie.nodes(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=repr) == plain_trie(rows)


def test_trie_rebuilds_in_spark_as_stated(spark):
    rows = [(100, t, "u", f"b{t}") for t in range(3)] + [(101, t, "u", f"o{t}") for t in range(7)] + [(205, 0, "u", "alone")]
    got = {r["conv_id"]: len(r["keys"]) // prefix_trie.KEY for r in prefix_trie.rebuilt(spark.createDataFrame(rows, TURNS)).collect()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in (101, 205)}
    assert got == {100: 3, 101: min(3, h[101]) + 7 - h[101], 205: max(0, 1 - h[205])}


def test_extra_columns_do_not_clash(spark):
    rows = spark.createDataFrame([(1, 0, "u", "x", "k", 3)], TURNS + ", keys string, block int")
    assert prefix_trie.nodes(rows).count() >= 1
    vectors = spark.createDataFrame([(0, [1.0, 2.0], "c", 1.0), (1, [1.0, 2.5], "c", 1.0)], VECTORS + ", cid string, score double")
    assert [(r["query_id"], r["vec_id"]) for r in ann.report(vectors).collect()] == [(0, 1)]
    both = spark.createDataFrame([(0, [1.0] * 64, 4, 5)], VECTORS + ", cluster int, id int")
    assert centroids.report(both).count() == 1


# --- Centroids -------------------------------------------------------------------------------


def plain_clusters(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * x) if abs(x) < 2**53 else int(x) * 64 for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    digest = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    centres = [v for _, v in sorted((digest(i), v) for i, v in kept)[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        sums = {}
        for _, v in kept:
            s = sums.setdefault(near(v)[0], [0, [0] * dim])
            s[0] += 1
            s[1] = [a + b for a, b in zip(s[1], v, strict=True)]
        centres = [[t // sums[c][0] for t in sums[c][1]] if c in sums else old for c, old in enumerate(centres)]
    out = [(i, *near(v)) for i, v in kept]
    inertia = {}
    for _, c, d in out:
        inertia[c] = inertia.get(c, 0) + d
    whole, fits = sum(inertia.values()), lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, fits(d), fits(inertia[c]), fits(whole), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in out), key=repr)


def random_vectors(n, seed=0, dim=64, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) / 8
    return (np.round(x * grid) / grid if grid else x).tolist()


@pytest.mark.parametrize(
    "rows",
    [
        list(enumerate(random_vectors(400))),
        list(enumerate(random_vectors(300, 1, grid=2))) + [(900 + i, [0.0] * 64) for i in range(200)],  # many ties, one vector often
        list(enumerate(random_vectors(5))),
        [],
        [(0, None), (1, []), (2, [1.0] * 63), (3, [1.0] * 65), (4, [float("nan")] + [0.0] * 63), (5, [float("inf")] + [0.0] * 63), (6, [None] + [0.0] * 63), (7, [-0.001] * 64), (7, [0.5] * 64), (None, [0.25] * 64)],
        list(enumerate(random_vectors(60))) + [(100, [1e300] + [0.0] * 63), (101, [3e6] * 64), (102, [-2.0**40] * 64), (103, [2.0**21 - 0.01] * 64), (104, [2.0**40 + i for i in range(64)])],
    ],
)
def test_clusters_equal_plain_integers(spark, rows):
    got = [tuple(r) for r in centroids.report(spark.createDataFrame(rows, VECTORS)).collect()]
    assert sorted(got, key=repr) == plain_clusters(rows)


def test_intervals_hold_the_exact_figure():
    rng = np.random.default_rng(3)
    for top in (3, 1 << 12, 1 << 20, (1 << 27) - 1):
        c = rng.integers(-top, top, (16, 64))
        v = rng.integers(-top, top, (500, 64))
        screen = centroids.Centroids(c.tolist())
        low, high = screen.bounds(v)
        exact = np.array([[int((x.astype(object) ** 2).sum() - 2 * (y.astype(object) * x.astype(object)).sum()) for x in c] for y in v], dtype=object)
        assert (low.astype(object) <= exact).all() and (exact <= high.astype(object)).all()


def test_most_rows_are_settled_by_float32(spark):
    v, _ = centroids.integers(np.array(random_vectors(2000)).ravel(), 64)
    low, high = centroids.Centroids(v[:16].tolist()).bounds(v)
    assert ((low <= high.min(axis=1, keepdims=True)).sum(axis=1) == 1).mean() > 0.9


def test_string_ids_travel(spark):
    rows = [(f"v{i}", v) for i, v in enumerate(random_vectors(40))]
    got = centroids.report(spark.createDataFrame(rows, "vec_id string, embedding array<float>")).collect()
    assert {r["vec_id"] for r in got} == {i for i, _ in rows}


# --- Neighbours ------------------------------------------------------------------------------


def plain_neighbours(rows, k=5, every=50):
    use = [(i, np.array(v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in use), default=0)
    use = [(i, np.pad(v, (0, width - len(v)))) for i, v in use]
    use = [(i, v / np.abs(v).max()) for i, v in use]
    use = [(i, v / np.sqrt((v * v).sum())) for i, v in use]
    out = []
    for q, v in use:
        if q is None or q % every:
            continue
        near = sorted(((-round(float((v * w).sum()), 12), i is None, i or 0, i) for i, w in use if i != q))
        out += [(q, n, x[3]) for n, x in enumerate(near[:k], 1)]
    return sorted(out, key=repr)


def listed(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(0, [1.0, 0.0])],
        [(0, None), (50, []), (100, [0.0, 0.0]), (150, [float("nan"), 1.0]), (200, [None, 1.0]), (250, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [4.0, 8.0]), (None, [1.0, 2.0])],
        [(i, v) for i, v in enumerate(random_vectors(30, 4, 8))],
        [(i, [1.0, 2.0, -0.0]) for i in range(400)] + [(400 + i, [float(i), 1.0, 0.0]) for i in range(100)],  # one vector four times in five
        [(i // 2, [1.0, float(i // 2 % 7)]) for i in range(300)],  # each row twice
        [(0, [1e-200, 0.0]), (1, [1e200, 1e199]), (2, [3e-310, 0.0]), (50, [5.0, 1.0, 2.0, 7.0])],
    ],
)
def test_neighbours_of_small_and_odd_tables(spark, rows):
    """With these few vectors the radius widens until nothing is missing, so the lists are exact."""
    got = ann.search(spark.createDataFrame(rows, VECTORS), "vec_id % 50 = 0", reach=ann.BITS)
    assert listed(got) == plain_neighbours(rows)
    assert {r for r, *_ in listed(ann.report(spark.createDataFrame(rows, VECTORS)))} == {r for r, *_ in plain_neighbours(rows)}


def test_recall_and_scores(spark):
    rows = list(enumerate(random_vectors(3000, 7)))
    rows += [(3000 + i, (np.array(rows[i][1]) + np.array(v) * 0.05).tolist()) for i, v in enumerate(random_vectors(200, 8))]
    want = plain_neighbours(rows)
    got = ann.report(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == len(want)
    assert len({(r["query_id"], r["vec_id"]) for r in got} & {(q, v) for q, _, v in want}) >= 0.9 * len(want)
    at = dict(rows)
    for r in got[::17]:
        a, b = np.array(at[r["query_id"]]), np.array(at[r["vec_id"]])
        assert r["score"] == pytest.approx(float(a @ b / math.sqrt((a @ a) * (b @ b))), abs=1e-14)


@pytest.mark.parametrize("reach", [0, 7, 20, 33])
def test_every_code_within_the_radius_is_found_once(reach):
    """Cells of all places together yield the pairs that a comparison of all codes yields."""
    import pyarrow as pa

    rng = np.random.default_rng(reach)
    vec = rng.normal(size=(600, 16))
    codes = ann.Coder(vec).codes(pa.array(vec.tolist()))
    codes[100:200] = codes[100]
    asked = codes[::20]
    table = pa.table({"cid": np.arange(600), "code": codes.view(np.int64), "vec": vec.tolist(), "members": [[{"id": i, "n": 1}] for i in range(600)]})
    want = {(q, r) for q in range(len(asked)) for r in range(600) if int(asked[q] ^ codes[r]).bit_count() <= reach}
    got = []
    for bits in (0, 2):
        got = []
        for part in range(ann.PARTS):
            head = (codes >> np.uint64((ann.PARTS - 1 - part) * ann.WIDTH + ann.WIDTH - bits)) & np.uint64((1 << bits) - 1)
            for prefix in range(1 << bits):
                here = table.filter(pa.array(head == prefix))
                if not here.num_rows:
                    continue
                cell = ann.Cell(here, part, prefix, bits, reach, 5)
                ids = cell.table.column("cid").to_numpy()
                for q, code in enumerate(asked):
                    away = int(((int(code) >> ((ann.PARTS - 1 - part) * ann.WIDTH + ann.WIDTH - bits)) & ((1 << bits) - 1)) ^ prefix).bit_count()
                    if away <= min(bits, reach // ann.PARTS):
                        _, rows = cell.pairs(np.array([code]), reach // ann.PARTS - away)
                        got += [(q, int(ids[r])) for r in rows]
        assert len(got) == len(set(got)) and set(got) == want
