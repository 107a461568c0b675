"""Near-duplicates of a similarity: copies with edits go, everything else stays."""

import random

import numpy as np

from codeloom.llm import near


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def text_of(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(10**6)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_groups(spark):
    rng = random.Random(1)
    rows, pairs, far = [], [], []
    for i in range(120):
        base = text_of(rng, rng.randint(60, 400))
        rows.append((10 * i, base))
        close, loose = edited(rng, base, 0.008), edited(rng, base, 0.15)
        if jaccard(base, close) >= 0.85:
            rows.append((10 * i + 1, close))
            pairs.append((10 * i, 10 * i + 1))
        rows.append((10 * i + 2, loose))
        far.append(10 * i + 2)
        if i % 10 == 0:
            rows += [(10 * i + 3, base), (10 * i + 3, base), (10 * i + 4, base.upper())]
    rows += [(9001, None), (9002, ""), (None, text_of(rng, 50)), (None, None)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, least int").repartition(4)
    kept = near.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids
    assert all(10 * i in ids for i in range(120)) and all(d in ids for d in far) and 9001 in ids and 9002 not in ids
    assert not any(10 * i + k in ids for i in range(0, 120, 10) for k in (3, 4))
    assert sum(b not in ids for _, b in pairs) >= 0.9 * len(pairs)
    assert near.drop_near_duplicates(df.limit(0)).count() == 0


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = text_of(rng, 300)
    rows = [(i, edited(rng, base, 0.004)) for i in range(600)] + [(1000 + i, text_of(rng, 100)) for i in range(50)]
    ids = {r["doc_id"] for r in near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {1000 + i for i in range(50)} <= ids and len(ids) <= 53 and 0 in ids


def test_the_spanning_forest_is_one_of_least_distances():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (6, 8), dtype=np.uint64)
    long = base[rng.integers(0, 6, 60)]
    for i in range(60):
        for bit in rng.integers(0, 512, rng.integers(0, 90)):
            long[i, bit // 64] ^= np.uint64(1 << int(bit) % 64)
    child, parent = near.spanning(long, 102)
    # Kruskal's way: pairs by distance; the sum of distances and the components are those of every least forest.
    distance = np.bitwise_count(long[:, None] ^ long[None]).sum(2, dtype=np.int64)
    root, total = list(range(60)), 0
    for d, i, j in sorted((int(distance[i, j]), i, j) for i in range(60) for j in range(i)):
        if d <= 102 and root[i] != root[j]:
            total += d
            root = [root[j] if x == root[i] else x for x in root]
    mine = list(range(60))
    for x, y in zip(child.tolist(), parent.tolist()):
        assert mine[x] != mine[y]
        mine = [mine[y] if r == mine[x] else r for r in mine]
    assert distance[child, parent].sum() == total and len({(a, b) for a, b in zip(root, mine)}) == len(set(root)) == len(set(mine))
    assert len(near.spanning(long[:1], 102)[0]) == 0


def test_bits_follow_the_similarity():
    rng = random.Random(4)
    for share, low, high in ((0.0, 0, 0), (0.02, 20, 120), (0.5, 160, 300)):
        a = text_of(rng, 500)
        bits = int(np.bitwise_count(near.majority(near.shingles(a.encode())) ^ near.majority(near.shingles(edited(rng, a, share).encode()))).sum())
        assert low <= bits <= high


def planted(rng, n, low, high):
    """n pairs of texts whose similarity lies from low to high, edits scattered."""
    out = []
    while len(out) < n:
        a = text_of(rng, rng.randint(40, 300))
        b = edited(rng, a, rng.choice([0.01, 0.02, 0.03, 0.04]))
        if low <= jaccard(a, b) < high:
            out.append((a, b))
    return out


def test_pairs_at_the_similarity_are_candidates():
    missed = 0
    for a, b in planted(random.Random(5), 500, 0.8, 0.9):
        x, y = (near.shingles(t.encode()) for t in (a, b))
        close = np.bitwise_count(near.majority(x) ^ near.majority(y)).sum() <= near.allowed_bits(0.8, near.DEVIATIONS)
        missed += not (close and (near.bands(x) == near.bands(y)).any())
    assert missed <= 2


def test_a_thousand_pairs(spark):
    """Recall and false links against true similarities: a thousand pairs from 0.8, a thousand below."""
    from codeloom.llm.simhash import fingerprint

    rng = random.Random(8)
    above, below = planted(rng, 1000, 0.8, 0.9), planted(rng, 1000, 0.6, 0.8)
    below = [(a, b) for a, b in below if (fingerprint(a.encode()) ^ fingerprint(b.encode())).bit_count() > 3]
    rows = list(enumerate(t for pair in above + below for t in pair))
    ids = {r["doc_id"] for r in near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    found = sum(2 * i + 1 not in ids for i in range(1000))
    assert found >= 990 and all(i in ids for i, _ in rows[2000:]) and all(2 * i in ids for i in range(1000))


def test_large_families_are_dealt_over_parts(spark, monkeypatch):
    """Copies that are like the text they were made from but not like each other, in lists of many parts."""
    monkeypatch.setattr(near, "HOT", 20)
    rng = random.Random(10)
    base = text_of(rng, 300)
    copies = []
    while len(copies) < 300:
        b = edited(rng, base, 0.015)
        if jaccard(base, b) >= 0.82:
            copies.append(b)
    rows = [(1000 - i, t) for i, t in enumerate([*copies, base])] + [(2000 + i, text_of(rng, 100)) for i in range(30)]
    ids = {r["doc_id"] for r in near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2000 + i for i in range(30)} <= ids and 700 in ids and len(ids) <= 34


def test_links_are_exact(spark):
    # Every pair at 0.8 or more loses a document and no pair below does, but where the operator's own fingerprints agree.
    from codeloom.llm.simhash import fingerprint

    rng = random.Random(6)
    rows, above, below = [], [], []
    while len(above) < 60 or len(below) < 120:
        a = text_of(rng, rng.randint(40, 300))
        b = edited(rng, a, rng.choice([0.02, 0.03, 0.04]))
        alike, same = jaccard(a, b), (fingerprint(a.encode()) ^ fingerprint(b.encode())).bit_count() <= 3
        i = len(rows)
        if 0.8 <= alike < 0.9:
            above.append(i + 1)
        elif 0.6 <= alike < 0.8 and not same:
            below.append(i + 1)
        else:
            continue
        rows += [(i, a), (i + 1, b)]
    ids = {r["doc_id"] for r in near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not ids & set(above) and set(below) <= ids


def test_a_refused_edge_does_not_part_a_group(spark):
    # Families at 0.6 to 0.8 of one another with near copies inside: groups are the components of all exact pairs.
    from codeloom.llm.simhash import fingerprint

    rng = random.Random(7)
    texts = []
    for _ in range(6):
        base = text_of(rng, 200)
        for _ in range(4):
            head = edited(rng, base, 0.03)
            texts += [head, *[edited(rng, head, 0.012) for _ in range(3)]]
    prints = [fingerprint(t.encode()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8 or (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    ids = {r["doc_id"] for r in near.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert ids == set(root)


def test_groups_of_the_tables_are_those_of_exact_pairs(spark, data):
    from codeloom.llm.simhash import fingerprint

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], shingles(r["text"] or ""), fingerprint((r["text"] or "").encode())) for r in docs.collect()]
    root = {d: d for d, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x, f) in enumerate(rows):
        for b, y, g in rows[:i]:
            if (f ^ g).bit_count() <= 3 or 10 * len(x & y) >= 8 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert {r["doc_id"] for r in near.drop_near_duplicates(docs).collect()} == {find(d) for d in root}


def exact_groups(texts):
    """The smallest index of each text's group, by all pairs."""
    from codeloom.llm.simhash import fingerprint

    sets, prints = [shingles(t) for t in texts], [fingerprint(t.encode()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 3):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


def crowded(rng, families, members):
    """Families whose pairs lie closely around the similarity, most of them below it."""
    texts = []
    for _ in range(families):
        words = text_of(rng, 240).split()
        for _ in range(members):
            mine = list(words)
            for at in rng.sample(range(240), 4):
                mine[at] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(mine))
    return texts


def kept_ids(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r["doc_id"] for r in near.drop_near_duplicates(df).select("doc_id").collect()}


def test_no_link_behind_refused_pairs_is_lost(spark):
    texts = crowded(random.Random(20), 40, 40)
    root = exact_groups(texts)
    assert 40 < len(set(root)) < len(texts)
    assert kept_ids(spark, texts) == set(root)


def test_links_that_no_list_of_minima_shows(spark, monkeypatch):
    """Groups are whole without the first pass too, few pairs tried at once and frequent shingles last."""
    monkeypatch.setattr(near, "candidates", lambda nodes, similarity: nodes.sparkSession.createDataFrame([], "child long, parent long"))
    monkeypatch.setattr(near, "TRIED", 1)
    monkeypatch.setattr(near, "MORE", 2)
    rng = random.Random(21)
    texts = crowded(rng, 6, 25) + [t for pair in planted(rng, 40, 0.75, 0.85) for t in pair] + ["a b c d e f", "a b c d e", "", "A  b c d e", "x"]
    assert kept_ids(spark, texts) == set(exact_groups(texts))


def test_prefixes_of_alike_sets_meet():
    rng = np.random.default_rng(22)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        pool = rng.choice(200, n + 12, replace=False).astype(np.uint64)
        a, b = np.sort(pool[: n + rng.integers(0, 4)]), np.sort(pool[rng.integers(0, 4) : n + rng.integers(0, 12)])
        frequent = np.sort(rng.choice(200, 80, replace=False)).astype(np.uint64)
        rank = rng.permutation(80)
        both = len(np.intersect1d(a, b))
        if len(b) and 10 * both >= 8 * (len(a) + len(b) - both):
            for f, r in ((frequent, rank), (frequent[:0], rank[:0])):
                assert len(np.intersect1d(near.prefix(a, 0.8, f, r), near.prefix(b, 0.8, f, r)))
        bits = int(np.bitwise_count(near.parities(a) ^ near.parities(b)).sum())
        assert bits <= len(np.setxor1d(a, b))
    assert [near.prefix_length(n, 0.8) for n in (1, 4, 5, 10, 15)] == [1, 1, 2, 3, 4]
