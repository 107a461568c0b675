"""The corpus operators over documents against plain Python, with nulls, ties, repeats, long texts and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import decontam, lm, packing, quality, secrets, simhash, token_counts, token_store
from codeloom.llm.common import tokenizer

WORDS = "the of and thst erin Öl été x1 a b".split()


def made(n: int, seed: int) -> list[tuple]:
    """Documents with words of a small set, so that shingles and windows repeat; copies, junk, nulls."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = i % 9
        text = " ".join(rng.choices(WORDS, k=rng.randint(0, 90)))
        if kind == 1:
            text = None
        elif kind == 2:
            text = rng.choice(["", " \n\t ", "a", "A b", "…é"])
        elif kind == 3 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 4:
            text = "".join(rng.choice(["a ", "B.", "\n", "\x85", "#", "\t", "é", "'s", "\xa0", "<|endoftext|>", "1 "]) for _ in range(60))
        rows.append((i if i % 25 else None, text))
    return rows + rows[:3]


@pytest.fixture(scope="module")
def rows():
    return made(160, 1) + [(9000, " ".join(random.Random(2).choices(WORDS, k=60_000)))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns that clash with names the operators use."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "z") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, t string").repartition(3)


def tally(rows):
    return collections.Counter(tuple(r) for r in rows)


def words_ws(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# --- 1 -------------------------------------------------------------------------------------


def brute_decontam(rows, items, window=10):
    rx = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    parts = [(i, rx.findall(lowered(t))) for i, t in items]
    out = []
    for d, t in rows:
        w = rx.findall(lowered(t))
        hit, found = set(), set()
        for item, x in parts:
            n = min(window, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found.add(item)
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def bench_rows(rows):
    long = next(t for _, t in rows if t and len(words_ws(t)) > 60)
    return [(1, " ".join(words_ws(long)[5:40])), (2, "thst erin ÖL"), (10, "x1 x1 x1 x1 x1 x1 x1 x1 x1 x1 x1 x1"), (3, None), (4, " ., "), (None, "a b a b"), (2, "thst erin ÖL"), (5, " ".join(words_ws(long)[20:31]))]


@pytest.mark.parametrize("block_words", [200_000, 20])
def test_decontamination(spark, docs, rows, block_words):
    items = bench_rows(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.scan(docs.select("doc_id", "text"), bench, block_words=block_words)
    got = found.select("id", "n_words", decontam.hit_words().alias("h"), F.size("items").cast("long"), F.sha2(F.concat_ws(",", "items"), 256), F.size("spans") > 0)
    assert tally(got.collect()) == tally(brute_decontam(rows, items))


def test_many_blocks(spark, docs, rows):
    """Fifty blocks of a benchmark and one give alike; the driver holds one block at a time."""
    texts = [t for _, t in rows if t and len(words_ws(t)) > 60]
    items = [(i, " ".join(words_ws(texts[i % len(texts)])[i % 30 : i % 30 + 12])) for i in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontam.blocks(bench, block_words=1)) == 50 and len(decontam.blocks(bench)) == 1
    keys = ["id", "n_words", "spans", "items"]
    one, many = (tally(map(repr, decontam.scan(docs, bench, block_words=n).select(*keys).collect())) for n in (10**6, 1))
    assert one == many
    whole, parted = (tally(map(tuple, decontam.decontaminate(docs, bench, block_words=n).collect())) for n in (10**6, 1))
    assert whole == parted


def test_decontamination_removes_spans(spark, docs, rows):
    items = bench_rows(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = decontam.decontaminate(docs, bench, max_coverage=0.5)
    assert clean.columns == docs.columns
    left = {(r[0], r[1]): r for r in clean.collect()}
    report = brute_decontam(rows, items)
    assert sum(r[2] <= 0.5 * r[1] for r in report) == clean.count()
    for (d, text), r in zip(rows, report):
        if r[2] == 0:
            assert (d, text) in left
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    assert decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0
    split = spark.createDataFrame([(1, "p q r s t u v w x y z a b c d e f g h i j " + "one two three four five A B C D E F G H I J six seven eight nine ten")], "doc_id long, text string")
    both = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert decontam.decontaminate(split, both).first()["text"] == "p q r s t u v w x y z"
    assert decontam.cut("Say: one two three, end", [[1, 3]]) == "Say: three, end"


# --- 2, 6, 7 ---------------------------------------------------------------------------------


def test_token_counts(docs, rows):
    model = tokenizer(token_counts.default_path())
    want = [(d, len((t or "").encode()), n := len(model.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows]
    got = token_counts.count_tokens(docs, token_counts.default_path(), piece_bytes=500, batch_bytes=900)
    assert tally(got.collect()) == tally(want)
    assert token_counts.count_tokens(docs.limit(0), token_counts.default_path()).count() == 0


def test_pieces_are_safe():
    rng = random.Random(4)
    model = tokenizer(token_counts.default_path())
    for _ in range(300):
        t = "".join(rng.choice(["a", " ", "  ", "\n", " b", "'s", "é", ".", " .", "\t", "1", "字", "\u3000", "²", "\x1c", "<|endoftext|>"]) for _ in range(120))
        parts = token_counts.pieces(t, 10, token_counts.safe_specials(token_counts.default_path()))
        assert "".join(parts) == t
        assert sum(len(model.encode(p, add_special_tokens=False).ids) for p in parts) == len(model.encode(t, add_special_tokens=False).ids)
    assert token_counts.batches([5, 5, 50, 1], 10) == [(0, 2), (2, 3), (3, 4)]
    # Lines without spaces are cut, one long word isn't; sizes are bytes.
    assert max(len(p) for p in token_counts.pieces("ab\n" * 100_000, 65_536)) < 65_600 and token_counts.pieces("字" * 300_000, 65_536) == ["字" * 300_000]
    assert {len(p.encode()) for p in token_counts.pieces("字 " * 1000, 400)[:-1]} == {403, 400} and token_counts.safe_specials(packing.default_path()) is None


def test_an_encoder_of_another_kind_gets_whole_texts():
    import pyarrow as pa

    from codeloom.llm.token_ids import ChunkEncoder

    for path, chunked in ((token_counts.default_path(), False), (packing.default_path(), True)):
        encoder, texts = ChunkEncoder(path), ["Hello big World", None, "", "don't  stop\n<|endoftext|>Now"]
        ids, counts = encoder.encode(pa.array(texts))
        assert encoder.chunked == chunked and counts.tolist() == [len(tokenizer(path).encode(t or "", add_special_tokens=False).ids) for t in texts]
        assert ids.tolist() == [x for t in texts for x in tokenizer(path).encode(t or "", add_special_tokens=False).ids]


def want_ids(rows):
    model = tokenizer(packing.default_path())
    return [(d, [*model.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, rows):
    got = packing.report(docs, packing.default_path(), window=256).collect()
    want = collections.Counter()
    for d, ids in want_ids(rows):
        for a in range(0, len(ids), 256):
            want[d, a, len(ids[a : a + 256]), crc(ids[a : a + 256]), len(ids)] += 1
    assert tally((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        total += at
    assert total / (256 * len(held)) > 0.97
    assert packing.report(docs.limit(0), packing.default_path()).count() == 0


def test_sequences(docs):
    pieces = packing.encode_pieces(docs, packing.default_path(), 256)
    packed = packing.sequences(packing.pack(pieces, 160, 256), 256)
    for r in packed.collect():
        assert len(r["ids"]) == 4 * r["length"] and r["padding"] in (0, 256 - r["length"])


def test_best_fit_is_tightest():
    rng = random.Random(3)
    lengths = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    windows, offsets = packing.best_fit_decreasing(lengths, 100)
    free: list[int] = []
    for n, w, at in zip(lengths, windows, offsets):
        fits = [c for c in free if c >= n]
        if fits:
            assert free[w] == min(fits) and at == 100 - free[w]
            free[w] -= n
        else:
            assert w == len(free) and at == 0
            free.append(100 - n)


def test_token_files(spark, docs, rows, tmp_path):
    folder = f"file://{tmp_path}/ids"
    token_store.write(docs, folder, packing.default_path(), segment_ids=500)
    got = token_store.read(spark, folder, with_ids=True).collect()
    want, at = [], 0
    for d, ids in sorted(want_ids(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((d, len(ids)))
    assert tally((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == tally((d, len(ids), crc(ids)) for d, ids in want_ids(rows))
    assert tally((r["doc_id"], bytes(r["ids"])) for r in got) == tally((d, np.array(ids, "<u4").tobytes()) for d, ids in want_ids(rows))
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [d for d, _ in want]
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_store.report(docs.limit(0), packing.default_path()).count() == 0


# --- 3 -------------------------------------------------------------------------------------

SECRETS = [
    (1, 'x password=abcdefghijkl "token" : \'0123456789abcdef0123\' passwd = short'), (2, None), (3, ""), (4, "AKIA" + "Q" * 16 + " AKIA12 é AKIA" + "Z" * 14), (5, "API_KEY: " + "k" * 30 + " apikey=" + "9" * 12), (6, "deadbeef" * 3 + " DEADBEEF " + "0" * 15),
    (7, "TOKEN=token=abcdefghijklmno"), (8, "é" * 50 + " secret:aaaaaaaaaaaa"), (9, "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop"),
]


def brute_spans(text):
    text = text or ""
    rx = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end(), "assign") for m in rx.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_secrets(spark, docs, rows):
    both = [*SECRETS, *rows]
    df = spark.createDataFrame(both, "doc_id long, text string")
    want = []
    for d, t in both:
        s = brute_spans(t)
        n = [sum(k == x for *_, k in s) for x in ("assign", "access", "hex")]
        want.append((d, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in s).encode()).hexdigest()))
    got = secrets.report(df)
    assert tally(got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()) == tally(want)
    assert secrets.report(df.limit(0)).count() == 0
    clean = secrets.redact_secrets(df.withColumn("n_chars", F.lit(0).cast("long")))
    left = tally((r["text"], r["n_chars"]) for r in clean.collect())
    assert left["é" * 50 + " [secret]", 59] == 1 and left[None, None] == sum(t is None for _, t in both)


@pytest.fixture(scope="module")
def net():
    return secrets.trained()


def test_network_finds_what_patterns_miss(net):
    # Both the kinds it was trained on and those that only calibration had, from other seeds.
    for fresh, least, most in ((False, 0.88, 0.02), (True, 0.9, 0.2)):
        found = collections.defaultdict(list)
        for before, value, after, y in secrets.findings(800, 5, fresh):
            found[y].append(secrets.score([before + value + after], [(0, len(before), len(before) + len(value))], net)[0] >= net.threshold)
        assert np.mean(found[1]) >= least and np.mean(found[0]) <= most
    text = "see ghp_" + "aB3dE5gH7jK9mN1pQ2rS4tU6vW8xY0zA1bC3" + " and the-quite-long-name-of-a-page-12"
    assert [(k, text[a:b][:4]) for a, b, k in secrets.find([text], net)[0]] == [("model", "ghp_")]


def test_long_strings_are_read_whole(net):
    key = "ghp_" + "aB3dE5gH7jK9mN1pQ2rS4tU6vW8xY0zA1bC3"
    path = f"/srv/app/config/production/{key}/settings/of/the/machine.json"
    for text in (path, "x" + "/lo-men/nor" * 500 + path, f"AKIA{'Q' * 16}.{key}", f"{'ab12' * 5}/{key}="):
        at = text.index("ghp_")
        assert (at, at + len(key), "model") in secrets.find([text], net)[0]
    assert secrets.windows(3, 20) == [(3, 20)] and secrets.windows(0, 100) == [(0, 40), (20, 60), (40, 80), (60, 100)] and secrets.windows(0, 41) == [(0, 40), (1, 41)]
    for n in (40, 41, 79, 80, 1000):
        assert {i for a, b in secrets.windows(0, n) for i in range(a, b)} == set(range(n))


def brute_model_spans(text, net):
    """Every candidate scored by itself, window by window."""
    out = []
    probability = lambda a, b: max(net.probability(np.array([secrets._coded(text[max(0, x - 24) : x], text[x:y], text[y : y + 8])]), np.array([secrets._shape(text[x:y])]))[0] for x, y in secrets.windows(a, b))
    for a, b, parts in secrets.candidates(text, secrets.base_spans(text)):
        found = [(x, y) for x, y in parts if probability(x, y) >= net.threshold]
        out += found or [(a, b)] * int(probability(a, b) >= net.threshold)
    return sorted(out)


def test_model_spans_against_brute_force(spark, net, rows):
    import random

    rng = random.Random(3)
    texts = [" ".join(b + v + a for b, v, a, _ in rng.sample(secrets.findings(300, 21, i % 2 > 0), 6)) for i in range(40)] + [t or "" for _, t in rows[:40]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.report(df).collect()}
    model = 0
    for i, t in enumerate(texts):
        want = brute_model_spans(t, net)
        model += len(want)
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert [x for x in spans if x.startswith("model")] == [f"model:{a}:{b}" for a, b in want] and got[i]["n_model"] == len(want)
        assert [x for x in spans if not x.startswith("model")] == [f"{k}:{a}:{b}" for a, b, k in brute_spans(t)] and len(got[i]["scores"]) == len(spans)
    assert model > 50


def test_gradients():
    codes, shape, y = (x[:8] for x in secrets._arrays(secrets.findings(8, 5)))
    eps, base = 1e-6, secrets.Network()
    g = base._gradients(codes[:8], shape[:8], y[:8])
    loss = lambda: float(np.mean(np.logaddexp(0, base.logits(codes[:8], shape[:8])) - y[:8] * base.logits(codes[:8], shape[:8])))
    for name, at in (("conv", (3, 2)), ("dense", (5,)), ("embed", (97, 1)), ("bias", (1,))):
        before = loss()
        base.w[name][at] += eps
        assert (loss() - before) / eps == pytest.approx(g[name][at], abs=1e-4)
        base.w[name][at] -= eps


# --- 5 -------------------------------------------------------------------------------------


def brute_quality(text):
    t = text or ""
    w = words_ws(t)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = collections.Counter(wins)
    cover = {i + k for i, x in enumerate(wins) if c[x] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words_ws(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_quality_counts(docs, rows):
    got = quality.report(docs)
    assert tally(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()) == tally((d, *brute_quality(t)) for d, t in rows)
    assert got.where("base_failed and kept").count() == 0
    assert quality.report(docs.limit(0)).count() == 0


def test_quality_tells_junk_from_prose(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rated = quality.report(docs).join(labels, "doc_id").where("not base_failed")
    good, bad = rated.where("quality = 1"), rated.where("quality = 0")
    assert good.where("kept").count() >= 0.95 * good.count() and bad.where("kept").count() <= 0.2 * max(1, bad.count())
    kept = quality.keep_good(docs.withColumn("t", F.lit(1)))
    assert kept.columns == [*docs.columns, "t"]
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in quality.report(docs).where("kept").select("doc_id").collect())


def test_expectation_maximisation_recovers_rates():
    rng = random.Random(6)
    counts = collections.Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        counts["".join("-" if rng.random() < 0.2 else ("g" if (rng.random() < 0.95) == good else "b") for _ in range(10))] += 1
    post, model = quality.fit(counts)
    assert abs(model["prior"] - 0.8) < 0.02
    assert all(abs(r["good"] - 0.95) < 0.02 and abs(r["bad"] - 0.95) < 0.04 for r in model["rules"].values())
    assert post["g" * 10] > 0.99 or "g" * 10 not in post
    assert quality.fit({})[0] == {}


# --- 8 -------------------------------------------------------------------------------------


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = words_ws(lowered(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, least):
    """prints: fingerprints; least: their smallest ids."""
    v = np.array(prints, np.uint64)
    root = list(range(len(v)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v) <= 3).tolist():
            root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, d in enumerate(least):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(v))]


def test_simhash(docs, rows):
    some = [(d, t) for d, t in rows if d != 9000]
    prints = [brute_fingerprint(t) for _, t in some]
    want = [(d, format(p, "016x"), c) for (d, _), p, c in zip(some, prints, brute_components(prints, [d for d, _ in some]))]
    got = simhash.report(docs.where("doc_id is null or doc_id != 9000"))
    assert tally(got.collect()) == tally(want)
    assert simhash.report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("pairwise", [1024, 8])
def test_components_of_chains_and_clusters(spark, monkeypatch, pairwise):
    rng = random.Random(7)
    values = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            values.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    values |= {centre ^ sum(1 << b for b in rng.sample(range(14), rng.randint(0, 5))) for _ in range(400)}
    prints = sorted(values)
    rng.shuffle(prints)
    want = brute_components(prints, list(range(len(prints))))
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    near = np.array(sorted(x for x in prints if x >> 24 == centre >> 24), np.uint64)
    low = brute_components(near.tolist(), list(range(len(near))))
    # As a list of five bytes, and as one of four that is indexed again by the others.
    for fixed in ((3, 4, 5, 6, 7), (4, 5, 6, 7)):
        child, parent = simhash.forest(near, fixed, 3)
        assert {int(a): int(b) for a, b in zip(child, parent)} == {int(near[i]): int(near[low[i]]) for i in range(len(near)) if low[i] != i}
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)], "id long, fp long")
    got = {r["id"]: r["least"] for r in df.join(simhash.components(df, "id"), "fp").collect()}
    assert [got[i] for i in range(len(prints))] == want


def test_any_five_positions_hold_a_group_and_the_count_filter_keeps_all():
    import itertools

    assert len(simhash.groups(3)) == 14
    for kept in itertools.combinations(range(8), 5):
        assert any(set(g) <= set(kept) for g in simhash.groups(3))
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 500, np.uint64)
    y = x.copy()
    for k in range(500):
        for bit in rng.choice(64, k % 6, replace=False):
            y[k] ^= np.uint64(1 << int(bit))
    assert simhash.alike(x, y, 3).tolist() == [k % 6 <= 3 for k in range(500)]


def test_one_of_each_group_stays(docs, rows):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    prints = [brute_fingerprint(t) for _, t in rows]
    groups = len(set(brute_components(prints, list(range(len(rows))))))
    assert kept.count() == groups
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


# --- 9 -------------------------------------------------------------------------------------


def test_language_model(docs, rows):
    got = lm.scored(docs)
    tokens = [(d, [*words_ws(lowered(t)), ""], zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2) for d, t in rows]
    c = collections.Counter(w for _, ws, held in tokens if not held for w in ws)
    n, v = sum(c.values()), len(c)
    want = tally((d, held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws, held in tokens)
    assert tally((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got.collect()) == want
    assert got.where("score > 1e-9 or isnan(score)").count() == 0
    assert lm.scored(docs.limit(0)).count() == 0


def test_model_is_a_distribution_and_learns(spark, data):
    held = lm.scored(spark.read.parquet(f"{data}/documents.parquet")).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert held[1] > held[0]
    assert (held[1] - held[0]) / held[2] > 0.05


def test_every_context_has_a_distribution():
    """Over all classes, subclasses and words of a small vocabulary the probabilities add up to one, with trained weights."""
    rng = np.random.default_rng(1)
    hashes = rng.integers(-(1 << 62), 1 << 62, 3000)
    counts = rng.integers(1, 9, 3000)
    levels = 2
    assert [lm.levels_for(n) for n in (0, 3000, 100_000, 10**6, 10**12)] == [1, 1, 2, 2, lm.LEVELS]
    model = lm.Model(hashes[: lm.SINGLES].tolist(), np.zeros(lm.SINGLES), np.zeros(lm.HASHED * lm.BRANCHES**levels), np.zeros(lm.HASHED * lm.BRANCHES**levels), levels)
    kinds, leaves = model.classes(hashes), model.leaves(hashes)
    assert sorted(kinds[: lm.SINGLES]) == list(range(lm.SINGLES)) and (kinds[lm.SINGLES :] >= lm.SINGLES).all()
    single = np.bincount(kinds, weights=counts, minlength=lm.CLASSES)[: lm.SINGLES]
    inside = kinds >= lm.SINGLES
    of = lambda w: np.bincount(leaves[inside], weights=w, minlength=len(model.leaf_tokens))
    model = lm.Model(hashes[: lm.SINGLES].tolist(), single, of(counts[inside]), of(np.ones(inside.sum())), levels)
    text = rng.integers(0, 3000, 20_000)
    contexts = lm.contexts_of(hashes[text], np.array([20_000]))
    model.weights, model.deep = lm.trained_on(model, contexts, kinds[text], leaves[text])
    for at in (5, 777):
        here = tuple(np.full(3000, c[at]) for c in contexts)
        known = 10 ** (model.log10(here, kinds, leaves) + np.where(inside, model.in_leaf(leaves, counts), 0.0))
        # In each last subclass one share is kept for unknown words.
        every = np.arange(len(model.leaf_tokens))
        back = np.array([lm.SINGLES + k // lm.BRANCHES**levels for k in every])
        unknown = 10 ** (model.log10(tuple(np.full(len(every), c[at]) for c in contexts), back, every) + model.in_leaf(every, np.zeros(len(every))))
        assert known.sum() + unknown.sum() == pytest.approx(1.0, abs=1e-4)
    assert model.log10(contexts, kinds[text], leaves[text]).sum() > lm.Model(hashes[: lm.SINGLES].tolist(), single, of(counts[inside]), of(np.ones(inside.sum())), levels).log10(contexts, kinds[text], leaves[text]).sum()


def test_context_tells_words_of_a_class_apart():
    """In a text where each word fixes the next, the trained subclasses give far more than shares."""
    rng = np.random.default_rng(2)
    hashes = rng.integers(-(1 << 62), 1 << 62, 400)
    text = (rng.integers(0, 400, 1)[0] + np.arange(40_000) * 7) % 400
    levels, size = lm.levels_for(400), lm.HASHED * lm.BRANCHES
    leaves = lm.Model([], np.zeros(0), np.zeros(size), np.zeros(size), 1).leaves(hashes)
    tokens = np.bincount(leaves, weights=np.full(400, 100.0), minlength=size)
    model = lm.Model([1] * lm.SINGLES, np.zeros(lm.SINGLES), tokens, np.bincount(leaves, minlength=size).astype(float), levels)
    kinds = model.classes(hashes)
    contexts = lm.contexts_of(hashes[text], np.array([40_000]))
    before = model.log10(contexts, kinds[text], leaves[text]).mean()
    for _ in range(2):
        model.weights, model.deep = lm.trained_on(model, contexts, kinds[text], leaves[text])
    assert model.log10(contexts, kinds[text], leaves[text]).mean() > before + 1


def test_training_equals_plain_steps_in_less_time():
    """Against softmax and sums by table row as they are written down: the same table, and at most 0.7 of the CPU time."""
    import time

    rng = np.random.default_rng(3)
    n = 4 * lm.BATCH
    # Words of a long-tailed vocabulary: table rows of one token of a batch and of hundreds.
    hashes = rng.integers(-(1 << 62), 1 << 62, 50_000)
    words = np.where(rng.random(n) < 0.5, np.minimum(rng.zipf(1.2, n), 50_000) - 1, rng.integers(0, 50_000, n))
    contexts, classes = lm.contexts_of(hashes[words], np.array([n])), rng.integers(0, lm.SINGLES, n)
    size = lm.HASHED * lm.BRANCHES
    model = lm.Model([1] * lm.SINGLES, np.bincount(classes, minlength=lm.SINGLES), np.ones(size), np.ones(size), 1)
    model.weights = rng.normal(0, 1, model.weights.shape).astype(np.float32)

    def plain():
        w, seen = model.weights.copy(), np.ones(lm.ROWS, np.float32)
        for i in range(0, n, lm.BATCH):
            f = lm.features(*(x[i : i + lm.BATCH] for x in contexts))
            f = ((f * lm._A) >> np.uint64(64 - 14)).astype(np.int32)
            z = w[f[:, 0]] + w[f[:, 1]] + w[f[:, 2]] + model.bias
            g = np.exp(z - z.max(1, keepdims=True))
            g /= g.sum(1, keepdims=True)
            g[np.arange(len(g)), classes[i : i + lm.BATCH]] -= 1
            for k in range(3):
                order = np.argsort(f[:, k].astype(np.uint16), kind="stable")
                rows = f[order, k]
                first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                rows, times = rows[first], np.diff(np.append(first, len(order))).astype(np.float32)
                seen[rows] += times
                w[rows] -= (np.float32(lm.RATE) / np.sqrt(seen[rows] * times))[:, None] * np.add.reduceat(g[order], first, axis=0)
        return w

    def timed(run):
        began = time.process_time()
        out = run()
        return time.process_time() - began, out

    slow, want = min((timed(plain) for _ in range(5)), key=lambda x: x[0])
    fast, (got, deep) = min((timed(lambda: lm.trained_on(model, contexts, classes, np.zeros(n, np.int64))) for _ in range(5)), key=lambda x: x[0])
    assert lm.ROWS == 1 << 14 and np.bincount(words[: lm.BATCH]).max() > 100
    assert np.abs(got - want).max() < 1e-4 and (deep == model.deep).all()
    assert fast < 0.7 * slow, (fast, slow)


def test_far_logits_stay_finite():
    """Logits beyond the range of exponentials, both ways, next to common ones."""
    w = np.zeros((lm.ROWS, 4), np.float32)
    w[1], w[2], w[3] = [300, 299, -300, 0], [-300, -301, -299, -300], [1, 0, 0, 0]
    e, total = lm._exponentials(w, np.zeros(4, np.float32), np.array([[1, 2, 3], [0, 0, 0], [0, 0, 0]]))
    z = w[1:4].astype(float)
    want = np.exp(z - z.max(1, keepdims=True))
    assert e / total[:, None] == pytest.approx(want / want.sum(1, keepdims=True), abs=1e-6)
