"""Near-duplicate documents of a similarity: SimHash and minima of shingles for most links, shared prefixes for all others.

Texts whose five-word shingles are alike to 0.8 (Jaccard) differ in about a tenth of the
bits of a shingle SimHash, too many for an index of exact bytes. What the SimHash
operator itself links, three-word fingerprints within 3 bits, is linked here through its
index. Then each text is posted in BANDS lists, each under ROWS minima of its shingle set. A
SimHash of LONG bits of the shingle set orders a list: a member is tied to the nearest of
those before it, a spanning forest of the least distances, so a list yields fewer pairs
than members. A link is such a pair whose exact Jaccard similarity reaches the one asked for.

Lists of more than HOT members, as large families of copies make them, are dealt over
parts. Every part gets the list's hub too, the member nearest to the majority of
all its bits, so that what was made from one text meets that text, or the one most like it.

That joins most of a group cheaply but may leave out links: pairs that share no list or part,
and those that stand behind a nearer pair that was refused. So an exact pass follows for
texts that are still in different groups (``rest``). Sets alike to s share a shingle
within the first n - ceil(s n) + 1 of their n shingles, whatever the order, if it is one for all;
here shingles that are frequent in a sample come last, which only shortens lists. Each
set is posted under these, and in a list every pair of different groups that sizes, places of
the shared shingle and parities of hashed shingles don't rule out is counted exactly, after
parities of more bits for larger sets have been compared. A member has so
many pairs tried at once; while any had more, groups are merged and the pass is repeated
with more, so what is joined by then needs no pair and none is left out in the end.

Texts with the same hashes (64 bits over all of them) count as one from the start. Cases
are those of the SimHash operator; documents that repeat in id and text leave one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, release, saved, small_batches, tidy, utf8
from .simhash import DISTANCE, fingerprint, local_links, roots

SHINGLE, SIMILARITY = 5, 0.8
LONG, BANDS, ROWS = 512, 16, 4
#: Pairs whose long hashes differ by more deviations than these aren't counted exactly.
DEVIATIONS = 3
#: Members of a list that one task compares, and hot lists that a join may broadcast (about 3 MB).
HOT, HOT_LISTS = 4096, 100_000
#: Texts whose shingles are counted for the order of prefixes, how often one counts as frequent, and how many of those are told apart.
SAMPLE, OFTEN, FREQUENT = 8192, 3, 1 << 16
#: Bits of the parities of a list's members, pairs that a member has tried at first, how many times as many in each further round,
#: and if it has more shingles than PARITY, as most of its pairs are left to the wider parities.
PARITY, TRIED, MORE, WIDE = 1024, 4, 64, 64
#: Similarities times sizes are allowed so much for rounding before exact counts.
_SLACK = 1e-6
#: Odd multipliers that make independent hashes of one.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: A multiplier and a summand for each minimum.
_TIMES, _PLUS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_TIMES |= np.uint64(1)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    x = h * _MIX[k] + _MIX[7 - k]
    x ^= x >> np.uint64(29)
    x *= _MIX[(k + 3) % 8]
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the set of word shingles, ascending; empty without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    names: dict[bytes, int] = {}
    at = np.array([names.setdefault(w, len(names)) for w in words])
    each = np.array([xxh64_intdigest(w) for w in names], np.uint64)[at]
    width = min(shingle, len(words))
    gram = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        gram = gram * np.uint64(0x9DDFEA08EB382D69) + each[i : i + len(gram)]
    return np.unique(gram)


def full(gram: np.ndarray) -> int:
    """One hash of a whole set."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(gram.tobytes())


def majority(gram: np.ndarray) -> np.ndarray:
    """LONG / 64 words: of each of LONG hashed bits of a set, whether it is set in over half."""
    ones = np.zeros(LONG, np.int64)
    for a in range(0, len(gram), 1 << 13):
        part = np.stack([_mixed(gram[a : a + (1 << 13)], k) for k in range(LONG // 64)], 1)
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(gram), bitorder="little").view(np.uint64)


def bands(gram: np.ndarray) -> np.ndarray:
    """One hash of each band's minima over a set of 64-bit hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for a in range(0, len(gram), 1 << 12):
        x = gram[a : a + (1 << 12), None] * _TIMES + _PLUS
        x ^= x >> np.uint64(29)
        x *= _MIX[0]
        least = np.minimum(least, x.min(0))
    rows = least.reshape(BANDS, ROWS)
    out = np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        out = (out ^ (rows[:, i] ^ (rows[:, i] >> np.uint64(31)))) * _MIX[1]
    return out


def allowed_bits(similarity: float, deviations: float = 1) -> int:
    """Differing bits of LONG of two texts of a similarity: what it gives on average, and so many deviations more."""
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(LONG * angle + deviations * math.sqrt(LONG * angle * (1 - angle)))


_LONGS = [f"s{i}" for i in range(LONG // 64)]
_BAND_NAMES = [f"b{i}" for i in range(BANDS)]
_HASHES = [*_LONGS, *_BAND_NAMES, "fp", "full"]


def prints(docs: DataFrame, id_col: str, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, thash (of the text), node (of all hashes), and the hashes as signed longs, fp being the operator's fingerprint, full of the shingle set."""
    names = _HASHES
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("thash"), F.col(text_col).cast("string").alias("text"))

    def all_of(text: bytes) -> np.ndarray:
        gram = shingles(text, shingle)
        return np.concatenate([majority(gram), bands(gram), np.array([fingerprint(text), full(gram)], np.uint64)])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([all_of(t) for t in utf8(part.column(2))], np.uint64).reshape(part.num_rows, len(names)).view(np.int64)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(names))]], names=["id", "thash", *names])

    out = map_text(rows, work, "id long, thash long, " + ", ".join(f"{n} long" for n in names))
    return out.withColumn("node", F.xxhash64(*names))


def spanning(long: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, member it is tied to): the spanning forest of least distances among hashes (n, words), no distance above most."""
    m = len(long) - 1
    at, rest = 0, np.arange(1, m + 1)
    hashes, best, up = long[1:].copy(), np.full(m, most + 1), np.zeros(m, np.int64)
    child, parent = [], []
    while m:
        d = np.bitwise_count(hashes[:m] ^ long[at]).sum(1, dtype=np.int64)
        closer = d < best[:m]
        best[:m][closer] = d[closer]
        up[:m][closer] = at
        i = int(best[:m].argmin())
        at = int(rest[i])
        if best[i] <= most:
            child.append(at)
            parent.append(int(up[i]))
        m -= 1
        rest[i], hashes[i], best[i], up[i] = rest[m], hashes[m], best[m], up[m]
    return np.array(child, np.int64), np.array(parent, np.int64)


def _hubs(members: DataFrame) -> DataFrame:
    """(list, key, node, hashes) of the member nearest to the majority of all bits, of each list of members (list, key, node, hashes)."""

    def summed(batches):
        """Of each list: members and set bits, added up in a task."""
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            place, key = b.column("list").to_numpy(), b.column("key").to_numpy()
            long = np.stack([b.column(c).to_numpy() for c in _LONGS], 1)
            order = np.lexsort((key, place))
            edges = np.flatnonzero(np.append(True, (np.diff(place[order]) != 0) | (np.diff(key[order]) != 0))[: len(order)])
            for at in np.split(order, edges[1:]):
                if not len(at):
                    continue
                bits = np.unpackbits(np.ascontiguousarray(long[at]).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                k = int(place[at[0]]), int(key[at[0]])
                sums[k] = sums.get(k, 0) + np.append(bits, len(at))
        if sums:
            yield pa.RecordBatch.from_pydict({"list": pa.array([k[0] for k in sums], pa.int32()), "key": pa.array([k[1] for k in sums], pa.int64()), "sums": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))})

    def center(key: tuple, group: pa.Table) -> pa.Table:
        total = np.sum([np.array(x) for x in group.column("sums").to_pylist()], 0)
        word = np.packbits(2 * total[:-1] > total[-1], bitorder="little").view(np.int64)
        return pa.table({"list": pa.array([key[0].as_py()], pa.int32()), "key": pa.array([key[1].as_py()], pa.int64()), **{f"c_{n}": pa.array([int(w)], pa.int64()) for n, w in zip(_LONGS, word)}})

    partial = members.mapInArrow(summed, "list int, key long, sums array<long>")
    centers = partial.groupBy("list", "key").applyInArrow(center, "list int, key long, " + ", ".join(f"c_{n} long" for n in _LONGS))
    far = sum(F.bit_count(F.col(n).bitwiseXOR(F.col(f"c_{n}"))) for n in _LONGS)
    nearest = F.min_by(F.struct("node", *_LONGS), F.struct(far.alias("far"), F.col("node"))).alias("h")
    return members.join(centers, ["list", "key"]).groupBy("list", "key").agg(nearest).select("list", "key", "h.*")


def _by_lists(columns: list[str], solve):
    """A function of Arrow batches that calls solve with arrays of whole lists; rows of a list, named by the first column, are together."""

    def work(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            inside = held and held[-1][0][-1] == part[0][-1]
            held.append(part)
            if inside:
                continue  # all of the batch belongs to the list that is open
            whole = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.flatnonzero(np.append(True, whole[0] != whole[0][-1]))[-1])
            held = [[x[cut:] for x in whole]]
            if cut:
                yield solve([x[:cut] for x in whole])
        if held:
            yield solve([np.concatenate(x) for x in zip(*held)])
        release()

    return work


def candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """(child, parent), child above parent, from all lists of nodes (node and hashes, each once); fewer from a list than it has members."""
    entries = F.posexplode(F.array(*_BAND_NAMES)).alias("list", "key")
    posted = nodes.select("node", *_LONGS, entries)
    sizes = nodes.select(entries).groupBy("list", "key").agg(F.count("*").alias("n"))
    hot = saved(sizes.where(F.col("n") > HOT))
    few = hot.limit(HOT_LISTS + 1).count() <= HOT_LISTS
    sized = posted.join(F.broadcast(hot) if few else hot, ["list", "key"], "left")
    parts = F.ceil(F.col("n") / HOT).cast("int")
    dealt = sized.withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), parts).cast("int"), F.lit(0))).drop("n")
    if not hot.isEmpty():
        # A lone member of a part is compared with the hub only; the hub's own part has it twice, at distance zero.
        hubs = _hubs(saved(sized.where("n is not null").drop("n")))
        dealt = dealt.unionByName(hubs.join(hot, ["list", "key"]).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n"))
    lists = dealt.select(F.xxhash64("list", "key", "part").alias("bucket"), "node", *_LONGS).repartition("bucket").sortWithinPartitions("bucket", "node")
    most = allowed_bits(similarity, DEVIATIONS)
    columns = ["bucket", "node", *_LONGS]

    def solve(parts_: list[np.ndarray]) -> pa.RecordBatch:
        bucket, node, long = parts_[0], parts_[1], np.stack(parts_[2:], 1).view(np.uint64)
        edges = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        starts, ends = np.append(0, edges), np.append(edges, len(bucket))
        twos = starts[ends - starts == 2]
        near = np.bitwise_count(long[twos] ^ long[twos + 1]).sum(1, dtype=np.int64) <= most
        pairs = [np.stack([node[twos + 1][near], node[twos][near]], 1)]
        for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
            x, y = spanning(long[a:b], most)
            pairs.append(np.stack([node[a + x], node[a + y]], 1))
        both = np.concatenate(pairs)
        both = np.unique(np.stack([both.max(1), both.min(1)], 1), axis=0)
        both = both[both[:, 0] != both[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)], names=["child", "parent"])

    small_batches(nodes.sparkSession)
    return lists.mapInArrow(_by_lists(columns, solve), "child long, parent long")


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """(child, parent), child above parent, of nodes whose fingerprints the operator links: all of a fingerprint to its first, and the first ones of linked fingerprints."""
    first = saved(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.select("fp", "node").join(first, "fp").where("node != first").select(F.col("node").alias("child"), F.col("first").alias("parent"))
    found = local_links(first.select("fp"), DISTANCE)
    a = first.select(F.col("fp").alias("child"), F.col("first").alias("a"))
    b = first.select(F.col("fp").alias("parent"), F.col("first").alias("b"))
    between = found.join(a, "child").join(b, "parent").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
    return same.unionByName(between)


def _key(c) -> list:
    """An id as two columns that join as equal where both are null."""
    return [F.coalesce(c, F.lit(0)).cast("long").alias("__k"), c.isNull().alias("__none")]


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float, shingle: int, id_col: str) -> DataFrame:
    """Those of pairs (child, parent) whose shingle sets are alike to the similarity, counted exactly; only texts of pairs are shuffled."""
    ends = pairs.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    need = nodes.join(ends, "node").select("node", F.col("one.thash").alias("__thash"), *_key(F.col("one.id")))
    rows = docs.select(*_key(F.col(id_col)), F.xxhash64("text").alias("__thash"), F.col("text").cast("string").alias("text"))
    texts = rows.join(need, ["__k", "__none", "__thash"]).select("node", "text")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, shingle).view(np.int64) for t in utf8(part.column(1))]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"])

    sets = saved(map_text(texts, work, "node long, grams array<long>").dropDuplicates(["node"]))
    tidy(docs.sparkSession)
    child = sets.select(F.col("node").alias("child"), F.col("grams").alias("a"))
    parent = sets.select(F.col("node").alias("parent"), F.col("grams").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return saved(pairs.join(child, "child").join(parent, "parent").where(both >= similarity * (F.size("a") + F.size("b") - both)).select("child", "parent"))


def links(nodes: DataFrame, docs: DataFrame, similarity: float, shingle: int, id_col: str) -> DataFrame:
    """(child, parent), child above parent: candidates that reach the similarity."""
    # The postings are let go before texts are shuffled.
    tried = saved(candidates(nodes, similarity).distinct())
    tidy(docs.sparkSession)
    return verified(tried, nodes, docs, similarity, shingle, id_col)


def prefix_length(n: int, similarity: float) -> int:
    """Of n shingles in an order common to all sets, so many first ones hold one that any set alike to the similarity has among its own first ones."""
    return n - math.ceil(similarity * n - _SLACK) + 1


def prefix(gram: np.ndarray, similarity: float, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of an ascending set: the others by value, then frequent ones (ascending) by rank."""
    n = prefix_length(len(gram), similarity) if len(gram) else 0
    if not len(frequent):
        return gram[:n]
    at = np.minimum(np.searchsorted(frequent, gram), len(frequent) - 1)
    often = frequent[at] == gram
    first = gram[~often][:n]
    if len(first) == n:
        return first
    return np.append(first, gram[often][np.argsort(rank[at[often]])][: n - len(first)])


def parities(gram: np.ndarray, least: int = PARITY) -> np.ndarray:
    """Words of a power of two of bits, least or twice the shingles: whether an odd number of them falls on a bit. Two sets differ in as many shingles at least as in bits."""
    bits = max(least, 1 << (2 * len(gram) - 1).bit_length()) if len(gram) else least
    odd = np.bincount((gram & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """Parities of fewer bits."""
    return np.bitwise_xor.reduce(words.reshape(-1, bits // 64), axis=0)


def _frequent(docs: DataFrame, texts: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, ascending, that are frequent in a sample of different texts, and their ranks by frequency."""
    part = F.pmod(F.xxhash64("text"), F.lit(max(1, texts // SAMPLE)).cast("long")) == 0
    rows = docs.where(part).select(F.col("text").cast("string").alias("text")).dropDuplicates(["text"])

    def work(part: pa.RecordBatch) -> pa.RecordBatch | None:
        sets = [shingles(t, shingle) for t in utf8(part.column(0))]
        token, n = np.unique(np.concatenate(sets), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    counts = map_text(rows, work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    most = np.array([r["token"] for r in counts.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()], np.int64).view(np.uint64)
    order = np.argsort(most)
    return most[order], len(most) - order


def _posted(docs: DataFrame, first: DataFrame, texts: int, similarity: float, shingle: int) -> DataFrame:
    """(node, size, bits, wide, tokens) of each different set, bits and wide being parities; first: (full, node)."""
    frequent, rank = _frequent(docs, texts, shingle)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, shingle) for t in utf8(part.column(0))]
        wide = [parities(g) for g in sets]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.array([full(g) for g in sets], np.uint64).view(np.int64)),
                pa.array([len(g) for g in sets], pa.int64()),
                pa.array([folded(w, PARITY).tobytes() for w in wide], pa.binary()),
                pa.array([w.tobytes() for w in wide], pa.binary()),
                pa.array([prefix(g, similarity, frequent, rank).view(np.int64) for g in sets], pa.list_(pa.int64())),
            ],
            names=["full", "size", "bits", "wide", "tokens"],
        )

    rows = map_text(docs.select(F.col("text").cast("string").alias("text")), work, "full long, size long, bits binary, wide binary, tokens array<long>")
    return rows.dropDuplicates(["full"]).join(first, "full").select("node", "size", "bits", "wide", "tokens")


#: left: shingles of a set from the list's own on.
_ENTRY = ["token", "size", "left", "node", "root"]


def _apart(parts: list[np.ndarray], similarity: float) -> pa.RecordBatch:
    """Rows of _ENTRY, by token and size, of lists of several roots that have a neighbour of a like size."""
    token, size, _, _, root = parts
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    several = np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), np.diff(np.append(starts, len(token))))
    next_ = (token[1:] == token[:-1]) & (size[:-1] >= similarity * size[1:] - _SLACK)
    kept = several & (np.append(next_, False) | np.append(False, next_))
    return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in parts], names=_ENTRY)


def _untied(parts: list[np.ndarray], similarity: float, tried: int) -> pa.RecordBatch:
    """(child, parent): pairs of a list in different roots that may reach the similarity, so many (WIDE times for a large set) of a row; a row with more is paired with itself too."""
    token, size, left, node, root = parts[:5]
    bits = np.frombuffer(b"".join(parts[5]), np.uint64).reshape(len(token), PARITY // 64)
    differing, shared = (1 - similarity) / (1 + similarity), similarity / (1 + similarity)
    count, most = np.zeros(len(token), np.int64), np.where(size > PARITY, tried * WIDE, tried)
    out = []
    # Rows of a list lie by size: where one k places on is too large, all later ones are.
    rows, k = np.arange(len(token)), 0
    while True:
        k += 1
        rows = rows[rows + k < len(token)]
        rows = rows[(token[rows + k] == token[rows]) & (size[rows] >= similarity * size[rows + k] - _SLACK)]
        if not len(rows):
            break
        a = rows[root[rows] != root[rows + k]]
        # In the list of the first shingle that two sets share, what either has from there on holds all they share.
        a = a[np.minimum(left[a], left[a + k]) >= shared * (size[a] + size[a + k]) - _SLACK]
        near = np.bitwise_count(bits[a] ^ bits[a + k]).sum(1, dtype=np.int64) <= differing * (size[a] + size[a + k]) + _SLACK
        a = a[near]
        over = a[count[a] >= most[a]]
        out.append(np.stack([node[over], node[over]], 1))
        a = a[count[a] < most[a]]
        out.append(np.stack([node[a], node[a + k]], 1))
        count[a] += 1
        count[over] = -1
        rows = rows[count[rows] >= 0]
    both = np.concatenate([np.zeros((0, 2), np.int64), *out])
    both = np.unique(np.stack([both.max(1), both.min(1)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)], names=["child", "parent"])


def _close(pairs: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (child, parent) that the wide parities of both don't rule out."""
    differing = (1 - similarity) / (1 + similarity)

    def work(batches):
        for batch in batches:
            size, a, b = batch.column("size").to_numpy(), batch.column("a").to_pylist(), batch.column("b").to_pylist()
            far = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(a, b)):
                bits = 8 * min(len(x), len(y))
                far[i] = np.bitwise_count(folded(np.frombuffer(x, np.uint64), bits) ^ folded(np.frombuffer(y, np.uint64), bits)).sum(dtype=np.int64)
            yield batch.filter(pa.array(far <= differing * size + _SLACK)).select(["child", "parent"])

    child = whole.select(F.col("node").alias("child"), F.col("size").alias("n"), F.col("wide").alias("a"))
    parent = whole.select(F.col("node").alias("parent"), F.col("size").alias("m"), F.col("wide").alias("b"))
    both = pairs.join(child, "child").join(parent, "parent")
    return both.select("child", "parent", (F.col("n") + F.col("m")).alias("size"), "a", "b").mapInArrow(work, "child long, parent long")


def rest(docs: DataFrame, nodes: DataFrame, named: DataFrame, similarity: float, shingle: int, id_col: str) -> DataFrame:
    """(root, top): named's roots that are joined by links it lacks, and what they are joined to. named: (node, root), equal sets in one root."""
    small_batches(docs.sparkSession)
    first = nodes.groupBy("full").agg(F.min("node").alias("node"))
    whole = saved(_posted(docs, first, nodes.count(), similarity, shingle))
    tidy(docs.sparkSession)
    start = saved(whole.select("node").join(named, "node").select("node", F.col("root").alias("was"), "root"))
    entries = whole.join(start.select("node", "root"), "node").select(F.posexplode("tokens").alias("at", "token"), "size", "node", "root").withColumn("left", F.col("size") - F.col("at")).select(_ENTRY)
    now, tried = start, TRIED
    while True:
        lists = entries.repartition("token").sortWithinPartitions("token", "size", "node")
        members = saved(lists.mapInArrow(_by_lists(_ENTRY, lambda x: _apart(x, similarity)), ", ".join(f"{c} long" for c in _ENTRY)))
        del lists, entries
        tidy(docs.sparkSession)
        lists = members.join(whole.select("node", "bits"), "node").select(*_ENTRY, "bits").repartition("token").sortWithinPartitions("token", "size", "node")
        pairs = saved(lists.mapInArrow(_by_lists([*_ENTRY, "bits"], lambda x, n=tried: _untied(x, similarity, n)), "child long, parent long").distinct())
        del lists
        tidy(docs.sparkSession)
        if pairs.isEmpty():
            break
        close = saved(_close(pairs.where("child != parent"), whole, similarity))
        tidy(docs.sparkSession)
        found = verified(close, nodes, docs, similarity, shingle, id_col)
        if not found.isEmpty():
            child = now.select(F.col("node").alias("child"), F.col("root").alias("a"))
            parent = now.select(F.col("node").alias("parent"), F.col("root").alias("b"))
            up = roots(found.join(child, "child").join(parent, "parent").where("a != b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")))
            now = saved(now.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", "was", F.coalesce("top", "root").alias("root")))
            tidy(docs.sparkSession)
        if pairs.where("child = parent").isEmpty():
            break
        entries = members.drop("root").join(now.select("node", "root"), "node").select(_ENTRY)
        tried *= MORE
    return now.where("was != root").select(F.col("was").alias("root"), F.col("root").alias("top")).distinct()


def groups(docs: DataFrame, found: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id") -> DataFrame:
    """(node, root, least): the group of each node of prints of docs and the group's smallest id."""
    nodes = saved(found.groupBy("node").agg(F.min("id").alias("least"), F.first(F.struct("id", "thash")).alias("one"), *[F.first(c).alias(c) for c in _HASHES]))
    similar = links(nodes, docs, similarity, shingle, id_col)
    tidy(found.sparkSession)
    printed = saved(fingerprint_links(nodes))
    tidy(found.sparkSession)
    first = nodes.groupBy("full").agg(F.min("node").alias("parent"))
    same = nodes.select(F.col("node").alias("child"), "full").join(first, "full").where("child != parent").select("child", "parent")
    up = roots(similar.unionByName(printed).unionByName(same))
    rooted = saved(nodes.select("node", "least").join(up, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    del up, similar, printed
    tidy(found.sparkSession)
    joined = rest(docs, nodes, rooted.select("node", "root"), similarity, shingle, id_col)
    rooted = saved(rooted.join(joined, "root", "left").select("node", "least", F.coalesce("top", "root").alias("root")))
    all_ = saved(rooted.groupBy("root").agg(F.min("least").alias("all")))
    return rooted.join(all_, "root").select("node", "root", F.col("all").alias("least"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id") -> DataFrame:
    """docs, all columns, with one document of each group: that of the smallest id, of equal ids and texts one."""
    found = saved(prints(docs, id_col, shingle=shingle))
    named = saved(groups(docs, found, similarity, shingle, id_col))
    # Ids spread evenly, so joining on id and text hash has no hot key; repeated rows meet there and leave one.
    chosen = found.join(named, "node").where(F.col("id").eqNullSafe(F.col("least"))).groupBy("root").agg(F.min("thash").alias("thash"), F.first("least").alias("least"))
    rows = docs.select("*", *_key(F.col(id_col)), F.xxhash64("text").alias("__thash"))
    kept = rows.join(chosen.select(F.col("thash").alias("__thash"), *_key(F.col("least"))), ["__k", "__none", "__thash"], "left_semi")
    return kept.dropDuplicates(["__k", "__none", "__thash"]).select(*docs.columns)
