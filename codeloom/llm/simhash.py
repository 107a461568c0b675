"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two fingerprints of 64 bits that differ in at most ``d`` bits agree in at least 8 - d of
their eight bytes. The index posts each distinct fingerprint under groups of byte
positions with the bytes that stand there; the groups are such that any 8 - d positions
hold one of them, for d of 3 or less the fourteen quadruples of a Steiner system. In
a list, the bytes that a pair has alike are tallied; pairs that reach the guaranteed
8 - d are retained and their bits compared. A long list is indexed again by its other
positions, one at a time, so that what is compared agrees in 8 - d bytes from the start.

A list yields no pairs but a forest: each fingerprint points to the smallest one it
is connected to. Forests of all lists are merged by rounds of minima and pointer
jumping in DataFrames, each round kept in the shared checkpoint folder.

Cases: a null or empty text has the fingerprint zero, linked like any other; fewer
words than a shingle make one shingle. A text of any length is hashed whole, in bounded
parts. Repeated rows share a fingerprint and are grouped before anything is posted, so a
group of copies is one entry of the index. A null id takes no part in a component's
smallest id. Columns travel under a prefix, so their names may clash with ours. An empty
table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, saved, small_batches, utf8

SEED, SHINGLE, DISTANCE = 42, 3, 3


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the XXH64 values of the word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.array([xxh64_intdigest(g, seed) for g in grams], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", keep_text: bool = False, shingle: int = SHINGLE) -> DataFrame:
    """id_cols under their names with in_ before, the text if asked for (__t), and fp, the bits as a signed long."""
    rows = docs.select(*[F.col(c).alias(f"in_{c}") for c in id_cols], F.col(text_col).cast("string").alias("__t"))
    kept = rows.columns if keep_text else rows.columns[:-1]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle) for t in utf8(part.column("__t"))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(found)], names=[*kept, "fp"])

    return map_text(rows, work, rows.select(*kept, F.lit(0).cast("long").alias("fp")).schema, "__t")


#: Quadruples of byte positions whose numbers cancel. Each three positions lie in exactly one, and the
#: complement of a quadruple is another, so three differing bytes always leave one untouched.
QUADS = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


def groups(distance: int) -> list[tuple[int, ...]]:
    """Byte positions that lists fix; any 8 - distance positions hold one of them."""
    return QUADS if distance <= 3 else list(combinations(range(8), 8 - distance))


#: A list below so many fingerprints is compared pair by pair; a longer one is indexed again, at last by flipping bits.
PAIRWISE = 1024


def alike(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Count filter, then bits: pairs with 8 - distance equal bytes at least whose fingerprints are within distance."""
    differing = x ^ y
    tally = (differing[..., None].view(np.uint8).reshape(*differing.shape, 8) == 0).sum(-1)
    out = tally >= 8 - distance
    out[out] = np.bitwise_count(differing[out]) <= distance
    return out


def forest(values: np.ndarray, fixed: tuple[int, ...], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(child, parent): each value that is not the smallest of its component within distance, and that smallest.

    values: distinct, ascending, alike in the bytes at the fixed positions. Components are
    those of pairs with 8 - distance equal bytes that include the fixed ones.
    """
    n = len(values)
    root = np.arange(n)

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        """Unite the components of the items a with those of the items b."""
        nonlocal root
        while len(a):
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            differ = low != high
            if not differ.any():
                return
            a, b, low, high = a[differ], b[differ], low[differ], high[differ]
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up

    if n <= PAIRWISE:
        step = max(1, (1 << 17) // n)
        for i in range(0, n, step):
            a, b = np.nonzero(alike(values[i : i + step, None], values[None, :], distance))
            keep = a + i < b
            settle(a[keep] + i, b[keep])
    elif len(fixed) < 8 - distance:
        for p in sorted(set(range(8)) - set(fixed)):
            byte = (values >> np.uint64(8 * p)) & np.uint64(0xFF)
            order = np.argsort(byte, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(byte[order])) + 1):
                if len(part) > 1:
                    child, parent = forest(values[part], (*fixed, p), distance)
                    settle(np.searchsorted(values, child), np.searchsorted(values, parent))
    else:
        bits = [np.uint64(1 << k) for k in range(64) if k // 8 not in fixed]
        for k in range(1, distance + 1):
            for chosen in combinations(bits, k):
                flip = np.bitwise_or.reduce(np.array(chosen, np.uint64))
                other = values ^ flip
                at = np.minimum(np.searchsorted(values, other), n - 1)
                a = np.flatnonzero((values[at] == other) & (other > values))
                settle(a, at[a])
    child = np.flatnonzero(root != np.arange(n))
    return values[child], values[root[child]]


def posted(distinct: DataFrame, distance: int) -> DataFrame:
    """(list, key, fp): each fingerprint under every group of byte positions."""
    masks = [sum(0xFF << (8 * b) for b in g) for g in groups(distance)]
    rows = distinct.select("fp", F.posexplode(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long").bitwiseAND(F.col("fp")) for m in masks])).alias("list", "key"))
    return rows.select(F.col("list").cast("byte"), "key", "fp")


def local_links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(child, parent) from all posting lists; distinct has one row for each fingerprint."""
    fixed = groups(distance)
    lists = posted(distinct, distance).repartition("list", "key").sortWithinPartitions("list", "key", "fp")

    def work(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def solve(place: np.ndarray, key: np.ndarray, fp: np.ndarray):
            edges = np.flatnonzero((place[1:] != place[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.append(0, edges), np.append(edges, len(fp))
            twos = starts[ends - starts == 2]
            x, y = fp[twos].view(np.uint64), fp[twos + 1].view(np.uint64)
            near = alike(x, y, distance)
            out = [(np.maximum(x, y)[near], np.minimum(x, y)[near])]
            for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
                out.append(forest(np.sort(fp[a:b].view(np.uint64)), fixed[place[a]], distance))
            child, parent = (np.concatenate(x) for x in zip(*out))
            pairs = np.unique(np.stack([child, parent], 1), axis=0) if len(child) else np.zeros((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], names=["child", "parent"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "key", "fp"))
            same = held and (held[-1][0][-1], held[-1][1][-1]) == (part[0][-1], part[1][-1]) == (part[0][0], part[1][0])
            held.append(part)
            if same:
                continue  # the batch is inside one list
            place, key, fp = (np.concatenate(x) for x in zip(*held))
            cut = int(np.flatnonzero(np.append(True, (place != place[-1]) | (key != key[-1])))[-1])
            held = [(place[cut:], key[cut:], fp[cut:])]
            if cut:
                yield solve(place[:cut], key[:cut], fp[:cut])
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    small_batches(distinct.sparkSession)
    return lists.mapInArrow(work, "child long, parent long")


def _order(c) -> F.Column:
    """Signed longs in the order of the unsigned values they hold."""
    return (c if isinstance(c, F.Column) else F.col(c)).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node that isn't the root of its component. links: (child, parent), child above parent in signed order.

    In each round a node keeps its smallest parent and links its other parents to that
    one, until every node has one parent. Nodes then skip to the parent's parent until
    all point to roots. Ends of links only ever fall, so both end.
    """
    rest = saved(links.distinct())
    while True:
        up = saved(rest.groupBy("child").agg(F.min("parent").alias("up"), F.count("*").alias("n")))
        if up.where("n > 1").isEmpty():
            break
        others = rest.join(up.select("child", "up"), "child").where("parent != up")
        rest = saved(up.select("child", F.col("up").alias("parent")).unionByName(others.select(F.col("parent").alias("child"), F.col("up").alias("parent"))).distinct())
    tree = up.select(F.col("child").alias("node"), F.col("up").alias("root"))
    while True:
        above = tree.select(F.col("node").alias("root"), F.col("root").alias("top"))
        stepped = saved(tree.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        tree = stepped.select("node", "root")
        if stepped.where("moved").isEmpty():
            return tree


def components(prints: DataFrame, id_col: str, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, least): for each distinct fingerprint its component and the component's smallest id. prints: id_col, fp."""
    distinct = saved(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    links = local_links(distinct.select("fp"), distance).select(_order("child").alias("child"), _order("parent").alias("parent"))
    found = roots(links).select(_order("node").alias("fp"), _order("root").alias("root"))
    rooted = saved(distinct.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # Only components of two fingerprints or more need their members' ids together.
    least = saved(rooted.groupBy("root").agg(F.min("least").alias("all")))
    return rooted.join(least, "root").select("fp", "root", F.col("all").alias("least"))


def report(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id of the component)."""
    prints = saved(fingerprints(docs))
    named = saved(components(prints, "in_doc_id", distance).select("fp", "least"))
    out = prints.join(named, "fp")
    return out.select(F.col("in_doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """docs, all columns, with one document of each component: that of the smallest id, of equal ids one."""
    id_col = docs.columns[0] if "doc_id" not in docs.columns else "doc_id"
    others = tuple(c for c in docs.columns if c != "text")
    prints = saved(fingerprints(docs, (id_col,), shingle=shingle))
    named = saved(components(prints, f"in_{id_col}", distance))
    # The document that stays has the least id of its component and, of those, the least fingerprint.
    # Ids spread evenly, so joining on both has no hot key; repeated rows meet there and leave one.
    chosen = prints.join(named, "fp").where(F.col(f"in_{id_col}").eqNullSafe(F.col("least"))).groupBy("root").agg(F.min("fp").alias("fp"), F.first("least").alias("least"))
    key = lambda c: [F.coalesce(c, F.lit(0)).alias("k"), c.isNull().alias("none")]
    rows = fingerprints(docs, others, keep_text=True, shingle=shingle).select("*", *key(F.col(f"in_{id_col}")))
    kept = rows.join(chosen.select("fp", *key(F.col("least"))), ["k", "none", "fp"], "left_semi").dropDuplicates(["k", "none", "fp"])
    return kept.select(*[F.col("__t" if c == "text" else f"in_{c}").alias(c) for c in docs.columns])
