"""Nearest neighbours by cosine: learned rotated binary codes in a multi-index, floats for the final order.

Codes. Vectors of length one, less their mean, are turned by principal axes and a rotation that is learned
(iterative quantisation: signs, then the orthogonal Procrustes rotation towards them) on a bounded sample; the
signs are a code of 64 bits. The radius is learned too: a bounded sample of queries is compared with all rows
once, and the radius covers `cover` of the Hamming distances of their true neighbours. Both samples are hash-chosen from distinct vectors.

Index. A code is cut into PARTS substrings. Two codes within radius r agree in one of them to r // PARTS bits,
so each row is posted under each substring, and a query is sent to every posting within that many bits. Postings
are dealt in cells, by place and the substring's first bits; a cell with more rows or queries than a bound is dealt
in blocks of both, so a copy group or cluster is many tasks. Inside a cell buckets of the remaining bits are
probed by bit masks. Every code within the radius is found, by its first agreeing substring, hence once; its cosine
is computed from the vectors. Queries that found fewer than k rows go again with a wider radius, in the end with all bits, which is all rows.

Cases: vectors that are null, empty, zero, or hold a null or a component that isn't finite take no part. Shorter
vectors count as filled up with zeros. Rows with the query's id are its own and never found by it; a row that
repeats is a candidate for each time, and is searched for each time. Equal vectors are one class with its k + 1 smallest ids, which is
all that a list of k can show; ties go to the smaller id, null last. Ids may be of any type that orders. An empty table gives no rows; other columns don't matter.
What reaches the driver: SAMPLE vectors, FIT_QUERIES lists of k. What is broadcast: a rotation of 64 times 64, the sample queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches

BITS, PARTS = 64, 4
WIDTH = BITS // PARTS
#: Distinct vectors that rotation and radius are learned from, about so many.
SAMPLE, FIT_QUERIES = 8192, 256
#: Postings of a cell, and queries of a cell, in one block.
CELL_ROWS, CELL_QUERIES = 4096, 8192
#: Slots of one set of probes.
PROBES = 1 << 20


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vec of the rows that take part; negative zeros made positive, so that equal vectors are equal values."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.lit(0).cast(df.schema[vector].dataType.elementType)
    return df.where(F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))).select(F.col(key).alias("id"), F.transform(vector, lambda x: x + zero).alias("vec"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """cid, vec, members: each distinct vector with its k + 1 smallest ids and how often each occurs (k at most matter). Ids are cut to k + 1 before and after the shuffle by vector."""
    copies = rows.groupBy("vec", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    first = copies.withColumn("place", F.row_number().over(Window.partitionBy("vec").orderBy(F.col("id").asc_nulls_last()))).where(F.col("place") <= k + 1)
    grouped = first.groupBy("vec").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "n"))), lambda m: F.struct(m["id"], m["n"])).alias("members"))
    return saved(grouped.select(F.monotonically_increasing_id().alias("cid"), "vec", "members"))


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Vectors as rows of doubles, zeros where one is short; each scaled by a power of two to a largest component in [0.5, 1), which is exact."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(int(sizes.max(initial=0)), 1)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        out = flat.reshape(-1, width)
    else:
        out = np.zeros((len(sizes), width))
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    out = np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, keepdims=True))[1])
    if dim is not None and dim != width:
        out = np.pad(out, ((0, 0), (0, max(0, dim - width))))[:, :dim]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired rows, by the same operations in the same order wherever the pair is met."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class Coder:
    """Signs of turned vectors as 64-bit codes."""

    def __init__(self, sample: np.ndarray, rounds: int = 30):
        u = unit(sample)
        self.dim = u.shape[1]
        self.mean = u.mean(axis=0)
        z = u - self.mean
        axes = np.linalg.eigh(z.T @ z)[1][:, ::-1]
        rng = np.random.default_rng(0)
        # With fewer dimensions than bits the axes are turned into as many directions as there are bits.
        axes = axes[:, :BITS] if self.dim >= BITS else axes
        turn = np.linalg.qr(rng.normal(size=(BITS, axes.shape[1])))[0].T if axes.shape[1] < BITS else np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
        z = z @ axes
        for _ in range(rounds):
            left, _, right = np.linalg.svd(z.T @ np.sign(z @ turn), full_matrices=False)
            turn = left @ right
        self.turn = axes @ turn

    def codes(self, column: pa.Array) -> np.ndarray:
        x = unit(matrix(column, self.dim))
        bits = (x - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel()


def learned(table: DataFrame) -> Coder | None:
    """A coder from about SAMPLE distinct vectors, chosen by hash; None if there are no vectors."""
    total = table.count()
    if not total:
        return None
    share = max(1, total // SAMPLE)
    rows = table.where(F.pmod(F.xxhash64("vec"), F.lit(share)) == 0).select("vec").limit(2 * SAMPLE).toArrow()
    if not rows.num_rows:
        rows = table.select("vec").limit(1).toArrow()
    column = rows.column(0).combine_chunks()
    # Codes are of the commonest length of the sample; scores use all components.
    dim = int(pc.mode(pc.list_value_length(column))[0]["mode"].as_py())
    return Coder(matrix(column, dim))


def coded(table: DataFrame, coder: Coder) -> DataFrame:
    """table with its codes, as signed 64-bit integers."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(coder.codes(b.column("vec")).view(np.int64))], names=[*b.schema.names, "code"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.mapInArrow(run, f"{fields}, code bigint")


def radius(table: DataFrame, queries: DataFrame, coder: Coder, k: int, cover: float) -> int:
    """The Hamming radius that holds `cover` of the true k nearest of a sample of queries, each compared with every row."""
    share = max(1, queries.count() // FIT_QUERIES)
    sample = queries.where(F.pmod(F.xxhash64("vec"), F.lit(share)) == 0).select("cid", "vec").limit(2 * FIT_QUERIES).toArrow()
    if not sample.num_rows:
        sample = queries.select("cid", "vec").limit(1).toArrow()
    if not sample.num_rows:
        return 0
    vectors = sample.column("vec").combine_chunks()
    dim = max(coder.dim, int(pc.max(pc.list_value_length(vectors)).as_py()))
    q, code, own = unit(matrix(vectors, dim)), coder.codes(vectors), sample.column("cid").to_numpy()

    def run(batches):
        best = np.full((len(q), k), -np.inf)
        dist = np.zeros((len(q), k), dtype=np.int64)
        for b in batches:
            x = unit(matrix(b.column("vec"), dim))
            s = q @ x.T
            s[own[:, None] == b.column("cid").to_numpy()[None, :]] = -np.inf
            d = np.bitwise_count(code[:, None] ^ coder.codes(b.column("vec"))[None, :])
            both, far = np.hstack([best, s]), np.hstack([dist, d])
            top = np.argpartition(-both, k - 1, axis=1)[:, :k]
            best, dist = np.take_along_axis(both, top, 1), np.take_along_axis(far, top, 1)
        at, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best[at, j]), pa.array(dist[at, j])], names=["q", "score", "d"])

    found = table.select("cid", "vec").mapInArrow(run, "q bigint, score double, d bigint")
    top = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d"))).where(F.col("place") <= k)
    out = top.agg(F.percentile("d", cover)).first()[0]
    return BITS if out is None else int(np.ceil(out))


def _prefix(part, bits: int):
    """First bits of a substring of `code`."""
    return F.shiftright(F.col("code"), (PARTS - 1 - part) * WIDTH + WIDTH - bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _posted(rows: DataFrame, queries: DataFrame, r: int, bits: int) -> DataFrame:
    """Postings and probing queries of all cells, dealt in blocks and sorted: a block's postings, then its queries."""
    near = min(bits, r // PARTS)
    parts = lambda what: F.explode(F.array(*(F.struct(F.lit(p).alias("part"), what(p).alias("prefix")) for p in range(PARTS))))
    posts = rows.select("cid", "code", "vec", "members", parts(lambda p: _prefix(p, bits)).alias("c")).select("*", "c.part", "c.prefix")
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda m: F.bit_count(m) <= near)
    probes = queries.select("cid", "code", "vec", parts(lambda p: _prefix(p, bits)).alias("c")).select("*", "c.part", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("c.prefix")))).alias("prefix"))
    cell = ["part", "prefix"]
    sizes = posts.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("down")).join(probes.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).alias("across")), cell)
    mix = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    none = F.lit(None).cast(rows.schema["members"].dataType)
    down = posts.join(sizes, cell).select(*cell, mix("down").alias("row"), every("across").alias("col"), F.lit(0).alias("kind"), "cid", "code", "vec", "members")
    over = probes.join(sizes, cell).withColumn("col", mix("across")).select(*cell, every("down").alias("row"), "col", F.lit(1).alias("kind"), "cid", "code", "vec", none.alias("members"))
    block = [*cell, "row", "col"]
    return down.union(over).repartition(*block).sortWithinPartitions(*block, "kind")


class Cell:
    """A block's postings under one substring: buckets of its remaining bits, probed by masks."""

    def __init__(self, table: pa.Table, part: int, prefix: int, bits: int, r: int, k: int):
        self.part, self.prefix, self.rest, self.r, self.k = part, prefix, WIDTH - bits, r, k
        low = self.low(codes := table.column("code").to_numpy().view(np.uint64))
        order = np.argsort(low, kind="stable")
        self.table = table.take(pa.array(order))
        self.codes = codes[order]
        self.ends = np.searchsorted(low[order], np.arange((1 << self.rest) + 1))
        self.vec = matrix(self.table.column("vec").combine_chunks())
        self.units = unit(self.vec)
        ids = pc.list_element(self.table.column("members"), 0).combine_chunks().field("id")
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(order))
        self.weights = np.bitwise_count(np.arange(1 << self.rest, dtype=np.uint32))

    def shift(self, part: int) -> int:
        return (PARTS - 1 - part) * WIDTH

    def sub(self, codes: np.ndarray, part: int) -> np.ndarray:
        return (codes >> np.uint64(self.shift(part))) & np.uint64((1 << WIDTH) - 1)

    def low(self, codes: np.ndarray) -> np.ndarray:
        return (self.sub(codes, self.part) & np.uint64((1 << self.rest) - 1)).astype(np.int64)

    def pairs(self, codes: np.ndarray, allowed: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) within the radius that agree here first; all these queries may differ in `allowed` of the remaining bits."""
        masks = np.flatnonzero(self.weights <= allowed)
        keys = (self.low(codes)[:, None] ^ masks[None, :]).ravel()
        starts, sizes = self.ends[keys], self.ends[keys + 1] - self.ends[keys]
        hit = np.flatnonzero(sizes)
        starts, sizes = starts[hit], sizes[hit]
        q = np.repeat(hit // len(masks), sizes)
        rows = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        differ = self.codes[rows] ^ codes[q]
        good = np.bitwise_count(differ) <= self.r
        for p in range(self.part):
            good &= np.bitwise_count(self.sub(differ, p)) > self.r // PARTS
        return q[good], rows[good]

    def nearest(self, batch: pa.Table) -> pa.Table | None:
        """The first k + 1 classes of each query of the batch, of those within the radius."""
        codes = batch.column("code").to_numpy().view(np.uint64)
        vec = matrix(batch.column("vec").combine_chunks())
        width = max(vec.shape[1], self.vec.shape[1])
        vec, mine = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vec, self.vec))
        units, own = unit(vec), np.pad(self.units, ((0, 0), (0, width - self.units.shape[1])))
        allowed = self.r // PARTS - np.bitwise_count((self.sub(codes, self.part) >> np.uint64(self.rest)) ^ np.uint64(self.prefix)).astype(np.int64)
        out = []
        for a in np.unique(allowed[allowed >= 0]).tolist():
            members = np.flatnonzero(allowed == a)
            step = max(1, PROBES // max(int((self.weights <= a).sum()), len(self.codes)))
            for at in range(0, len(members), step):
                some = members[at : at + step]
                q, rows = self.pairs(codes[some], a)
                if len(q):
                    # A product of blocks is cheaper than fetching pairs once a sixteenth of them is wanted.
                    s = (units[some] @ own.T)[q, rows] if 16 * len(q) > len(some) * len(own) else (units[some][q] * own[rows]).sum(axis=1)
                    out.append(self.first(some[q], rows, s, vec, mine))
        if not out:
            return None
        q, rows, score = (np.concatenate(x) for x in zip(*out, strict=True))
        got = self.table.take(pa.array(rows))
        return pa.table({"query": batch.column("cid").take(pa.array(q)), "score": score, "members": got.column("members")})

    def first(self, q: np.ndarray, rows: np.ndarray, near: np.ndarray, vec: np.ndarray, mine: np.ndarray):
        """The first k + 1 rows of each query, by the cosine in double precision, then the smaller id; near: cosines to about 1e-15."""
        order = np.lexsort((-near, q))
        q, rows, near = q[order], rows[order], near[order]
        start = np.searchsorted(q, q)
        last = near[np.minimum(start + self.k, np.searchsorted(q, q, side="right") - 1)]
        keep = near >= last - 1e-12
        q, rows = q[keep], rows[keep]
        score = cosine(vec[q], mine[rows])
        order = np.lexsort((self.place[rows], -score, q))
        q, rows, score = q[order], rows[order], score[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) <= self.k
        return q[keep], rows[keep], score[keep]


def _searched(rows: DataFrame, queries: DataFrame, r: int, k: int, total: int) -> DataFrame:
    """query (cid), found: the first k + 1 classes within the radius, as (score, id, members)."""
    bits = min(WIDTH, max(0, int(np.ceil(np.log2(max(1, total) / CELL_ROWS)))))
    posted = _posted(rows, queries, r, bits)

    def run(batches):
        cell, key, held = None, None, []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            keys = np.stack([t.column(c).to_numpy() for c in ("part", "prefix", "row", "col", "kind")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                at, kind = tuple(keys[:4, a].tolist()), keys[4, a]
                if at != key:
                    cell, key, held = None, at, []
                if kind == 0:
                    held.append(t.slice(a, b - a))
                elif held or cell:
                    if cell is None:
                        cell, held = Cell(pa.concat_tables(held), at[0], at[1], bits, r, k), []
                    out = cell.nearest(t.slice(a, b - a))
                    if out is not None:
                        yield from out.to_batches()

    member = rows.schema["members"].dataType.simpleString()
    found = posted.mapInArrow(run, f"query bigint, score double, members {member}")
    first = Window.partitionBy("query").orderBy(F.desc("score"), F.col("members")[0]["id"].asc_nulls_last())
    return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "score", "members"))).alias("found"))


def search(df: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", cover: float = 0.97, reach: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row for which is_query holds. reach: the first radius, else it is learned."""
    small_batches(df.sparkSession)
    schema = f"query_id {df.schema[key].dataType.simpleString()}, rank int, vec_id {df.schema[key].dataType.simpleString()}, score double"
    rows = classes(usable(df, key, vector), k)
    wanted = usable(df.where(is_query), key, vector)
    coder = learned(rows)
    if coder is None:
        return df.sparkSession.createDataFrame([], schema)
    rows = saved(coded(rows, coder))
    total = rows.count()
    asked = saved(rows.join(wanted.select("vec").distinct(), "vec", "left_semi"))
    r = radius(rows, asked, coder, k, cover) if reach is None else reach
    done, left = None, asked
    size = F.aggregate("found", F.lit(0), lambda a, f: a + F.aggregate(f["members"], F.lit(0), lambda b, m: b + m["n"]))
    while True:
        found = saved(left.select("cid").join(_searched(rows, left, r, k, total), F.col("cid") == F.col("query"), "left").select("cid", "found"))
        # A query's own id may take the whole first place; k rows beside it are certain once k + 1 ids are there, and at the full radius nothing is missing.
        ids = F.coalesce(F.aggregate("found", F.lit(0), lambda a, f: a + F.size(f["members"])), F.lit(0))
        whole = F.lit(True) if r >= BITS else (ids > k) & (F.coalesce(size, F.lit(0)) > k)
        now = found.where(whole)
        done = now if done is None else done.union(now)
        if r >= BITS or found.where(~whole).isEmpty():
            break
        left = saved(left.join(found.where(~whole).select("cid"), "cid", "left_semi"))
        r = min(BITS, r + 8)
    lists = done.where(F.col("found").isNotNull()).join(asked.select("cid", "vec"), "cid").select(
        "vec",
        F.array_sort(F.flatten(F.transform("found", lambda f: F.flatten(F.transform(f["members"], lambda m: F.array_repeat(F.struct((-f["score"]).alias("far"), m["id"].isNull().alias("last"), m["id"].alias("id")), m["n"])))))).alias("near"),
    )
    # Copies of one vector may be many queries: both sides are dealt over salts.
    salts = 16
    asking = wanted.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    spread = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = asking.join(spread, ["vec", "salt"]).select("id", F.posexplode(F.slice(F.filter("near", lambda x: ~x["id"].eqNullSafe(F.col("id"))), 1, k)).alias("at", "x"))
    return out.select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def report(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each row whose id is divisible by `every`."""
    return search(df, F.col(key) % every == 0, k, key, vector)
