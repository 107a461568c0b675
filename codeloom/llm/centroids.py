"""Centroid clustering on integer vectors: float32 products shortlist centroids, exact integers decide.

A vector is kept if it has the wanted number of components, none null or not finite; each component x
becomes the integer floor(64 x). A task multiplies its rows with all centroids in float32. For integers
v, c of n components any order of summation errs by at most g (|c|^2 + 2 |v||c|), g = (n + 8) u / (1 - (n + 8) u),
u = 2^-24, so |c|^2 - 2 v.c lies in an interval around the computed figure. A centroid whose interval lies
above another's is out; where several are left their distances are computed with integers, and the smallest
number of the nearest wins. So the result is that of exact arithmetic, whatever the library of the product does.

Cases: rows that are not kept give nothing; an empty table gives no rows. Rows that repeat are vectors of
their own. Ids may be of any type; a null id is kept and starts a centroid only where ids run out; of seeds
with one id the smaller vector goes first. Fewer kept vectors than centroids: each is one. Components beyond 2^27 after scaling are
computed with Python's integers; a distance, or a sum of distances, beyond a long is null. Texts do not occur; other columns
don't matter. What is broadcast: the centroids, k times n integers, both parameters.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

#: Components are scaled by this before they are cut to integers.
SCALE = 64
#: Integers below this in magnitude have 64-bit squared distances, up to DIM components.
NARROW, DIM = 1 << 27, 64
#: Sums travel in digits of so many bits, so that they are exact at any size.
DIGIT = 30
#: Rows of one product.
ROWS = 8192


def kept(df: DataFrame, vector: str = "embedding", dim: int = DIM) -> DataFrame:
    """Rows whose vector has dim components, none null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.coalesce((F.size(vector) == dim) & ~bad, F.lit(False)))


def integers(flat: np.ndarray, dim: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """floor(64 x) as 64-bit rows, and by row number those that don't fit NARROW, as Python's integers (zero in the array)."""
    x = flat.astype(np.float64).reshape(-1, dim)
    wide = np.flatnonzero((np.abs(x) >= NARROW // SCALE).any(axis=1))
    big = {int(i): [math.floor(y * SCALE) if abs(y) < 2**53 else int(y) * SCALE for y in x[i].tolist()] for i in wide}
    x[wide] = 0
    return np.floor(x * SCALE).astype(np.int64), big


def squared(v: list[int], c: list[int]) -> int:
    return sum((a - b) ** 2 for a, b in zip(v, c, strict=True))


class Centroids:
    """Centroids with what screening needs; nearest() is exact."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.far = np.array([max(map(abs, r), default=0) >= NARROW for r in rows])
        self.exact = np.array([[0] * len(r) if f else r for r, f in zip(rows, self.far, strict=True)], dtype=np.int64)
        self.float = self.exact.astype(np.float32).T.copy()
        self.square = (self.exact**2).sum(axis=1)
        n = self.exact.shape[1] + 8
        self.g = n * 2.0**-24 / (1 - n * 2.0**-24)

    def bounds(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Below and above |c|^2 - 2 v.c, for each row and centroid."""
        mid = self.square.astype(np.float32) - 2 * (v.astype(np.float32) @ self.float)
        lengths = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        # 1 + 1e-9 covers the double-precision lengths themselves.
        err = self.g * (1 + 1e-9) * (self.square + 2 * lengths[:, None] * np.sqrt(self.square.astype(np.float64)))
        low, high = mid - err, mid + err
        if self.far.any():  # not in the product: at least one component is far from any narrow one
            low[:, self.far], high[:, self.far] = -np.inf, np.inf
        return low, high

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Number of the nearest centroid and squared distance of each narrow row."""
        low, high = self.bounds(v)
        left = low <= high.min(axis=1, keepdims=True)
        best = left.argmax(axis=1)
        one = left.sum(axis=1) == 1
        out: list[int | None] = [None] * len(v)
        narrow = one & ~self.far[best]
        where = np.flatnonzero(narrow)
        for i, d in zip(where.tolist(), ((v[where] - self.exact[best[where]]) ** 2).sum(axis=1).tolist(), strict=True):
            out[i] = d
        rest = np.flatnonzero(~narrow)
        near = rest[~(left[rest] & self.far).any(axis=1)]
        if len(near):  # among narrow centroids only: 64-bit integers are exact
            r, c = np.nonzero(left[near])
            d = np.full(left[near].shape, np.iinfo(np.int64).max)
            d[r, c] = ((v[near][r] - self.exact[c]) ** 2).sum(axis=1)
            best[near] = d.argmin(axis=1)
            for i, x in zip(near.tolist(), d.min(axis=1).tolist(), strict=True):
                out[i] = x
        for i in set(rest.tolist()) - set(near.tolist()):
            best[i], out[i] = self.by_integers(v[i].tolist())
        return best, out

    def by_integers(self, v: list[int]) -> tuple[int, int]:
        d = [squared(v, c) for c in self.rows]
        return d.index(min(d)), min(d)


def _batches(batches, vector: str, dim: int):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            v, big = integers(part.column(vector).flatten().to_numpy(zero_copy_only=False), dim)
            yield part, v, big


def _digits(total: int) -> list[int]:
    """total in digits of DIGIT bits, lowest first; the last one has the sign."""
    out = []
    while not -(1 << DIGIT) < total < 1 << DIGIT:
        out.append(total & ((1 << DIGIT) - 1))
        total >>= DIGIT
    return [*out, total]


def _sums(df: DataFrame, centroids: Centroids, vector: str, dim: int) -> DataFrame:
    """For each centroid, digit and place j: the count of its vectors (j = 0) and the sums of their components; k (n + 1) rows a task go into the shuffle."""

    def run(batches):
        count = np.zeros(len(centroids.rows), dtype=np.int64)
        total = [[0] * dim for _ in centroids.rows]
        for _, v, big in _batches(batches, vector, dim):
            best, _ = centroids.nearest(v)
            for i, x in big.items():
                best[i], _ = centroids.by_integers(x)
                total[best[i]] = [a + b for a, b in zip(total[best[i]], x, strict=True)]
            for c in np.unique(best).tolist():
                count[c] += (best == c).sum()
                total[c] = [a + b for a, b in zip(total[c], v[best == c].sum(axis=0).tolist(), strict=True)]
        rows = []
        for c in np.flatnonzero(count).tolist():
            digits = [_digits(t) for t in [int(count[c]), *total[c]]]
            for at in range(max(map(len, digits))):
                rows.append({"cluster": c, "digit": at, "sums": [d[at] if at < len(d) else 0 for d in digits]})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([("cluster", pa.int32()), ("digit", pa.int32()), ("sums", pa.list_(pa.int64()))])
    parts = df.select(vector).mapInArrow(run, "cluster int, digit int, sums array<bigint>")
    return parts.select("cluster", "digit", F.posexplode("sums").alias("j", "s")).groupBy("cluster", "digit", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def seeds(df: DataFrame, k: int, key: str, vector: str, dim: int) -> list[list[int]]:
    """The first centroids: the k vectors with the smallest sha256 of `1:<id>`; k rows reach the driver."""
    order = F.sha2(F.concat(F.lit("1:"), F.col(key).cast("string")), 256)
    rows = df.orderBy(order.asc_nulls_last(), vector).select(vector).limit(k).collect()
    out = []
    for r in rows:
        v, big = integers(np.array(r[0], dtype=np.float64), dim)
        out.append(big.get(0) or v[0].tolist())
    return out


def fit(df: DataFrame, k: int = 16, rounds: int = 3, key: str = "vec_id", vector: str = "embedding", dim: int = DIM) -> Centroids | None:
    """Centroids after so many rounds of assigning and averaging; None without vectors. df holds kept rows. A round brings k (n + 1) sums to the driver."""
    centroids = seeds(df, k, key, vector, dim)
    if not centroids:
        return None
    for _ in range(rounds):
        sums: dict[int, list] = {}
        for r in _sums(df, Centroids(centroids), vector, dim).collect():
            sums.setdefault(r["cluster"], [0] * (dim + 1))[r["j"]] += int(r["s"]) << DIGIT * r["digit"]
        for c, (n, *total) in sums.items():
            centroids[c] = [t // n for t in total]
    return Centroids(centroids)


def assigned(df: DataFrame, centroids: Centroids, key: str = "vec_id", vector: str = "embedding", dim: int = DIM) -> DataFrame:
    """Id, cluster and exact squared distance of each kept row."""
    small_batches(df.sparkSession)

    def run(batches):
        for part, v, big in _batches(batches, vector, dim):
            best, dist = centroids.nearest(v)
            for i, x in big.items():
                best[i], dist[i] = centroids.by_integers(x)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(best.astype(np.int32)), pa.array([d if d < 1 << 63 else None for d in dist], pa.int64())], names=["id", "cluster", "distance"])

    return df.select(F.col(key).alias("id"), vector).mapInArrow(run, f"id {df.schema[key].dataType.simpleString()}, cluster int, distance bigint")


def report(df: DataFrame, k: int = 16, rounds: int = 3, key: str = "vec_id", vector: str = "embedding", dim: int = DIM) -> DataFrame:
    """Cluster, distance, sums of distances and the digest of the final centroid, for each kept vector."""
    small_batches(df.sparkSession)
    rows = kept(df, vector, dim)
    centroids = fit(rows, k, rounds, key, vector, dim)
    spark = df.sparkSession
    schema = f"{key} {df.schema[key].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if centroids is None:
        return spark.createDataFrame([], schema)
    out = saved(assigned(rows, centroids, key, vector, dim))
    sums = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("d")).collect()}
    whole = None if None in sums.values() else sum(sums.values())
    fits = lambda x: None if x is None or x >= 1 << 63 else int(x)
    facts = [(c, fits(d), fits(whole), hashlib.sha256(",".join(map(str, centroids.rows[c])).encode()).hexdigest()) for c, d in sums.items()]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row for each centroid: k rows, a parameter.
    return out.withColumnRenamed("id", key).join(F.broadcast(table), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
