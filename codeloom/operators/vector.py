"""Nearest neighbours of a vector by cosine, exact and by locality-sensitive hashing; embedding tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

DIMENSIONS = (384, 768, 1024, 1536, 3072, 4096)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is all zeros."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, vector: str = "embedding", id_col: str = "id") -> DataFrame:
    """The k rows of the highest cosine similarity, equal ones by id; similarity rounded to 4 places after ordering."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sim = vectors.withColumn("s", cosine(F.col(vector), q)).where("s is not null")
    return sim.orderBy(F.desc("s"), id_col).limit(k).withColumn("similarity", F.round("s", 4)).drop("s", vector)


def planes(dimensions: int, bits: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(bits, dimensions))


def signatures(vectors: DataFrame, dimensions: int, bits: int = 48, seed: int = 1, vector: str = "embedding") -> DataFrame:
    """vectors with sig: the sides of random planes through the origin, bits of a long."""
    hyper, names = planes(dimensions, bits, seed), vectors.columns

    def work(batches):
        for b in batches:
            x = b.column(vector).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, dimensions)
            sig = ((x @ hyper.T > 0) * (1 << np.arange(bits))).sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sig, pa.int64())], names=[*names, "sig"])

    ship(vectors.sparkSession)
    return vectors.mapInArrow(work, vectors.withColumn("sig", F.lit(0).cast("long")).schema)


def nearest_by_hash(signed: DataFrame, query: list[float], k: int = 10, bits: int = 48, radius: int = 24, seed: int = 1, vector: str = "embedding", id_col: str = "id") -> DataFrame:
    """As nearest, over the rows whose signature differs in at most radius bits from the query's: approximate."""
    q = np.array(query, float)
    sig = int(((planes(len(query), bits, seed) @ q > 0) * (1 << np.arange(bits))).sum())
    close = signed.where(F.bit_count(F.col("sig").bitwiseXOR(F.lit(sig))) <= radius).drop("sig")
    return nearest(close, query, k, vector, id_col)


def upsert(stored: DataFrame, new: DataFrame, key: tuple[str, ...] = ("repo_id", "node_id", "model")) -> DataFrame:
    """Stored rows, those with a new row's key replaced by it."""
    return stored.join(new.select(*key), list(key), "left_anti").unionByName(new)


def latest(rows: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """One row of each key: the last by order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return rows.withColumn("rank", rank).where("rank = 1").drop("rank")


def drop_stale(stored: DataFrame, current: DataFrame, key: tuple[str, ...] = ("repo_id", "node_id")) -> DataFrame:
    return stored.join(current.select(*key), list(key), "left_semi")


def invalid(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Rows that don't fit their project's configuration (project_id, provider, model, dimensions); must be empty before a write."""
    joined = rows.join(config.select("project_id", F.col("provider").alias("p"), F.col("model").alias("m"), F.col("dimensions").alias("d")), "project_id", "left")
    return joined.where("p is null or p != provider or m != model or d != dimensions or size(embedding) != dimensions").drop("p", "m", "d")


def hashed_embedding(texts: DataFrame, dimensions: int = 384, text: str = "text_content") -> DataFrame:
    """texts with embedding: words hashed into a unit vector. Stands in for a model where none can be reached."""
    names = texts.columns

    def work(batches):
        import re
        import zlib

        for b in batches:
            out = np.zeros((b.num_rows, dimensions), np.float32)
            for i, t in enumerate(b.column(text).to_pylist()):
                for w in re.findall(r"\w+", (t or "").lower()):
                    h = zlib.crc32(w.encode())
                    out[i, h % dimensions] += 1 if h >> 16 & 1 else -1
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out /= np.where(norm > 0, norm, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(out), pa.list_(pa.float32()))], names=[*names, "embedding"])

    ship(texts.sparkSession)
    return texts.mapInArrow(work, texts.withColumn("embedding", F.expr("cast(array() as array<float>)")).schema)


def symbol_text(label: Column, name: Column, path: Column, container: Column | None = None, params: Column | None = None, signature: Column | None = None, code: Column | None = None) -> Column:
    """Lines Label, Name, Path and, where there are any, Container, Parameters, Signature (1000 characters) and Code."""
    line = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    none = F.lit(None).cast("string")
    return F.concat_ws(
        "\n", line("Label: ", label), line("Name: ", name), line("Path: ", path), line("Container: ", container if container is not None else none), line("Parameters: ", params if params is not None else none),
        line("Signature: ", F.substring(signature, 1, 1000) if signature is not None else none), line("Code:\n", code if code is not None else none),
    )


def code_snippet(content: Column, start: Column, end: Column, most_lines: int = 120, most_chars: int = 4000) -> Column:
    """Lines start..end, cut at most_lines and most_chars, trimmed; what is cut by characters ends in an ellipsis."""
    lines = F.split(content, "\n")
    first = F.greatest(F.coalesce(start, F.lit(1)), F.lit(1))
    n = F.least(F.greatest(F.coalesce(end, start, F.lit(1)) - first + 1, F.lit(1)), F.lit(most_lines))
    text = F.array_join(F.slice(lines, first, n), "\n")
    return F.trim(F.when(F.length(text) > most_chars, F.concat(F.substring(text, 1, most_chars), F.lit("\n..."))).otherwise(text))
