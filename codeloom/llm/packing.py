"""Packing of tokenised documents into windows by best fit, longest first.

Documents are encoded, ended with ``end_id`` and cut into full windows and a rest. A
shard of pieces is packed by best-fit decreasing: a segment tree over remaining
capacity finds the tightest open window for each piece. Shards are dealt by hash and
hold about ``shard_docs`` documents, so neither a task's memory nor the depth of its
work grows with the corpus, and a shard leaves only its last windows unfilled.

Cases: a null or empty text is one piece with the end id alone. A text of any length is
encoded whole and cut into pieces. Repeated rows and documents with one id are separate
documents; rows that are alike in id and text share a shard, copies under other ids don't,
as only what a row holds may choose its shard if a lost task is to be run again. Columns other than the id and the text are ignored, whatever their names. An empty
table gives no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, small_batches, tokenizer_path
from .token_ids import encoded

WINDOW, END_ID, SHARD_DOCS = 4096, 2, 4096


def default_path() -> str:
    return tokenizer_path("word_bpe_49k.json")


class CapacityTree:
    """Open windows by remaining capacity; take() gives one of the least capacity that suffices."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        i = self.size + capacity
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(window, its capacity), removed from the tree."""
        count, i = self.count, self.size + least
        while not count[i]:
            # Climb to the first subtree on the right that holds an open window.
            while i & 1 or not count[i + 1]:
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        window = self.open[capacity].pop()
        self._change(capacity, -1)
        return window, capacity


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """For pieces in order of falling length: the window of each and its offset there."""
    tree, opened = CapacityTree(window), 0
    windows, offsets = [], []
    for n in lengths:
        if n > window:
            raise ValueError("a piece is longer than a window")
        got = tree.take(n) if n else (opened - 1, 0)
        if got is None:
            got, opened = (opened, window), opened + 1
        w, capacity = got
        windows.append(w)
        offsets.append(window - capacity)
        if capacity > n:
            tree.put(capacity - n, w)
    return windows, offsets


def encode_pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit, binary), doc_tokens: the pieces of every document."""
    end = np.asarray([end_id], "<u4").tobytes()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows, starts, lengths, pieces, totals = [], [], [], [], []
        for i, ids in enumerate(encoded(part.column(1), path, end)):
            total = len(ids) // 4
            for a in range(0, total, window):
                rows.append(i)
                starts.append(a)
                lengths.append(min(window, total - a))
                pieces.append(ids[4 * a : 4 * (a + window)])
                totals.append(total)
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(pieces, pa.binary()), pa.array(totals, pa.int64())], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_text(rows, work, "doc_id long, start long, length long, ids binary, doc_tokens long", limit=8 << 20)


def pack(pieces: DataFrame, documents: int, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """pieces, with sequence_id and offset. documents: about how many documents they come from.

    sequence_id has the shard in its upper bits; offsets in a sequence leave no gap.
    Whatever columns the pieces have travel along, so drop long ones that aren't needed.
    """
    shards = max(1, -(-documents // shard_docs))
    dealt = pieces.withColumn("__shard", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", *[c for c in pieces.columns if c == "ids_crc32"]), F.lit(shards)).cast("long"))
    names = pieces.columns

    def work(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        windows, offsets = best_fit_decreasing(group.column("length").to_pylist(), window)
        out = [group.column(c) for c in names]
        return pa.table([*out, pa.array([(shard << 32) + w for w in windows], pa.int64()), pa.array(offsets, pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    small_batches(pieces.sparkSession)
    return dealt.groupBy("__shard").applyInArrow(work, schema)


def sequences(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Whole sequences of packed pieces that have ids: sequence_id, length, ids, padding.

    A sequence is padded to the window unless its length is a power of two.
    """
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", "length", joined.alias("ids"), F.when(F.bit_count("length") == 1, 0).otherwise(F.lit(window) - F.col("length")).cast("long").alias("padding"))


def report(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """For each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = encode_pieces(docs, path, window, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    out = pack(pieces, docs.count(), window)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
