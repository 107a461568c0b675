"""Token ids of a corpus in Simple-8b segments, in ascending order of document id.

A segment is one self-contained block of bytes: header, word offset of each Simple-8b
block, code book (ids by falling frequency; a code is an id's rank, so frequent ids
take few bits), ids and lengths of its documents, coded words. It holds whole
documents, about ``SEGMENT_IDS`` ids. Segments are rows of Parquet files that Spark
writes and commits, so they may lie in any store, and a lost executor leaves no half
file. Each segment knows its file and how many ids of the file come before it; a
position in the corpus needs the totals of the files before only.

Cases: a null or empty text has the end id alone; documents with a null id come
first; documents with one id follow each other, by a hash of their texts, and are dealt
over files by it, however many there are. A text of any length is encoded whole; one of
more ids than a segment is a segment by itself. Columns other than the id and the text
are ignored, whatever their names. An empty table gives no segments and no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import new_folder, release, slices, small_batches
from .token_ids import HELD_CHUNKS, encoded

MAGIC, SEGMENT_IDS = b"S8BSEG01", 1 << 20


def segment_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A segment of documents with ids one after another."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    book = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    rank = np.zeros(max(len(counts), 1), np.uint64)
    rank[book] = np.arange(len(book), dtype=np.uint64)
    words, offsets = simple8b.encode(rank[ids])
    known = np.array([x is not None for x in doc_ids], np.uint8)
    head = np.array([len(doc_ids), len(ids), len(offsets), len(book), len(words)], "<u8")
    return b"".join([MAGIC, head.tobytes(), words.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array(lengths, "<u8").tobytes(), book.tobytes(), known.tobytes()])


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ids)."""
    if data[:8] != MAGIC:
        raise ValueError("not a segment of token ids")
    n_docs, n_ids, n_offsets, n_book, n_words = np.frombuffer(data, "<u8", 5, 8).astype(int).tolist()
    at = 48
    parts = []
    for kind, n in (("<u8", n_words), ("<u8", n_offsets), ("<i8", n_docs), ("<u8", n_docs), ("<u4", n_book), ("u1", n_docs)):
        parts.append(np.frombuffer(data, kind, n, at))
        at += parts[-1].nbytes
    words, offsets, docs, lengths, book, known = parts
    codes = simple8b.decode(words.astype(np.uint64), offsets.astype(np.int64), n_ids)
    return [d if k else None for d, k in zip(docs.tolist(), known.tolist())], lengths.astype(np.int64), book[codes] if n_ids else np.zeros(0, "<u4")


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs and write segments to folder, which every executor must reach."""
    end = np.asarray([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    ordered = hashed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def work(batches):
        file = TaskContext.get().partitionId()
        names, parts, held, before, number = [], [], 0, 0, 0

        def done():
            nonlocal names, parts, held, before, number
            lengths = [len(p) // 4 for p in parts]
            data = segment_bytes(names, lengths, np.frombuffer(b"".join(parts), "<u4"))
            out = pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "segment": pa.array([number], pa.int32()), "file_start": pa.array([before], pa.int64()), "n_ids": pa.array([held], pa.int64()), "data": pa.array([data], pa.binary())})
            names, parts, before, held, number = [], [], before + held, 0, number + 1
            return out

        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                for name, ids in zip(part.column(0).to_pylist(), encoded(part.column(1), path, end, 2 * HELD_CHUNKS)):
                    names.append(name)
                    parts.append(ids)
                    held += len(ids) // 4
                    if held >= segment_ids:
                        yield done()
        if names:
            yield done()
        release()

    small_batches(docs.sparkSession)
    ordered.mapInArrow(work, "file int, segment int, file_start long, n_ids long, data binary").write.mode("overwrite").option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids (binary) if asked for."""
    stored = spark.read.schema("file int, segment int, file_start long, n_ids long, data binary").parquet(folder)
    # One number for each file, of which there is one for each shuffle partition, reaches the driver and the tasks.
    bases, before = {}, 0
    for r in stored.groupBy("file").agg(F.sum("n_ids").alias("n")).orderBy("file").collect():
        bases[r["file"]] = before
        before += r["n"]

    def work(batches):
        for batch in batches:
            for file, first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                names, lengths, ids = read_segment(data.as_buffer())
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                out = [pa.array(names, pa.int64()), pa.array(bases[file] + first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(parts, pa.binary())] if with_ids else [])], names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    small_batches(spark)
    return stored.select("file", "file_start", "data").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def report(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write docs to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    write(docs, folder, path, end_id)
    return read(spark, folder)
