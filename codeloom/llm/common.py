"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_folder, ship

#: Texts are handed to Python in slices of about so many bytes, whatever the batch size.
SLICE_BYTES = 4 << 20
#: Arrow batches between the JVM and Python hold about so many bytes, on either side.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def saved(df: DataFrame) -> DataFrame:
    """The rows of df in the checkpoint folder that all executors share; lineage ends there."""
    return cut(df)


_FOLDERS: list[str] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name below the shared folder for tables of this application."""
    _FOLDERS.append(f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def stored(df: DataFrame, folder: str) -> DataFrame:
    """df as a table in a folder that all executors share."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _FOLDERS:
        _FOLDERS.remove(folder)


def clear(spark: SparkSession) -> None:
    """Delete all tables that operators have left in the shared folder; results that aren't written yet are lost with them."""
    for folder in list(_FOLDERS):
        remove(spark, folder)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose column holds about limit bytes each, one row at least."""
    import pyarrow.compute as pc

    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, whose default of 64 MB each task holds several times over; give executors the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer held; it learns of them when garbage is collected."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Hand memory that a task no longer needs back to the system; the Python worker lives on."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_text(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """work over byte-bounded slices of df's Arrow batches."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, limit):
                out = work(part)
                if out is not None:
                    yield out
                del out, part
        release()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The texts; a null is empty."""
    return [x or "" for x in column.to_pylist()]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer in the file, loaded once for each Python process, single-threaded."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a column; one number reaches the driver."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0
