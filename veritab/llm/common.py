"""Helpers the operators share: tables, stored steps, words and the workers' import path."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritab.sources.scratch import scratch_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Bytes of an Arrow batch between Spark and its workers, where the session doesn't say (Spark's default is
#: 64 MB): a batch lies in memory several times, on both sides.
ARROW_BATCH, SMALL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4194304b"
#: Whether shuffle files go at the end of a query; otherwise they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How to drop what a worker remembers from one task to the next: tasks of other kinds do so before they begin.
REMEMBERED: list[Callable[[], None]] = []


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and hands them small batches.

    On a cluster without the repository at the same place, hand the package to ``--py-files``.
    """
    if spark.conf.get(ARROW_BATCH, None) is None:
        spark.conf.set(ARROW_BATCH, SMALL_BATCH)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends here, lost executors lose nothing, and shuffle files go."""
    path, conf = scratch_path(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the path inside it, for tasks that write or read files of their own format."""
    uri = path if "://" in path or path.startswith("/") else path.replace(":", "://", 1)
    for spark_name, name in {"s3a://": "s3://", "s3n://": "s3://"}.items():
        uri = uri.replace(spark_name, name, 1) if uri.startswith(spark_name) else uri
    try:
        return pafs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"{path}: tasks can't open files of this store themselves; name a shared folder on file, hdfs, s3, gs or abfs "
                         "in spark.checkpoint.dir") from e


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts, and where each begins (with the end); null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0]: starts[-1]], starts - starts[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Returns freed memory to the system: workers are used again by later stages, which need it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def forget() -> None:
    for drop in REMEMBERED:
        drop()


def ending(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows; memory is given back behind the last."""
    forget()
    yield from rows
    give_back()


def sliced(batches: Iterator[pa.RecordBatch], size: int = 4 << 20, remember: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes, so that memory doesn't follow the length of texts."""
    if not remember:
        forget()
    for batch in batches:
        step = max(1, int(len(batch) * size / max(batch.nbytes, 1)))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)
    give_back()
