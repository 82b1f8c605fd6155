"""Token ids in seekable files: independent zstandard frames, checksums, a trailing seek table.

A shard file is, in this order:

* data frames: zstandard frames of up to ``FRAME_IDS`` little-endian 32-bit ids, each with its own
  content checksum; a document may begin and end inside frames;
* one skippable frame with the directory, compressed: number of documents, then for each the
  doc_id, whether it is null, and its number of ids;
* the seek table, a skippable frame of zstandard's public seekable format: for each frame the
  compressed size, the size and the low 32 bits of its content's XXH64, then a footer.

Any zstandard reader can decompress a whole file; ours reads the seek table from the end and then
only the frames that hold the documents asked for.

Shards follow ascending doc_id (null first; ties by text). A shard is written under a name of its
own by each attempt, and the manifest, a table written by Spark's commit protocol, names the file
of the attempt that counted: a lost executor costs its shards' work only.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from veritab.llm.common import END_ID, open_store, ship, sliced, stored, table, tokenizer_path
from veritab.llm.encoding import encoder
from veritab.sources.scratch import scratch_path

FRAME_IDS = 1 << 16
# Fixed values of the public seekable format.
SKIPPABLE_DIRECTORY = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

MANIFEST = "shard long, path string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


class ShardWriter:
    """Writes one shard; holds one frame and the directory in memory."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.level, self.held, self.size = sink, level, [], 0
        self.frames, self.directory = [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.directory.append((doc_id or 0, doc_id is None, len(ids)))
        while len(ids):
            part, ids = ids[: FRAME_IDS - self.size], ids[FRAME_IDS - self.size:]
            self.held.append(part)
            self.size += len(part)
            if self.size == FRAME_IDS:
                self._frame()

    def _frame(self) -> None:
        data = np.concatenate(self.held).astype("<u4").tobytes()
        packed = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> tuple[int, int]:
        if self.size:
            self._frame()
        ids, null, sizes = (np.array(x) for x in zip(*self.directory, strict=True)) if self.directory else ([], [], [])
        packed = zstandard.ZstdCompressor().compress(
            struct.pack("<Q", len(ids)) + np.asarray(ids, "<i8").tobytes()
            + np.asarray(null, "u1").tobytes() + np.asarray(sizes, "<i8").tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE_DIRECTORY, len(packed)) + packed)
        self.frames.append((len(packed) + 8, 0, 0))
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(entries) + len(footer)) + entries + footer)
        return len(ids), int(np.sum(sizes, dtype=np.int64)) if len(ids) else 0


class ShardReader:
    """Random access to one shard: ``ids(first, count)`` decompresses only the frames it needs."""

    def __init__(self, path: str):
        files, name = open_store(path)
        self.file = files.open_input_file(name)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{path}: no seek table")
        entries = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sums = entries[:-1, 2]
        self.at = np.concatenate(([0], np.cumsum(entries[:, 0])))
        self.upto = np.concatenate(([0], np.cumsum(entries[:-1, 1]))) // 4
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(entries[-1, 0]) - 8, int(self.at[n - 1]) + 8))
        (count,) = struct.unpack_from("<Q", raw)
        self.doc_ids = np.frombuffer(raw, "<i8", count, 8)
        self.null = np.frombuffer(raw, "u1", count, 8 + 8 * count).astype(bool)
        self.sizes = np.frombuffer(raw, "<i8", count, 8 + 9 * count)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.frame, self.content = -1, None

    def _read(self, k: int) -> np.ndarray:
        if k != self.frame:
            packed = self.file.read_at(int(self.at[k + 1] - self.at[k]), int(self.at[k]))
            data = zstandard.ZstdDecompressor().decompress(packed)
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.frame, self.content = k, np.frombuffer(data, "<u4")
        return self.content

    def ids(self, first: int, count: int) -> np.ndarray:
        out, k = [], int(np.searchsorted(self.upto, first, "right")) - 1
        while count > 0:
            part = self._read(k)[first - self.upto[k]:][:count]
            out.append(part)
            first, count, k = first + len(part), count - len(part), k + 1
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID,
                      by_word: bool = True) -> DataFrame:
    """Writes shards of ``docs(doc_id, text)`` under ``path`` and returns the manifest.

    Null texts are empty, rows with equal doc_id are kept as documents of their own, a null doc_id
    comes first, other columns are ignored, and an empty table gives an empty manifest.
    """
    ship(docs.sparkSession)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, sink, name = TaskContext.get().partitionId(), None, None, None
        encode = None
        for batch in sliced(batches, remember=True):
            if not len(batch):
                continue
            if writer is None:
                encode = encoder(tokenizer, by_word)
                name = f"{path}/shard-{shard:06d}-{uuid.uuid4().hex}.zst"
                files, local = open_store(name)
                files.create_dir(local.rsplit("/", 1)[0], recursive=True)
                sink = files.open_output_stream(local, compression=None)
                writer = ShardWriter(sink)
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"], end_id), strict=True):
                writer.add(doc_id, ids)
        if writer is not None:
            n_docs, n_tokens = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "path": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    in_order = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                .repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text"))
    return stored(in_order.mapInArrow(shards, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Documents of a manifest's files: doc_id, start (ids of all documents before it), n_tokens, ids.

    ``wanted(doc_id)`` limits the result to its documents; only their frames are decompressed, and
    its ids reach the shards by a join with each shard's directory. The running total over shards
    handles one row per file.
    """
    spark = manifest.sparkSession
    ship(spark)
    placed = manifest.withColumn(
        "before", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def rows(path: str, before: int, which: np.ndarray | None, reader: ShardReader | None = None) -> Iterator[pa.RecordBatch]:
        shard = reader or ShardReader(path)
        which = np.arange(len(shard.sizes)) if which is None else which
        for at in range(0, len(which), 512):
            part = which[at: at + 512]
            yield pa.RecordBatch.from_arrays([
                pa.array(shard.doc_ids[part], mask=shard.null[part]),
                pa.array(before + shard.starts[part]), pa.array(shard.sizes[part]),
                pa.array([shard.ids(int(shard.starts[i]), int(shard.sizes[i])).tobytes() for i in part], pa.binary()),
            ], ["doc_id", "start", "n_tokens", "ids"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch["path"].to_pylist(), batch["before"].to_pylist(), strict=True):
                yield from rows(path, before, None)

    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch["path"].to_pylist(), batch["before"].to_pylist(), strict=True):
                shard = ShardReader(path)
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * len(shard.sizes)), pa.array([before] * len(shard.sizes), pa.int64()),
                    pa.array(np.arange(len(shard.sizes))), pa.array(shard.doc_ids, mask=shard.null)],
                    ["path", "before", "place", "doc_id"])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, path = None, None
        for batch in batches:
            for name, before, place in zip(*(batch[c].to_pylist() for c in ("path", "before", "place")), strict=True):
                if name != path:
                    shard, path = ShardReader(name), name
                yield from rows(name, before, np.array([place]), shard)

    n_files = max(1, manifest.count())  # numbered, or adaptive execution would merge these few small rows into one task
    per_file = placed.select("path", "before").repartition(n_files, "path")
    if wanted is None:
        return per_file.mapInArrow(whole, DOCUMENTS)
    found = per_file.mapInArrow(directory, "path string, before long, place long, doc_id long").join(
        wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return (found.select("path", "before", "place").repartition(n_files, "path").sortWithinPartitions("path", "place")
            .mapInArrow(some, DOCUMENTS))


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(x.as_buffer()) for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents.mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written, read back and summed up."""
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, scratch_path(spark, "token-files"), tokenizer_path())
    return digest(read_token_files(manifest))
