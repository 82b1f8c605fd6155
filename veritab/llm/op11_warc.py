"""Web archives written and read through a table of chunks.

A payload is a run of rows: a record's number, the chunk's number, up to ``CHUNK`` bytes, and how many
bytes and which SHA-1 the payload has up to the end of this chunk. Rows are cut before they reach Python,
the digest is carried from row to row, and writer and reader hold one chunk at a time, so that a task's
memory doesn't follow the longest payload.

1. ``chunked`` makes the table of chunks; it is written once.
2. ``decided`` reads the last rows only. Among equal payloads (SHA-1 and size) of at least ``REVISITED``
   bytes, that of the largest page_id is the response and the others revisit it. The largest page_id of
   each payload is counted before the shuffle.
3. ``write_archives`` brings each record's decision and its chunks together and streams them into gzip
   members, one a record. Each attempt writes files of its own name; the manifest, written by Spark's
   commit, names those that counted.
4. ``read_archives`` streams the files back into rows of chunks, one task a file, and checks each
   payload's digest. ``resolved`` gives revisits the chunks of the response they refer to.

Null or missing html is an empty payload, a null url leaves out the target, rows without page_id or with
repeated ones are records of their own (a null page_id is smaller than any; of repeated rows one is the
response), other columns are ignored, an empty table gives no files. In a target, control characters are
percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.llm.common import open_store, ship, table
from veritab.sources.scratch import scratch_path

CHUNK, REVISITED, PIECE = 1 << 18, 1000, 1 << 18
CHUNKS = "record long, page_id long, url string, chunk long, bytes binary, upto long, digest string, last boolean"
MANIFEST = "path string, n_records long, n_bytes long"
READ = """record_id string, page_id long, url string, record_type string, refers_to long, refers_record string,
    chunk long, bytes binary, upto long, digest string, last boolean"""
# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def kept(df: DataFrame, label: str) -> DataFrame:
    """Written and read again like other steps, but packed well: payloads are most of the disk."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunked(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """The table of chunks of ``pages(page_id, url, html)``, stored; every payload has a row, also an empty one."""
    ship(pages.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, upto = hashlib.sha1(), 0
        for batch in batches:
            at, digest = [], []
            for chunk, part in zip(batch["chunk"].to_pylist(), batch["bytes"], strict=True):
                if chunk == 0:
                    sha, upto = hashlib.sha1(), 0
                sha.update(part.as_buffer())
                upto += len(part.as_buffer())
                at.append(upto)
                digest.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("record", "page_id", "url", "chunk", "bytes")), pa.array(at, pa.int64()), pa.array(digest, pa.string()),
                 batch["last"]], ["record", "page_id", "url", "chunk", "bytes", "upto", "digest", "last"])

    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / size)).cast("long")
    rows = (pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"),
                         F.col("url").cast("string").alias("url"), payload.alias("payload"))
            .select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
            .select("record", "page_id", "url", "chunk", F.substring("payload", F.col("chunk") * size + 1, F.lit(size)).alias("bytes"),
                    (F.col("chunk") == n - 1).alias("last")))
    return kept(rows.mapInArrow(digests, CHUNKS), "payload-chunks")


def decided(chunks: DataFrame, revisited: int = REVISITED) -> DataFrame:
    """record, page_id, url, n_bytes, digest, record_type, refers_to, refers_record: a row per record."""
    heads = chunks.filter("last").select("record", "page_id", "url", F.col("upto").alias("n_bytes"), "digest")
    large = heads.filter(F.col("n_bytes") >= revisited)
    first = large.groupBy("digest", "n_bytes").agg(F.max(F.struct("page_id", (-F.col("record")).alias("record"))).alias("first"))
    response = F.col("first.record") == -F.col("record")
    other = F.when(~response, F.col("first.page_id")), F.when(~response, -F.col("first.record"))
    kinds = [F.when(response, "response").otherwise("revisit").alias("record_type"), other[0].alias("refers_to"), other[1].alias("refers_record")]
    alone = [F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("long").alias("refers_record")]
    return (large.join(first, ["digest", "n_bytes"]).select(*heads.columns, *kinds)
            .unionByName(heads.filter(F.col("n_bytes") < revisited).select(*heads.columns, *alone)))


def urn(page_id: int | None, record: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{record}>"


def page_of(name: str) -> int | None:
    page = name.split(":")[2]
    return int(page) if page else None


def target(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


class ArchiveWriter:
    """One gzip member a record, compressed as its chunks come."""

    def __init__(self, sink, date: str, level: int):
        self.sink, self.date, self.level, self.zip = sink, date, level, None
        self.records = self.size = 0

    def _write(self, data: bytes) -> None:
        packed = self.zip.compress(data)
        if packed:
            self.size += self.sink.write(packed)

    def begin(self, record: int, page_id: int | None, url: str | None, n_bytes: int, digest: str, kind: str,
              refers_to: int | None, refers_record: int | None) -> None:
        http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {n_bytes}\r\n\r\n").encode()
        fields = {"WARC-Type": kind, "WARC-Record-ID": urn(page_id, record), "WARC-Date": self.date}
        if url is not None:
            fields["WARC-Target-URI"] = target(url)
        fields["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
        if kind == "revisit":
            fields |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": urn(refers_to, refers_record)}
        fields |= {"X-Payload-Length": str(n_bytes), "Content-Type": "application/http; msgtype=response",
                   "Content-Length": str(len(http) + (n_bytes if kind == "response" else 0))}
        head = "".join(f"{name}: {value}\r\n" for name, value in fields.items())
        self.zip = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self._write(f"{VERSION}\r\n{head}\r\n".encode() + http)

    def end(self) -> None:
        if self.zip is not None:
            self._write(END)
            self.size += self.sink.write(self.zip.flush())
            self.zip, self.records = None, self.records + 1


def write_archives(chunks: DataFrame, records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Writes ``chunks`` as ``records`` (of ``decided``) say into ``*.warc.gz`` under ``path``; returns the manifest."""
    ship(chunks.sparkSession)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, kind = None, f"{path}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None
        for batch in batches:
            if writer is None and len(batch):
                store, local = open_store(name)
                store.create_dir(local.rsplit("/", 1)[0], recursive=True)
                sink = store.open_output_stream(local, compression=None)
                writer = ArchiveWriter(sink, date, level)
            about = batch.select(["record", "page_id", "url", "n_bytes", "digest", "record_type", "refers_to", "refers_record"]).to_pydict()
            for row, chunk, part in zip(zip(*about.values(), strict=True), batch["chunk"].to_pylist(), batch["bytes"], strict=True):
                if chunk < 0:
                    writer.end()
                    kind = row[5]
                    writer.begin(*row)
                elif kind == "response":
                    writer._write(part.as_buffer())
        if writer is not None:
            writer.end()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [writer.records], "n_bytes": [writer.size]})

    decision = records.withColumns({"chunk": F.lit(-1).cast("long"), "bytes": F.lit(None).cast("binary")})
    in_order = (decision.unionByName(chunks.select("record", "chunk", "bytes"), allowMissingColumns=True)
                .repartition("record").sortWithinPartitions("record", "chunk"))
    return kept(in_order.mapInArrow(files, MANIFEST), "archives")


class Inflated:
    """What a gzip file of many members holds, a bounded piece at a time."""

    def __init__(self, file):
        self.file, self.zip, self.packed, self.held = file, zlib.decompressobj(31), b"", bytearray()

    def more(self) -> bool:
        self.packed = self.packed or self.file.read(PIECE)
        if not self.packed:
            return False
        if self.zip.eof:
            self.zip = zlib.decompressobj(31)
        self.held += self.zip.decompress(self.packed, PIECE)
        self.packed = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
        return True

    def upto(self, mark: bytes) -> bytes:
        """Up to and without the mark, which is skipped; empty at the end of the file."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held:
                    raise ValueError("an archive ends within a record")
                return b""
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def read(self, most: int) -> bytes:
        """Up to ``most`` bytes, at least one."""
        while not self.held:
            if not self.more():
                raise ValueError("an archive ends within a payload")
        out = bytes(self.held[:most])
        del self.held[:most]
        return out


def records_of(file, size: int = CHUNK) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """Fields of each record and its payload in chunks, which are to be read before the next record."""
    data = Inflated(file)
    while head := data.upto(END):
        version, *lines = head.decode().split("\r\n")
        if version != VERSION:
            raise ValueError(f"no record begins with {version[:20]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        left = int(fields["Content-Length"]) - len(data.upto(END)) - len(END)

        def payload() -> Iterator[bytes]:
            nonlocal left
            part = b""
            while left:
                got = data.read(min(left, size - len(part)))
                left, part = left - len(got), part + got
                if len(part) == size or not left:
                    yield part
                    part = b""

        yield fields, payload()
        if left or data.upto(END):
            raise ValueError(f"{fields['WARC-Record-ID']}: the block's length is wrong")


def read_archives(manifest: DataFrame, payloads: bool = True, size: int = CHUNK) -> DataFrame:
    """The records of a manifest's files as rows of chunks.

    A revisit is one row without bytes, its length and digest those of the payload it refers to. Without
    ``payloads`` every record is its last row, without bytes; all payloads are read and checked all the same.
    """
    ship(manifest.sparkSession)
    names = [f.split()[0] for f in READ.replace("\n", " ").split(",")]
    kinds = dict(zip(names, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(),
                             pa.string(), pa.bool_()], strict=True))

    def rows(path: str) -> Iterator[tuple]:
        store, local = open_store(path)
        with store.open_input_stream(local, compression=None, buffer_size=0) as file:
            for fields, payload in records_of(file, size):
                name, other = fields["WARC-Record-ID"], fields.get("WARC-Refers-To")
                about = (name.strip("<>"), page_of(name.strip("<>")), fields.get("WARC-Target-URI"), fields["WARC-Type"],
                         other and page_of(other.strip("<>")), other and other.strip("<>"))
                told = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                length = int(fields["X-Payload-Length"])
                if fields["WARC-Type"] == "revisit":
                    for _ in payload:
                        raise ValueError(f"{name}: a revisit with a payload")
                    yield (*about, 0, None, length, told, True)
                    continue
                sha, upto, chunk, part = hashlib.sha1(), 0, 0, b""
                for chunk, part in enumerate(payload):
                    sha.update(part)
                    upto += len(part)
                    if payloads and upto < length:
                        yield (*about, chunk, part, upto, sha.hexdigest(), False)
                if (upto, sha.hexdigest()) != (length, told):
                    raise ValueError(f"{name}: the payload is damaged")
                yield (*about, chunk, part if payloads else None, upto, told, True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                held, weight = [], 0
                for row in rows(path):
                    held.append(row)
                    weight += 500 + len(row[7] or b"")
                    if weight > 4 << 20:
                        yield batch_of(held)
                        held, weight = [], 0
                if held:
                    yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kinds[n]) for n, x in zip(names, zip(*held, strict=True), strict=True)], names)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read, READ)


def resolved(records: DataFrame) -> DataFrame:
    """Rows of chunks in which revisits have the chunks of the response they refer to."""
    content = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_record"), "chunk", "bytes", "upto", "digest", "last")
    again = records.filter("record_type = 'revisit'").drop("chunk", "bytes", "upto", "digest", "last").join(content, "refers_record")
    return records.filter("record_type = 'response'").unionByName(again)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    chunks = chunked(table(spark, sf_dir, "pages"))
    manifest = write_archives(chunks, decided(chunks), scratch_path(spark, "warc"))
    return (read_archives(manifest, payloads=False)
            .select("page_id", F.col("upto").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM q
"""
