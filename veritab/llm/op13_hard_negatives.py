"""Hard negatives: rows of other labels whose score lies in a window below that of an anchor's positives.

1. ``keyed`` turns components into floor(256 * x) and gives each vector its place on a Hilbert curve through
   all dimensions (``BITS`` bits each).
2. ``write_blocks`` deals the candidates by label and place on the curve and writes them to Parquet, a row
   group a block of up to ``BLOCK`` rows of one label. A file's footer holds the zone maps: per block the
   least and greatest value of each dimension. The manifest, written by Spark's commit, has a row for each
   file and label, with the zone map of that whole segment.
3. Anchors, in tiles that are neighbours on the curve, look for their positives and then for the
   negatives of each positive's window. From a tile's vectors and a zone map, interval arithmetic gives
   the least and greatest score that a row of the block can have; segments first and then blocks are read
   only if these bounds reach an anchor's best scores so far (positives) or the open part of one of its
   windows (negatives). Promising segments come first, so that the bounds soon bite. Scores are exact.

A tile holds one block and the manifest's rows a batch at a time. What the bounds can spare depends on the
data: blocks of clustered vectors are mostly skipped; near-independent dimensions have wide zone maps, and
then a tile reads every block once, which is what any exact search must do.

Rows take no part if vec_id, label or vector is null, or a component is null, not finite or not finite after
multiplication by 256. Candidates of an anchor are rows of its own dimension with another vec_id; repeated
rows are candidates each, and repeated anchors return their rows each. Ties go to the smaller vec_id. An
empty table gives no rows. Scores are exact integers of any size; beyond 64 bits the returned ones are the
nearest 64-bit integer.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from heapq import nlargest
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.llm.common import open_store, ship, stored, table
from veritab.sources.scratch import scratch_path

BITS, BLOCK, MOST_IN_TILE, FIRST = 4, 1024, 2048, 4
KEYED = "vec_id long, label long, dims int, vec array<double>, place binary, row long"
MANIFEST = "path string, dims int, label long, first int, blocks int, low array<double>, high array<double>"
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
ORDER = ["dims", "label", "place", "vec_id", "row"]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (below 2**bits) on the Hilbert curve, as a row of bits, highest first.

    Per bit, cells are reflected and exchanged back to the curve's first orientation, then Gray-decoded.
    """
    x = cells.T.astype(np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(len(x)):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(hit, q - 1, swap)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    flip = np.zeros(x.shape[1], np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where(x[-1] & q, q - 1, 0)
    x ^= flip
    return np.concatenate([(x >> b & 1) for b in range(bits - 1, -1, -1)]).T.astype(np.uint8)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def keyed(vectors: DataFrame) -> DataFrame:
    """The rows of ``vectors(vec_id, label, embedding)`` that take part, with their place on the curve, stored."""
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                         F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 256).alias("vec"))
    big = F.lit(float("inf"))
    own = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()
                     & F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)), F.lit(False)))
    own = own.select("vec_id", "label", F.size("vec").alias("dims"), "vec", F.monotonically_increasing_id().alias("row"))
    span = own.groupBy("dims").agg(F.min(F.array_min("vec")).alias("low"), F.max(F.array_max("vec")).alias("high"))
    spans = {r.dims: (r.low or 0.0, r.high or 0.0) for r in span.collect()}  # a row for each dimension vectors have

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dims"].to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                x, (low, high) = np.floor(matrix(part["vec"], d)), spans[d]
                cells = np.zeros((len(part), max(d, 1)), np.int64)
                if high > low:
                    cells[:] = np.clip((x - low) / (high - low) * (1 << BITS), 0, (1 << BITS) - 1)
                place = [p.tobytes() for p in np.packbits(hilbert(cells, BITS), axis=1)]
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["label"], part["dims"], lists(x, pa.float64()), pa.array(place, pa.binary()),
                                                  part["row"]], ["vec_id", "label", "dims", "vec", "place", "row"])

    return stored(own.mapInArrow(places, KEYED), "keyed-vectors")


class Block(NamedTuple):
    dims: int
    label: int
    ids: np.ndarray
    vectors: np.ndarray


def runs(batches: Iterator[pa.RecordBatch], most: int, by: list[str]) -> Iterator[Block]:
    """Sorted rows in blocks of up to ``most`` with equal values of ``by``."""
    held, size, key = [], 0, None

    def block() -> Block:
        ids, labels, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
        return Block(key[0], labels if by == ["dims"] else key[1], ids, vectors)

    for batch in batches:
        keys = np.column_stack([batch[c].to_numpy() for c in by])
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if x == y:
                continue
            if key != tuple(keys[x].tolist()):
                if held:
                    yield block()
                held, size, key = [], 0, tuple(keys[x].tolist())
            while x < y:
                part = batch.slice(x, min(y - x, most - size))
                held.append((part["vec_id"].to_numpy(), part["label"].to_numpy(), matrix(part["vec"], key[0])))
                x, size = x + len(part), size + len(part)
                if size == most:
                    yield block()
                    held, size = [], 0
    if held:
        yield block()


SCHEMA = pa.schema([("vec_id", pa.int64()), ("vec", pa.list_(pa.float64()))])


class BlockFile:
    """Writes blocks as row groups, their zone maps into the footer, and tells the segments."""

    def __init__(self, path: str):
        self.path, self.blocks, self.segments = path, [], []
        store, local = open_store(path)
        store.create_dir(local.rsplit("/", 1)[0], recursive=True)
        self.sink = store.open_output_stream(local, compression=None)
        self.file = pq.ParquetWriter(self.sink, SCHEMA, compression="zstd")

    def add(self, block: Block) -> None:
        low, high = block.vectors.min(0), block.vectors.max(0)
        self.file.write_table(pa.Table.from_arrays([pa.array(block.ids), lists(block.vectors, pa.float64())], schema=SCHEMA))
        if self.segments and self.segments[-1][:2] == [block.dims, block.label]:
            last = self.segments[-1]
            last[3:] = [last[3] + 1, np.minimum(last[4], low), np.maximum(last[5], high)]
        else:
            self.segments.append([block.dims, block.label, len(self.blocks), 1, low, high])
        self.blocks.append((low, high))

    def close(self) -> pa.RecordBatch:
        zones = {f"{name}{i}": x.tobytes().hex() for i, block in enumerate(self.blocks) for name, x in zip(("low", "high"), block, strict=True)}
        self.file.add_key_value_metadata(zones)
        self.file.close()
        self.sink.close()
        dims, label, first, blocks, low, high = zip(*self.segments, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.path] * len(dims)), pa.array(dims, pa.int32()), pa.array(label, pa.int64()), pa.array(first, pa.int32()), pa.array(blocks, pa.int32()),
             pa.array([x.tolist() for x in low], pa.list_(pa.float64())), pa.array([x.tolist() for x in high], pa.list_(pa.float64()))],
            ["path", "dims", "label", "first", "blocks", "low", "high"])


def write_blocks(rows: DataFrame, path: str) -> str:
    """Writes the candidates' blocks under ``path``; returns where the manifest is."""
    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for block in runs(batches, BLOCK, ["dims", "label"]):
            out = out or BlockFile(f"{path}/blocks-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.parquet")
            out.add(block)
        if out:
            yield out.close()

    rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(files, MANIFEST).write.parquet(f"{path}-manifest")
    return f"{path}-manifest"


class Segments:
    """The blocks of a manifest, as a task reads them; counts what it reads."""

    def __init__(self, manifest: str):
        self.store, self.manifest = open_store(manifest)
        self.read = self.seen = 0

    def batches(self, dims: int) -> Iterator[list[tuple]]:
        """path, label, first, blocks, low, high of the segments of a dimension, some at a time."""
        rows = pads.dataset(self.manifest, filesystem=self.store, format="parquet").to_batches(filter=pads.field("dims") == dims, batch_size=1024)
        for batch in rows:
            columns = [batch[c].to_pylist() for c in ("path", "label", "first", "blocks")]
            yield list(zip(*columns, matrix(batch["low"], dims), matrix(batch["high"], dims), strict=True))

    def visit(self, segment: tuple, dims: int, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """vec_ids (ascending) and vectors of those blocks that ``wanted(low, high)`` asks for when their turn comes."""
        path, _, first, blocks, *_ = segment
        store, local = open_store(path)
        with store.open_input_file(local) as source, pq.ParquetFile(source) as file:
            zones = file.metadata.metadata
            low, high = (np.array([np.frombuffer(bytes.fromhex(zones[f"{name}{i}".encode()].decode())) for i in range(first, first + blocks)])
                         .reshape(blocks, dims) for name in ("low", "high"))
            for i in range(blocks):
                self.seen += 1
                if wanted(low[i: i + 1], high[i: i + 1]):
                    self.read += 1
                    part = file.read_row_group(first + i).combine_chunks()
                    ids, vectors = part["vec_id"].to_numpy(), matrix(part["vec"].combine_chunks(), dims)
                    order = np.argsort(ids, kind="stable")
                    yield ids[order], vectors[order]


class Tile:
    """Anchors of one dimension with what they have found so far."""

    def __init__(self, anchors: Block, exact: type, positives: int, negatives: int, window: tuple[int, int]):
        self.dims, self.labels, self.ids, n = anchors.dims, anchors.label, anchors.ids, len(anchors.ids)
        self.exact, self.window = exact, window
        self.x = self.typed(anchors.vectors)
        self.up, self.down = np.maximum(self.x, 0), np.minimum(self.x, 0)
        self.best, self.best_ids = self.none(n, positives), np.zeros((n, positives), np.int64)
        self.found, self.found_ids = self.none(n, positives, negatives), np.zeros((n, positives, negatives), np.int64)

    def typed(self, x: np.ndarray) -> np.ndarray:
        """Floats where all scores are exact in them, else Python's integers."""
        return x if self.exact is float else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)

    def none(self, *shape: int) -> np.ndarray:
        return np.full(shape, -math.inf, self.exact)

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each anchor with anything in each box."""
        low, high = self.typed(low).T, self.typed(high).T
        return self.up @ low + self.down @ high, self.up @ high + self.down @ low

    def scores(self, who: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        out = self.x[who] @ self.typed(vectors).T
        out[self.ids[who][:, None] == ids] = -math.inf  # an anchor's own id is no candidate
        return out

    def keep(self, scores: np.ndarray, ids: np.ndarray, best: np.ndarray, best_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best so far and of a block (rows by ascending id), higher scores first, ties by smaller id."""
        n = best.shape[1]
        top = np.argsort(-scores, axis=1, kind="stable")[:, :n]
        both, both_ids = np.hstack([best, np.take_along_axis(scores, top, 1)]), np.hstack([best_ids, ids[top]])
        order = np.argsort(both_ids, axis=1, kind="stable")
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(both, order, 1), axis=1, kind="stable"), 1)[:, :n]
        return np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)

    def reach_positives(self, label: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Anchors by boxes: whether a box can hold one of the anchor's best."""
        return (self.labels == label)[:, None] & (self.bounds(low, high)[1] >= self.best[:, -1:])

    def add_positives(self, who: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = self.scores(who, ids, vectors)
        some = (scores >= self.best[who, -1:]).any(1)
        who = who[some]
        self.best[who], self.best_ids[who] = self.keep(scores[some], ids, self.best[who], self.best_ids[who])

    def open_windows(self) -> None:
        """Scores between the window's shares (in percent) of each positive's score."""
        there, (low, high) = self.best != -math.inf, self.window
        score = np.where(there, self.best, 0)
        self.low = np.where(there, -(-low * score // 100), math.inf)
        self.high = np.where(there, high * score // 100, -math.inf)

    def reach_negatives(self, label: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Anchors by boxes: whether a box can hold a row of another label in the open part of a window."""
        least, most = self.bounds(low, high)
        need = np.maximum(self.low, self.found[..., -1])
        out = np.zeros(most.shape, bool)
        for w in range(need.shape[1]):
            out |= (most >= need[:, w, None]) & (least <= self.high[:, w, None]) & (self.low[:, w] <= self.high[:, w])[:, None]
        return out & (self.labels != label)[:, None]

    def add_negatives(self, who: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = self.scores(who, ids, vectors)
        for w in range(self.low.shape[1]):
            need = np.maximum(self.low[who, w], self.found[who, w, -1])
            inside = (scores <= self.high[who, w, None]) & (scores >= need[:, None]) & (scores != -math.inf)
            some = inside.any(1)
            if some.any():
                rows = who[some]
                own = np.where(inside[some], scores[some], -math.inf)
                self.found[rows, w], self.found_ids[rows, w] = self.keep(own, ids, self.found[rows, w], self.found_ids[rows, w])

    def look(self, segments: Segments, reach, add) -> None:
        """Reads the blocks that ``reach``, those of the most promising segments first."""
        def visit(segment: tuple) -> None:
            who = None

            def wanted(low: np.ndarray, high: np.ndarray) -> bool:
                nonlocal who
                who = np.flatnonzero(reach(segment[1], low, high)[:, 0])
                return len(who) > 0

            for ids, vectors in segments.visit(segment, self.dims, wanted):
                add(who, ids, vectors)

        def promising() -> Iterator[tuple]:
            for part in segments.batches(self.dims):
                low, high = (np.array([s[k] for s in part]).reshape(len(part), self.dims) for k in (4, 5))
                most = self.bounds(low, high)[1]
                for i, segment in enumerate(part):
                    if reach(segment[1], low[i: i + 1], high[i: i + 1]).any():
                        yield most[:, i].max(), segment[0], segment[2], segment

        first = nlargest(FIRST, promising(), key=lambda x: x[:3])
        for *_, segment in first:
            visit(segment)
        done = {x[1:3] for x in first}
        for *_, path, at, segment in promising():
            if (path, at) not in done:
                visit(segment)

    def rows(self) -> pa.RecordBatch:
        anchor, w, rank = np.nonzero(self.found != -math.inf)
        longs = [np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in x.tolist()], np.int64)
                 for x in (self.best[anchor, w], self.found[anchor, w, rank])]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[anchor]), pa.array(self.best_ids[anchor, w]), pa.array(rank.astype(np.int32) + 1),
             pa.array(self.found_ids[anchor, w, rank]), *map(pa.array, longs)],
            ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def search(anchors: Block, segments: Segments, exact: type, positives: int, negatives: int, window: tuple[int, int]) -> pa.RecordBatch:
    """All rows of a tile of anchors."""
    tile = Tile(anchors, exact, positives, negatives, window)
    tile.look(segments, tile.reach_positives, tile.add_positives)
    tile.open_windows()
    tile.look(segments, tile.reach_negatives, tile.add_negatives)
    return tile.rows()


def hard_negatives(vectors: DataFrame, every: int, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """For each row whose vec_id is divisible by ``every`` and each of its ``positives`` best rows of the same label: the first
    ``negatives`` rows of other labels with a score from ``window[0]`` to ``window[1]`` percent of the positive's.

    ``vectors(vec_id, label, embedding)``; returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    rows = keyed(vectors)
    manifest = write_blocks(rows, scratch_path(spark, "vector-blocks"))
    largest = rows.groupBy("dims").agg(F.max(F.greatest(F.abs(F.array_min("vec")), F.abs(F.array_max("vec")))).alias("most")).collect()
    # Products of 100 and a score have to be exact.
    kind = {r.dims: float if (r.most or 0.0) < math.sqrt(2.0 ** 53 / (100 * max(r.dims, 1))) else object for r in largest}
    anchors = rows.filter(F.col("vec_id") % every == 0)
    tasks = 2 * spark.sparkContext.defaultParallelism
    most = min(MOST_IN_TILE, max(1, math.ceil(anchors.count() / tasks)))
    n_tiles = max(1, math.ceil(anchors.count() / most))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(manifest)
        for tile in runs(batches, MOST_IN_TILE, ["dims"]):
            yield search(tile, segments, kind[tile.dims], positives, negatives, window)

    return anchors.repartitionByRange(n_tiles, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(tiles, FOUND)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 50; those divisible by 7 first get the next of ten labels."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")), 50)


ORACLE = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
        coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])), 0)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
