"""Removal of bytes in strings of 400 bytes that occur more than once, by merged suffix orders.

1. Each text is cut into runs of windows (400-byte strings) that share the smallest hash of their 64-byte pieces. Equal
   windows have the same smallest hash, so whatever repeats meets under one hash, wherever it stands.
   Runs are rows of hashes and positions, not of bytes.
2. A run whose bytes occur more than once is repeated as a whole. A hash under which only one run's
   bytes occur has no other repeats. What remains, one run for each distinct content, is fetched as
   bytes and dealt into buckets by its hash. A hash whose runs are longer than a bucket altogether (a line
   in many surroundings) is dealt again by the windows themselves: their hashes are counted by a
   shuffle that adds up before it sends, so no task holds what is under one hash.
3. In a bucket, suffixes are read in symbols of ``STRIDE`` bytes, so that 400 bytes are eight symbols and
   a string is ``STRIDE`` interleaved sequences. Shards of the bucket are sorted on their own and give
   their Burrows-Wheeler transforms. The transforms are merged by refining their interleaving: each
   round deals the rows stably by the symbol before them, which orders them by one symbol more; rows
   that were together and have the same symbol stay together. After eight rounds, rows that are
   together have a common prefix of 400 bytes: the repeated intervals. Suffixes are never sorted anew.
4. Repeated windows go back to all places of their run's bytes, and are united per text.

The same goes for passages of a number of words: units are then words (runs without ASCII blanks, compared as
bytes and known by 64-bit hashes) instead of bytes, and lengths and places count words.

Strings are compared as 64-bit (words, pieces) and 128-bit (runs, texts, counted windows) hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.llm.common import ending, mix, ship, sliced, stored, table, text_bytes
from veritab.llm.words import hashes, lookup, spans as word_spans

LENGTH, GRAM, STRIDE = 400, 64, 50
BUCKET_BYTES, SHARD_BYTES = 1 << 20, 1 << 18
RUNS = "doc_id long, t1 long, t2 long, off long, n long, m long, c1 long, c2 long, own boolean"
FOUND = "m long, c1 long, c2 long, spans array<struct<at:long,n:long>>"
COUNTED = "m long, c1 long, c2 long, at long, w1 long, w2 long"
#: Windows of one batch of counted windows.
BATCH_WINDOWS = 1 << 16
BYTE = np.random.default_rng(7).integers(1, 2**64, 256, np.uint64, endpoint=False)
BYTE_2 = np.random.default_rng(9).integers(1, 2**64, 256, np.uint64, endpoint=False)
STEP = np.random.default_rng(8).integers(1, 2**64, 64, np.uint64, endpoint=False) | np.uint64(1)
BLANK = lookup(9, 10, 11, 12, 13, 32)


class Unit(NamedTuple):
    """What lengths and places count: bytes, or words as 8-byte hashes. Lengths are multiples of ``stride``."""

    gram: int
    stride: int
    kind: type


BYTES, WORDS = Unit(GRAM, STRIDE, np.uint8), Unit(8, 17, np.uint64)


def halves(digests: list[bytes]) -> np.ndarray:
    """128-bit numbers in 16 bytes each as two signed 64-bit ones, the lower first."""
    return np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2)[:, ::-1].astype(np.int64)


def units_of(data: np.ndarray, starts: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """The units of texts, and where in them each text begins (with the end)."""
    if unit.kind is np.uint8:
        return data, starts
    blank = BLANK[data]
    begin, stop = word_spans(blank, starts)
    return hashes(data, blank, begin, stop), np.searchsorted(begin, starts)


def gram_hashes(data: np.ndarray, length: int, values: np.ndarray = BYTE) -> np.ndarray:
    """A hash of the ``length`` units from each position on, put together from powers of two."""
    power, out, done, size = values[data] if data.dtype == np.uint8 else mix(data ^ values[0]), None, 0, 1
    for k in range(length.bit_length()):
        if length >> k & 1:
            out = power if out is None else out[: len(power) - done] * STEP[32 + k] + power[done:] if len(power) > done else power[:0]
            done += size
        if length >> (k + 1):
            power = power[:-size] * STEP[k] + power[size:] if len(power) > size else power[:0]
            size *= 2
    return mix(out[: max(len(data) - length + 1, 0)])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def runs_of(texts: pa.Array, doc_ids: pa.Array, length: int = LENGTH, unit: Unit = BYTES) -> pa.RecordBatch:
    """Runs of windows under one smallest hash; ``own`` if a run could repeat within itself."""
    data, at = text_bytes(texts)
    raw = data.tobytes()
    data, starts = units_of(data, at, unit)
    gram = gram_hashes(data, unit.gram)
    least = sliding_least(gram, length - unit.gram + 1)
    size = np.diff(starts)
    inside = np.zeros(len(least) + 1, np.int8)
    long = size >= length
    inside[starts[:-1][long]] += 1
    inside[(starts[1:][long] - length + 1)] -= 1
    valid = np.cumsum(inside[:-1]) > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    border = starts[1:-1][starts[1:-1] < len(first)]
    first[border] = valid[border]
    begin = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | first[1:]
    n = np.flatnonzero(last) + 1 - begin
    doc = np.searchsorted(starts, begin, "right") - 1
    content, own = [], []
    for b, k, m in zip(begin.tolist(), n.tolist(), least[begin], strict=True):
        content.append(xxhash.xxh3_128_digest(data[b: b + k - 1 + length].tobytes()))
        own.append(np.count_nonzero(gram[b: b + k + length - unit.gram] == m) > 1)
    c = halves(content)
    text, each = np.unique(doc, return_inverse=True)
    t = halves([xxhash.xxh3_128_digest(raw[at[d]: at[d + 1]]) for d in text.tolist()])[each]
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(doc)), pa.array(t[:, 0]), pa.array(t[:, 1]), pa.array(begin - starts[doc]), pa.array(n),
         pa.array(least[begin].view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(own, pa.bool_())],
        ["doc_id", "t1", "t2", "off", "n", "m", "c1", "c2", "own"])


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of numbers from 0 on, and the numbers in that order; they are sorted with their places where both fit 63 bits."""
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()).bit_length() + bits > 63:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    packed = (keys.astype(np.int64) << bits) | np.arange(len(keys))
    packed.sort()
    return packed & ((1 << bits) - 1), packed >> bits


class Shard:
    """Suffixes of some strings in symbols of ``stride`` units, sorted by their first ``depth`` symbols.

    ``symbol[p]`` is that of the units from position p on, 0 (an end) where fewer than ``stride`` are left;
    every position of a string and the one behind it is a suffix. ``transform`` holds, in sorted order,
    the symbol before each suffix.
    """

    def __init__(self, symbol: np.ndarray, begins: np.ndarray, depth: int, stride: int = STRIDE):
        n = len(symbol)
        here = np.arange(n)
        after = here + stride
        after[symbol == 0] = n  # behind an end is nothing
        rank, jump, reach = np.append(symbol, 0), np.append(after, n), 1
        self.order = None if reach < depth else in_order(symbol)[0]
        while reach < depth:
            joint = rank * (int(rank.max()) + 1) + rank[jump]
            order, joint = in_order(joint[:n])
            reach *= 2
            if reach < depth:
                rank = np.zeros(n + 1, np.int64)  # behind all ends; a suffix of ends alone is 0 too
                rank[order] = np.cumsum(np.concatenate(([joint[:1].any()], joint[1:] != joint[:-1])))
                jump = jump[jump]
            self.order = order
        before = here - stride
        before[here < begins + stride] = -1
        self.transform = np.where(before < 0, 0, symbol[before])[self.order]


def merged(shards: list[Shard], depth: int) -> list[np.ndarray]:
    """For each shard and suffix, in its own order, a number shared by suffixes with equal first ``depth`` symbols."""
    size = [len(s.transform) for s in shards]
    whose = np.repeat(np.arange(len(shards), dtype=np.min_scalar_type(len(shards))), size)
    transform = np.concatenate([s.transform for s in shards])
    place, group, before = np.arange(len(whose)), np.zeros(len(whose), np.int64), np.empty(len(whose), np.int64)
    for _ in range(depth):
        before[place] = transform
        order, symbol = in_order(before)
        whose, old = whose[order], group[order]
        new = np.ones(len(whose), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | ((old[1:] != old[:-1]) & (symbol[1:] != 0))
        group = np.cumsum(new)
        place = np.argsort(whose, kind="stable")  # where each shard's suffixes lie, in its own order
    return np.split(group[place], np.cumsum(size)[:-1])


def stretches(data: np.ndarray, last: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Parts of strings (begin, end) that hold all windows which may occur more than once.

    Each half window in such a window occurs more than once. Halves are counted by some bits of their hash,
    which can only keep more; ``last[p]`` is the end of the string at p.
    """
    half = length // 2
    hashed = gram_hashes(data, half)
    whole = np.flatnonzero(np.arange(len(hashed)) + half <= last[: len(hashed)])
    bits = max(16, len(whole).bit_length())
    cell = (hashed[whole] >> np.uint64(64 - bits)).astype(np.int64)
    often = np.zeros(len(data) + 1, np.int8)
    often[whole] = np.bincount(cell)[cell] > 1 if len(cell) else 0
    edge = np.flatnonzero(np.diff(often, prepend=0))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a + half > length:
            yield a, b + half - 1


def repeated(strings: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD_BYTES, unit: Unit = BYTES) -> list[np.ndarray]:
    """For each string, which windows (by their first unit) occur anywhere else in the strings."""
    width = np.dtype(unit.kind).itemsize
    size = np.array([len(s) // width for s in strings], np.int64)
    starts = np.concatenate(([0], np.cumsum(size + 1)))
    data = np.frombuffer(bytes(width).join(strings) + bytes(width), unit.kind)
    parts = list(stretches(data, np.repeat(starts[:-1] + size, size + 1), length))
    found = np.zeros(len(data), bool)
    if parts:
        for (a, _), own in zip(parts, repeated_by_merging([data[a:b] for a, b in parts], length, shard_bytes, unit), strict=True):
            found[a: a + len(own)] = own
    return [found[a: a + max(n - length + 1, 0)] for a, n in zip(starts[:-1].tolist(), size.tolist(), strict=True)]


def repeated_by_merging(strings: list[np.ndarray], length: int, shard_bytes: int, unit: Unit) -> list[np.ndarray]:
    """As ``repeated``, for strings as arrays: shards are sorted on their own and their transforms merged."""
    depth, stride = length // unit.stride, unit.stride
    size = np.array([len(s) for s in strings], np.int64)
    starts = np.concatenate(([0], np.cumsum(size + 1)))
    data = np.zeros(starts[-1], unit.kind)
    which = np.repeat(np.arange(len(strings)), size + 1)
    left = starts[which] + size[which] - np.arange(len(data))  # units up to the string's end
    data[left > 0] = np.concatenate(strings)
    hashed, whole = gram_hashes(data, stride), left >= stride
    symbol = np.zeros(len(data), np.int64)
    symbol[whole] = np.unique(hashed[whole[: len(hashed)]], return_inverse=True)[1] + 1
    cuts, held = [0], 0
    for k, n in enumerate(size.tolist()):
        if held and held + n > shard_bytes:
            cuts.append(k)
            held = 0
        held += n
    cuts.append(len(strings))
    shards = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        i, j = starts[a], starts[b]
        shards.append(Shard(symbol[i:j], np.repeat(starts[a:b] - i, size[a:b] + 1), depth, stride))
    group = np.zeros(len(data), np.int64)
    for a, shard, own in zip(cuts[:-1], shards, merged(shards, depth), strict=True):
        group[starts[a] + shard.order] = own
    full = left >= length
    often = full & (np.bincount(group[full], minlength=int(group.max()) + 1)[group] > 1)
    return [often[a: a + max(n - length + 1, 0)] for a, n in zip(starts[:-1].tolist(), size.tolist(), strict=True)]


def window_hashes(batch: pa.RecordBatch, length: int = LENGTH, unit: Unit = BYTES) -> Iterator[pa.RecordBatch]:
    """A row for each window of the runs ``batch(m, c1, c2, bytes)``: where in its run it begins, and its hash."""
    data, starts = text_bytes(batch["bytes"])
    data, starts = data.copy().view(unit.kind), starts // np.dtype(unit.kind).itemsize
    for k, (i, j) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        for a in range(i, j - length + 1, BATCH_WINDOWS):
            piece = data[a: min(a + BATCH_WINDOWS - 1 + length, j)]
            w1, w2 = (gram_hashes(piece, length, values).view(np.int64) for values in (BYTE, BYTE_2))
            same = batch.slice(k, 1).select(["m", "c1", "c2"])
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(column[0], len(w1)) for column in same.columns] + [pa.array(np.arange(a - i, a - i + len(w1))), pa.array(w1), pa.array(w2)],
                ["m", "c1", "c2", "at", "w1", "w2"])


def counted_windows(hot: DataFrame, length: int = LENGTH, unit: Unit = BYTES) -> DataFrame:
    """What ``repeated`` finds, for runs ``hot(m, c1, c2, bytes)`` of any number under one m: rows as FOUND.

    A window occurs more than once if its hash is counted more than once; no group is held in one task.
    """
    content = ["m", "c1", "c2"]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 20):
            held, rows = [], 0
            for part in window_hashes(batch, length, unit):
                held.append(part)
                rows += len(part)
                if rows >= BATCH_WINDOWS:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, rows = [], 0
            if rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    each = hot.mapInArrow(windows, COUNTED)
    key = ["m", "w1", "w2"]
    often = each.groupBy(*key).count().filter("count > 1").select(*key)
    places = each.join(often.hint("merge"), key).groupBy(*content).agg(F.sort_array(F.collect_list("at")).alias("at"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
        for batch in sliced(batches, 1 << 20):
            spans = []
            for at in batch["at"]:
                at = at.values.to_numpy()
                parts = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
                spans.append([{"at": int(x[0]), "n": len(x)} for x in parts])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in content), pa.array(spans, kind)], [*content, "spans"])

    return places.mapInArrow(joined, FOUND)


def keyed_texts(docs: DataFrame, more: str | None = None) -> DataFrame:
    """doc_id, ``more``, the text compressed (``packed``) and t1, t2, the hash of the text."""
    passed = ["doc_id"] + ([more] if more else [])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in sliced(batches):
            data, at = text_bytes(batch["text"])
            raw = data.tobytes()
            texts = [raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            key = halves([xxhash.xxh3_128_digest(t) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in passed), pa.array([pack(t) for t in texts], pa.binary()), pa.array(key[:, 0]), pa.array(key[:, 1])],
                [*passed, "packed", "t1", "t2"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed]
    return docs.select(*passed, "text").mapInArrow(rows, ", ".join([*kinds, "packed binary", "t1 long", "t2 long"]))


def repeated_spans(docs: DataFrame, length: int = LENGTH, unit: Unit = BYTES) -> DataFrame:
    """t1, t2 (hash of a text) and its removable spans (at, n windows), not yet united."""
    content = ["m", "c1", "c2"]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 19):
            yield runs_of(batch["text"], batch["doc_id"], length, unit)

    runs = stored(docs.mapInArrow(first_pass, RUNS), "window-runs")
    contents = runs.groupBy(*content).agg(
        F.count("*").alias("places"), F.min(F.struct("doc_id", "t1", "t2", "off")).alias("pick"), F.max("n").alias("n"), F.max("own").alias("own"))
    contents = stored(contents, "window-contents")
    kinds = contents.groupBy("m").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + (length - 1)).alias("held"))
    # what may hold repeats that its own copies don't show
    most = max(1, BUCKET_BYTES // np.dtype(unit.kind).itemsize)
    open_ = stored(contents.join(kinds.filter("kinds > 1"), "m", "left").filter("kinds > 1 or own").select(
        *content, "n", "pick.doc_id", "pick.t1", "pick.t2", "pick.off", F.expr(f"coalesce(held, n + {length - 1}) > {most}").alias("hot")), "open-contents")
    total, any_hot = open_.agg(F.sum(F.expr(f"if(hot, 0, n + {length})")), F.max("hot")).first()
    total = total or 0
    buckets = max(1, -(-2 * int(total) // most))  # half full on the average, so that few hold more than `most`

    asked = open_.groupBy("doc_id", "t1", "t2").agg(F.collect_list(F.struct(*content, "off", "n", "hot")).alias("parts"))
    own = keyed_texts(docs)
    match = own.doc_id.eqNullSafe(asked.doc_id) & (own.t1 == asked.t1) & (own.t2 == asked.t2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in sliced(batches, 1 << 20):
            rows = []
            for packed, parts in zip(batch["packed"].to_pylist(), batch["parts"].to_pylist(), strict=True):
                text = np.frombuffer(unpack(packed), np.uint8)
                text, _ = units_of(text, np.array([0, len(text)]), unit)
                rows += [(p["m"], p["c1"], p["c2"], p["hot"], text[p["off"]: p["off"] + p["n"] - 1 + length].tobytes()) for p in parts]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["m", "c1", "c2", "hot", "bytes"])

    # Texts travel compressed and are joined by shuffle at any size.
    cuts = own.join(asked.hint("merge"), match).select(own.packed, asked.parts).mapInArrow(cut, "m long, c1 long, c2 long, hot boolean, bytes binary")
    if any_hot:
        cuts = stored(cuts, "open-runs")

    def search(bucket: list[tuple]) -> pa.RecordBatch | None:
        bucket = list({row[:3]: row for row in bucket}.values())
        rows = []
        for (m, c1, c2, _), found in zip(bucket, repeated([row[3] for row in bucket], length, unit=unit), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], found.astype(np.int8), [0]))))
            if len(edge):
                rows.append((m, c1, c2, [{"at": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]))
        if not rows:
            return None
        kind = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
        *keys, spans = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k) for k in keys] + [pa.array(spans, kind)], ["m", "c1", "c2", "spans"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by bucket; one bucket is held at a time."""
        at, held = None, []
        for batch in ending(batches):
            for bucket, *row in zip(*(batch[c].to_pylist() for c in ("bucket", "m", "c1", "c2", "bytes")), strict=True):
                if bucket != at:
                    if held and (out := search(held)):
                        yield out
                    at, held = bucket, []
                held.append(tuple(row))
        if held and (out := search(held)):
            yield out

    dealt = cuts.filter("not hot").select(*content, "bytes", F.pmod(F.xxhash64("m"), F.lit(buckets)).cast("int").alias("bucket")).repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(searched, FOUND)
    if any_hot:
        # a content is fetched once for each place of equal doc_id, text and offset
        found = found.unionByName(counted_windows(cuts.filter("hot").select(*content, "bytes").dropDuplicates(content), length, unit))
    partly = stored(found, "repeated-windows")
    whole = contents.filter("places > 1").select(*content, F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("n").alias("n"))).alias("spans"))
    spans = whole.unionByName(partly.join(whole.select(*content), content, "left_anti"))
    places = runs.select("t1", "t2", "off", *content).distinct()
    return places.join(spans, content).select("t1", "t2", F.inline(F.transform("spans", lambda s: F.struct((F.col("off") + s["at"]).alias("at"), s["n"].alias("n")))))


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (begin, end) of those that meet."""
    out: list[tuple[int, int]] = []
    for run in sorted(runs):
        if out and run[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], run[1]))
        else:
            out.append(run)
    return out


def removed(data: bytes, spans: list[dict] | None, length: int, words: int) -> list[tuple[int, int]]:
    """Maximal removed runs (begin, end) of a text, in bytes: of words from the first's begin to the last's end."""
    runs = [(s["at"], s["at"] + s["n"] - 1 + length) for s in spans or () if not s["words"]]
    passages = [(s["at"], s["at"] + s["n"] - 1 + words) for s in spans or () if s["words"]]
    if passages:
        text = np.frombuffer(data, np.uint8)
        begin, stop = word_spans(BLANK[text], np.array([0, len(text)]))
        runs += [(int(begin[a]), int(stop[b - 1])) for a, b in passages]
    return united(runs)


def without_repeats(docs: DataFrame, make, schema: str, more: list[str] | None = None, length: int = LENGTH, words: int = 0) -> DataFrame:
    """Rows of ``make(batch, kept)``: batch has doc_id and ``rest``, a struct of the columns ``more``;
    kept has (size, removed runs, what is left) of each text, as bytes. ``words``: passages of so many
    words that occur elsewhere go too, whatever blanks are between the words."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.struct(*(more or [F.lit(None).cast("string").alias("none")])).alias("rest"))
    # Stored, so that what finds them has left the disk when the texts are shuffled.
    spans = stored(repeated_spans(docs.select("doc_id", "text"), length), "repeated-spans").withColumn("words", F.lit(False))
    if words:
        spans = spans.unionByName(stored(repeated_spans(docs.select("doc_id", "text"), words, WORDS), "repeated-spans").withColumn("words", F.lit(True)))
    spans = spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("at", "n", "words")).alias("spans"))
    joined = keyed_texts(docs, "rest").join(spans.hint("merge"), ["t1", "t2"], "left").select("doc_id", "packed", "rest", "spans")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in sliced(batches, 1 << 20):
            kept = []
            for packed, found in zip(batch["packed"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                data = unpack(packed)
                cuts = removed(data, found, length, words)
                ends = [0, *[x for cut in cuts for x in cut], len(data)]
                kept.append((len(data), cuts, b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))))
            yield make(batch, kept)

    return joined.mapInArrow(rows, schema)


def digests(batch: pa.RecordBatch, kept: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        batch["doc_id"], pa.array([n for n, _, _ in kept], pa.int64()),
        pa.array([sum(b - a for a, b in cuts) for _, cuts, _ in kept], pa.int64()),
        pa.array([len(cuts) for _, cuts, _ in kept], pa.int64()),
        pa.array([hashlib.sha256(rest).hexdigest() for _, _, rest in kept], pa.string())],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs(doc_id, text)``.

    Texts are UTF-8 bytes, null is empty. A byte is removed if a string of ``length`` bytes over it
    starts anywhere else, in the same text or another row's (repeated rows are each other's copies);
    strings are judged on the input. Rows with equal or null doc_id stay rows of their own; other
    columns are ignored; an empty table gives no rows. ``length`` is a multiple of STRIDE.
    """
    return without_repeats(docs, digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length=length)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats in all documents, removed."""
    return removal_digest(table(spark, sf_dir, "documents"))
