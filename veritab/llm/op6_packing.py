"""Packing of token sequences over several context sizes.

Each task packs the documents of its partition, ``HELD_IDS`` ids at a time, so memory is bounded and
nothing is shuffled; what a chunk leaves over goes on to the next.

1. Whole windows of 4096 ids are cut off a document; the rest is routed to the smallest tier
   (4096, 2048, 1024, 512) that holds it.
2. Tiers are packed from long to short. A window begins with the longest rest of its tier; its gap
   is filled with the longest shorter rest that fits, and when none fits, with a part cut off the
   shortest rest there is. So a window of a tier is full, and no padding is needed.
3. What remains at a partition's end is less than one window: it is laid out in sequences whose
   lengths are powers of two (``pad_tail=False``) or padded as one.
4. Windows of a tier are dealt into step groups of ``STEP_IDS`` ids; dealing them forth and back by
   their attention cost (sum of squared piece lengths) balances the groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.llm.common import END_ID, ship, sliced, table, tokenizer_path
from veritab.llm.encoding import encoder

TIERS = (4096, 2048, 1024, 512)
HELD_IDS = 4_000_000
STEP_IDS = 1 << 16
#: Text encoded at once; arrays of words take some 50 times as much.
SLICE_BYTES = 1 << 20
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "padded long, tier int, step_group long")
NAMES = [c.split()[0] for c in PIECES.split(", ")]


class Rests:
    """Pieces by length, with the nearest filled length found in one integer's bits."""

    def __init__(self):
        self.by_length: dict[int, list] = {}
        self.filled = 0

    def put(self, length: int, piece: tuple) -> None:
        self.by_length.setdefault(length, []).append(piece)
        self.filled |= 1 << length

    def take(self, length: int) -> tuple:
        held = self.by_length[length]
        piece = held.pop()
        if not held:
            self.filled &= ~(1 << length)
        return piece

    def longest(self, most: int) -> int:
        """The longest length up to ``most``, or 0."""
        return max(0, (self.filled & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def shortest_above(self, length: int) -> int:
        above = self.filled >> (length + 1)
        return (above & -above).bit_length() + length if above else 0


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list]], list]:
    """Windows (tier, [(document, start, length)...]) and the pieces of the last, unfilled one."""
    top, rests, windows = tiers[0], Rests(), []
    for doc, size in enumerate(sizes):
        whole = size // top
        windows += [(top, [(doc, k * top, top)]) for k in range(whole)]
        if size % top:
            rests.put(size % top, (doc, whole * top))
    for tier in tiers:
        floor = tier // 2 if tier != tiers[-1] else 0
        while (length := rests.longest(tier)) > floor:
            window, gap = [(*rests.take(length), length)], tier - length
            while gap and rests.filled:
                if length := rests.longest(gap):
                    window.append((*rests.take(length), length))
                    gap -= length
                else:
                    length = rests.shortest_above(gap)
                    doc, start = rests.take(length)
                    window.append((doc, start, gap))
                    rests.put(length - gap, (doc, start + gap))
                    gap = 0
            if gap:
                return windows, window
            windows.append((tier, window))
    return windows, []


def ladder(pieces: list, padded: bool) -> list[list]:
    """The last pieces as one sequence, or as sequences of falling powers of two."""
    total = sum(length for *_, length in pieces)
    if padded or not total:
        return [pieces] if pieces else []
    out, room = [], 0
    for doc, start, length in pieces:
        while length:
            if not room:
                room = 1 << (total.bit_length() - 1)
                total -= room
                out.append([])
            part = min(room, length)
            out[-1].append((doc, start, part))
            start, length, room = start + part, length - part, room - part
    return out


def step_groups(windows: list[tuple[int, list]], first: int) -> tuple[list[int], int]:
    """A step group for each window; groups of a tier hold STEP_IDS ids and near-equal attention cost."""
    out, by_tier = [0] * len(windows), {}
    for k, (tier, _) in enumerate(windows):
        by_tier.setdefault(tier, []).append(k)
    for tier, own in sorted(by_tier.items(), reverse=True):
        own.sort(key=lambda k: (-sum(length * length for *_, length in windows[k][1]), k))
        groups = -(-len(own) * tier // STEP_IDS)
        for place, k in enumerate(own):
            turn, at = divmod(place, groups)
            out[k] = first + (at if turn % 2 == 0 else groups - 1 - at)
        first += groups
    return out, first


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, by_word: bool = True,
                   pad_tail: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: where each part of a document's ids lies in which sequence.

    Null texts are empty documents of the end id alone; rows with equal or null doc_id are documents
    of their own; other columns are ignored; an empty table gives no rows. ``padded`` is the
    sequence's length with padding.
    """
    ship(docs.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, count, group = TaskContext.get().partitionId() << 40, 0, 0
        held, encode = [], encoder(tokenizer, by_word)  # held: (doc_id, ids, ids before, tokens of the document)

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal held, count, group
            windows, rest = pack([len(x[1]) for x in held])
            groups, group = step_groups(windows, group)
            if last:
                tail = ladder(rest, pad_tail)
                windows, groups = windows + [(TIERS[-1], w) for w in tail], groups + [group] * len(tail)
                group, rest = group + 1, []
            columns = [[] for _ in NAMES]
            for (tier, window), step in zip(windows, groups, strict=True):
                offset, used = 0, sum(length for *_, length in window)
                padded = used if used & (used - 1) == 0 else TIERS[0]
                for doc, start, length in window:
                    doc_id, ids, before, tokens = held[doc]
                    row = (doc_id, before + start, length, zlib.crc32(ids[start: start + length]), tokens,
                           prefix | count, offset, padded, tier, prefix | step)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += length
                count += 1
            held = [(held[d][0], held[d][1][s: s + n], held[d][2] + s, held[d][3]) for d, s, n in rest]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if name == "tier" else pa.int64()) for name, c in zip(NAMES, columns, strict=True)], NAMES)

        size = 0
        for batch in sliced(batches, SLICE_BYTES, remember=True):
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"], end_id), strict=True):
                held.append((doc_id, ids, 0, len(ids)))
                size += len(ids)
            if size >= HELD_IDS:
                yield emit(False)
                size = 0
        if held:
            yield emit(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(packed, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
