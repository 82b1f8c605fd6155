"""Tokens of two tokenizers over the same bytes: groups, links and how often ids are linked.

Both encode a text with one space in front (A gets it, B adds it). Tokens are intervals of bytes. All
intervals of both sides are sorted by start; a group begins where a start reaches the running maximum of
the ends, and within groups each A token is linked with the B tokens whose bytes it shares. That is done
for some megabytes of texts (a slice) at once, with numpy.

1. ``tokenized`` encodes and stores. Texts are runs of units, a unit being spaces and what follows up to
   the next one: neither tokenizer joins bytes across a space behind other text (checked against B's
   vocabulary; A's pattern never does), so groups and links stay inside units. Each different unit of a
   slice is encoded and aligned once, and a text is a list of their numbers.
2. ``slice_pairs`` counts linked id pairs within each slice, so that the commonest pair of the corpus is a
   row a slice, and ``pair_counts`` adds them up over the corpus.
3. ``aligned`` gives each slice the counts of its own pairs, by a shuffle on the pair and one on the
   slice, and sums them up per document.

Null or empty texts, and texts whose joined token bytes aren't the bytes of the space and the text, have no
tokens and counts of 0. Units are known by 64-bit hashes within a slice. Repeated rows are documents of their own and count each; a null doc_id stays; other
columns are ignored; an empty table gives no rows. A slice holds one text at least, whatever its length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.llm.common import ending, ship, sliced, stored, table, text_bytes, tokenizer_path
from veritab.llm.encoding import byte_letters
from veritab.llm.words import hashes

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of a slice, and of units encoded in one call.
SLICE, RUN = 4 << 20, 1 << 14
# Fixed values of byte-level pair encoding: how texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
SLICES = "slice long, doc_ids array<long>, n binary, units binary, a binary, a_n binary, b binary, b_n binary"
PAIRS = "slice long, a int, b int, n long"
RESULT = """doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"""
GROUPS = "doc_id long, groups array<struct<start: long, stop: long, a: array<int>, b: array<int>>>"


def unit_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin: at texts, and at spaces behind a character that is no white space."""
    back = [np.concatenate((np.zeros(k, np.uint8), data[:-k])) for k in (1, 2, 3)]
    one, two, three = back
    # White space beyond ASCII, by its last bytes.
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    wide |= (three == 0xE1) & (((two == 0x9A) & (one == 0x80)) | ((two == 0xA0) & (one == 0x8E)))
    wide |= (three == 0xE2) & (((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))) | ((two == 0x81) & (one == 0x9F)))
    wide |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
    begins = (data == 0x20) & (one > 0x20) & ~wide
    begins[starts] = True
    return np.flatnonzero(begins)


class Units(NamedTuple):
    """Texts as numbers of units, and the ids of the units: of A and how many each unit has, and of B."""

    n: np.ndarray
    units: np.ndarray
    a: np.ndarray
    a_n: np.ndarray
    b: np.ndarray
    b_n: np.ndarray

    def packed(self) -> list[bytes]:
        pack = zstandard.ZstdCompressor(level=3).compress
        return [pack(x.astype("<u4").tobytes()) for x in self]

    def edges(self) -> np.ndarray:
        """Units before each text, and after the last."""
        return np.concatenate(([0], np.cumsum(self.n, dtype=np.int64)))


def unpacked(row: dict) -> Units:
    unpack = zstandard.ZstdDecompressor().decompress
    return Units(*(np.frombuffer(unpack(row[c]), "<u4") for c in Units._fields))


class Tokenizers:
    """Both tokenizers and the bytes of their entries.

    Where A's merges are listed in the order of their ids and its texts are cut by the common pattern,
    tiktoken applies them, which gives the same ids sooner; else the tokenizers library does.
    """

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(a_path)
        whole.encode_special_tokens = True
        letters = {c: b for b, c in byte_letters().items()}
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in whole.get_vocab().items()}
        ranked = self._ranked(a_path)
        self.a = ranked.encode_ordinary if ranked else lambda text: whole.encode(text, add_special_tokens=False).ids
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces}
        self.by_unit = not any("▁" in p.lstrip("▁") for _, p in pieces)
        self.sizes = [np.array([len(of.get(i, b"")) for i in range(max(of) + 1)], np.int64) for of in (self.a_bytes, self.b_bytes)]

    def _ranked(self, a_path: str):
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            told = json.load(file)
        special = {t["id"] for t in told["added_tokens"]}
        vocab, merges = told["model"]["vocab"], told["model"]["merges"]
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        in_order = [vocab.get(t) for t in made] == list(range(256, 256 + len(made)))
        plain = told["normalizer"] is None and told["pre_tokenizer"] == PRE_TOKENIZER and len(vocab) - len(special & set(vocab.values())) == 256 + len(made)
        if not (in_order and plain):
            return None
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={self.a_bytes[i]: i for i in vocab.values() if i not in special}, special_tokens={})

    def parts(self, raw: list[bytes]) -> Iterator[tuple[list[int], list[int]] | None]:
        """Ids of both sides for runs of units (with their space in front), or None where bytes differ."""
        texts = [r.decode() for r in raw]
        for own, text, y in zip(raw, texts, self.b.encode([t[1:] for t in texts], num_threads=1), strict=True):
            x, y = self.a(text), y or [self.b.piece_to_id("▁")]  # none: a space alone
            same = b"".join(map(self.a_bytes.__getitem__, x)) == own == b"".join(map(self.b_bytes.__getitem__, y))
            yield (x, y) if same else None

    def learned(self, raw: bytes, stop: np.ndarray, alone: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of units that end at ``stop`` in ``raw``: for each side all ids and how many each unit has; and units whose bytes differ.

        Units are encoded in runs. Where a run's bytes differ it is halved, down to the unit. ``alone``: units at the end
        of a text that end with white space, which would run into the next one.
        """
        n = len(stop)
        edge = np.concatenate(([0], stop))
        new = alone.copy()
        new[1:] |= alone[:-1] | (np.diff(stop // RUN) > 0)
        new[:1] = True
        cut = [*np.flatnonzero(new).tolist(), n]
        todo, done, bad = list(zip(cut[:-1], cut[1:], strict=True)), {}, np.zeros(n, bool)
        while todo:
            halves = []
            for (i, j), got in zip(todo, self.parts([raw[edge[i]: edge[j]] for i, j in todo]), strict=True):
                if got is None and j - i > 1:
                    halves += [(i, (i + j) // 2), ((i + j) // 2, j)]
                elif got is None:
                    bad[i] = True
                else:
                    done[i] = (j, *(np.array(ids, np.uint32) for ids in got))
            todo = halves
        pools, counts = [], []
        for side in (1, 2):
            count = np.zeros(n, np.int64)
            for i, got in done.items():
                ends = np.cumsum(self.sizes[side - 1][got[side]]) + edge[i]
                count[i: got[0]] = np.diff(np.searchsorted(ends, edge[i: got[0] + 1], "right"))
            pools.append(np.concatenate([done[i][side] for i in sorted(done)] or [np.zeros(0, np.uint32)]))
            counts.append(count)
        return pools, counts, bad

    def __call__(self, column: pa.Array) -> Units:
        """The units of texts and their ids; texts without tokens have no units."""
        column = column.cast(pa.large_string())
        whole = pc.fill_null(pc.greater(pc.binary_length(column), 0), False).to_numpy(zero_copy_only=False)
        if not whole.any():
            nothing = np.zeros(0, np.uint32)
            return Units(np.zeros(len(column), np.uint32), nothing, nothing, nothing, nothing, nothing)
        empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        data, starts = text_bytes(pc.binary_join_element_wise(empty, column.filter(pa.array(whole)), space))
        begin = unit_starts(data, starts[:-1]) if self.by_unit else starts[:-1]
        stop = np.append(begin[1:], len(data))
        _, first, each = np.unique(hashes(data, np.zeros(len(data), bool), begin, stop), return_index=True, return_inverse=True)
        size = stop[first] - begin[first]
        ends = np.cumsum(size)
        raw = data[np.repeat(begin[first] - (ends - size), size) + np.arange(ends[-1])].tobytes()
        # The byte behind a last unit is another text's; a letter or mark of ASCII surely is no white space.
        last = np.isin(stop[first], starts) & ~((data[stop[first] - 1] > 0x20) & (data[stop[first] - 1] < 0x7F))
        (a, b), (a_n, b_n), bad = self.learned(raw, ends, last if self.by_unit else np.ones(len(first), bool))
        upto = np.searchsorted(begin, starts)
        good = np.diff(np.concatenate(([0], np.cumsum(bad[each])))[upto]) == 0
        n = np.zeros(len(column), np.uint32)
        n[whole] = np.where(good, np.diff(upto), 0)
        return Units(n, each[np.repeat(good, np.diff(upto))].astype(np.uint32), a, a_n.astype(np.uint32), b, b_n.astype(np.uint32))


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One pair per worker process."""
    return Tokenizers(a_path, b_path)


class Alignment:
    """Groups and links of the tokens of units, one unit behind the other. ``group`` has the group of each token of a side."""

    def __init__(self, of: Units, sizes: list[np.ndarray]):
        self.ids = [x.astype(np.int64) for x in (of.a, of.b)]
        #: Tokens before each unit, and after the last, by side.
        self.upto = [np.concatenate(([0], np.cumsum(n, dtype=np.int64))) for n in (of.a_n, of.b_n)]
        width = [s[i] for s, i in zip(sizes, self.ids, strict=True)]
        self.end = [np.cumsum(w) for w in width]
        self.start = [e - w for e, w in zip(self.end, width, strict=True)]
        n = len(self.ids[0])
        start, end = np.concatenate(self.start), np.concatenate(self.end)
        order = np.lexsort((start,))  # A before B where both start
        reach = np.maximum.accumulate(end[order])
        begins = np.ones(len(order), bool)
        begins[1:] = start[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(begins) - 1
        self.group = [group[:n], group[n:]]
        self.n_groups = int(begins.sum())

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A token and B token of each link, and the number of links before each A token (with the end)."""
        low = np.searchsorted(self.end[1], self.start[0], "right")
        n = np.searchsorted(self.start[1], self.end[0], "left") - low
        upto = np.concatenate(([0], np.cumsum(n)))
        return np.repeat(np.arange(len(n)), n), np.repeat(low - upto[:-1], n) + np.arange(upto[-1]), upto

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.ids[0][a] << 32 | self.ids[1][b]

    def groups_of_units(self) -> np.ndarray:
        """Groups before each unit, and after the last."""
        return np.append(self.group[0], self.n_groups)[self.upto[0]]

    def written(self) -> list[bytes]:
        """Each unit's groups as ``a1,a2|b1;a3|b2,b3;``."""
        first = [np.searchsorted(g, np.arange(self.n_groups + 1)) for g in self.group]
        place = [np.arange(len(g)) + first[1 - side][g + side] for side, g in enumerate(self.group)]
        last = [np.append(g[1:] != g[:-1], True)[: len(g)] for g in self.group]
        total = sum(map(len, place))
        ids, mark = np.empty(total, np.int32), np.empty(total, np.uint8)
        for side, code in ((0, b"|"), (1, b";")):
            ids[place[side]] = self.ids[side]
            mark[place[side]] = np.where(last[side], code[0], b","[0])
        known = np.arange(int(ids.max()) + 1 if total else 1)
        digits = max(1, len(str(known[-1])))
        width = np.searchsorted(10 ** np.arange(1, digits), known, "right") + 1
        # Each id's digits from the left, and room for the mark behind them.
        spelled = np.zeros((len(known), digits + 1), np.uint8)
        for k in range(digits):
            spelled[:, k] = 48 + known // 10 ** np.maximum(width - 1 - k, 0) % 10
        out, width = spelled[ids], width[ids]
        out[np.arange(total), width] = mark
        out = out[np.arange(digits + 1) <= width[:, None]]
        after = np.cumsum(width + 1)
        edge = np.concatenate(([0], after))[self.upto[0] + self.upto[1]]
        raw = out.tobytes()
        return [raw[x:y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def tokenized(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row a slice: its doc_ids in order, and its Units, each array compressed; stored."""
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, at = tokenizers(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in sliced(batches, SLICE):
            if len(batch):
                ids = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch["doc_id"])
                yield pa.RecordBatch.from_arrays([pa.array([at]), ids, *(pa.array([x], pa.binary()) for x in both(batch["text"]).packed())],
                                                 ["slice", "doc_ids", *Units._fields])
                at += 1

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(own.mapInArrow(encode, SLICES), "aligned-slices")


def slice_pairs(slices: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """How many links each slice has of each id pair, stored."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = tokenizers(a_path, b_path).sizes
        for batch in ending(batches):
            for row in batch.to_pylist():
                units = unpacked(row)
                both = Alignment(units, sizes)
                a, b, upto = both.links()
                keys, which = np.unique(both.keys(a, b), return_inverse=True)
                times = np.bincount(units.units, minlength=len(units.a_n))  # of each unit in the slice's texts
                n = np.bincount(which, np.repeat(times, np.diff(upto[both.upto[0]])), len(keys)).astype(np.int64)
                some = n > 0
                keys = keys[some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), row["slice"])), pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)),
                     pa.array(n[some])], ["slice", "a", "b", "n"])

    return stored(slices.mapInArrow(count, PAIRS), "slice-pairs")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, n: links of each id pair in the corpus; top: whether no other pair of the B id has more."""
    n = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return n.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("top"))


def groups(slices: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each document's groups: bytes of the space and the text, and the ids of both sides."""
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = tokenizers(a_path, b_path).sizes
        for batch in ending(batches):
            for row in batch.to_pylist():
                units = unpacked(row)
                both, seq, edges = Alignment(units, sizes), units.units.astype(np.int64), units.edges()
                at = both.groups_of_units()
                first = [np.searchsorted(g, np.arange(both.n_groups + 1)) for g in both.group]
                begin = both.start[0][first[0][:-1]]
                lists = [pa.ListArray.from_arrays(pa.array(f, pa.int32()), pa.array(i, pa.int32())) for f, i in zip(first, both.ids, strict=True)]
                # Groups of units in the order of the texts, and where each unit begins in its text.
                n = np.diff(at)[seq]
                upto = np.concatenate(([0], np.cumsum(n)))
                which = np.repeat(at[seq] - upto[:-1], n) + np.arange(upto[-1])
                size = np.concatenate(([0], np.cumsum(np.add.reduceat(sizes[0][both.ids[0]], both.upto[0][:-1])[seq] if len(seq) else seq)))
                origin = size[:-1] - np.repeat(size[edges[:-1]], np.diff(edges))
                shift = np.repeat(origin - begin[at[seq]] if len(seq) else origin, n)
                stop = both.end[0][first[0][1:] - 1]
                each = pa.StructArray.from_arrays([pa.array(begin[which] + shift), pa.array(stop[which] + shift), *(x.take(pa.array(which)) for x in lists)],
                                                  ["start", "stop", "a", "b"])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(upto[edges], pa.int32()), each)],
                                                 ["doc_id", "groups"])

    return slices.mapInArrow(spell, GROUPS)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links that are their B id's best, and the sum of the links' counts."""
    slices = tokenized(docs, a_path, b_path)
    pairs = slice_pairs(slices, a_path, b_path)
    counts = stored(pair_counts(pairs), "pair-counts")
    own = pairs.select("slice", "a", "b").join(counts, ["a", "b"]).select("slice", "a", "b", "n", "top")
    names = [f.split()[0] for f in RESULT.split(", ")]

    def sums(part: pa.Table, values: pa.Table) -> pa.Table:
        (row,) = part.to_pylist()
        units = unpacked(row)
        both = Alignment(units, tokenizers(a_path, b_path).sizes)
        a, b, upto = both.links()
        by_unit = upto[both.upto[0]]
        known = values["a"].to_numpy().astype(np.int64) << 32 | values["b"].to_numpy()
        order = np.argsort(known)
        # Pairs of units that no text of the slice has (those of texts without tokens) are not counted.
        at = order[np.minimum(np.searchsorted(known[order], both.keys(a, b)), len(order) - 1)] if len(order) else np.zeros(0, np.int64)
        per_unit = [*map(np.diff, both.upto), np.diff(both.groups_of_units()), np.diff(by_unit)]
        per_unit += [np.diff(np.concatenate(([0], np.cumsum(values[c].to_numpy().astype(np.int64)[at])))[by_unit] if len(order) else by_unit)
                     for c in ("top", "n")]
        edges = units.edges()
        per_text = [np.diff(np.concatenate(([0], np.cumsum(x[units.units])))[edges]) for x in per_unit]
        spelled, seq = both.written(), units.units.tolist()
        digest = [hashlib.sha256(b"".join(map(spelled.__getitem__, seq[x:y]))[:-1]).hexdigest() if x < y else ""
                  for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return pa.table([pa.array(row["doc_ids"], pa.int64()), *map(pa.array, per_text), pa.array(digest, pa.string())], names)

    return slices.groupBy("slice").cogroup(own.groupBy("slice")).applyInArrow(sums, RESULT)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, byte-level pairs against pieces."""
    return aligned(table(spark, sf_dir, "documents"), tokenizer_path(A), tokenizer_path(B))
