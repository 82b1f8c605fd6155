"""Exact Jaccard join of shingle sets with signature trees, and the groups its links form.

The tree's upper levels are laid out over the cluster, its lower levels in the tasks.

1. *Size ranges.* Sets that can link differ in size by at most a tenth, so a pair belongs to the size
   class of its smaller set; a set is entered in its own class and, near the border, in the one below.
2. *Token classes.* Sets that link differ in at most d tokens, d known for the class. Tokens are dealt
   by a hash into more than d parts, so linked sets agree in a whole part: what a part holds is a key.
   There are more parts than that by two allowances: a set does without its lightest parts (empty ones
   first), then without the keys that most other sets have, and linked sets still share a key. So sets
   that have a line or a passage in common, but no link, mostly share none. Tokens that many documents
   have are kept out of keys. Sets that share a key get a leader; leaders connect them into
   neighbourhoods, outside of which no set can have a link.
3. *Bitmaps.* Within a neighbourhood a tree is built over the sets: each node holds the OR of its
   sets' token bitmaps, their range of sizes and the fewest bits of any. A dual traversal drops a pair
   of nodes when the overlap that is possible at most is below what the smallest sizes need, or when
   all below both is connected already. Surviving pairs of sets are compared token by token.

Equal sets are one set throughout. A neighbourhood of more than ``BLOCK`` sets or ``BLOCK_TOKENS`` tokens
is split into blocks. A unit holds one of them and lets ``PASSED`` others pass by, one at a time, so no task holds an
unbounded group and a set travels to fewer units than there are blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veritab.llm.common import ending, mix, ship, sliced, stored, table, text_bytes
from veritab.llm.components import components
from veritab.llm.words import LOWER, hashes, lookup, spans

SHINGLE, NEED = 3, (90, 100)  # link if 100 * intersection >= 90 * union
BLANK = lookup(9, 10, 11, 12, 13, 32)
SAMPLE, MOST_COMMON = 4000, 4096  # documents sampled for tokens that many have; bound on those
RATIO, LEAF, FAN, WORDS = 1.5, 32, 8, 16
#: Percent of the parts that linked sets can differ in, by which there are more: for light parts, and for keys that many sets have.
LIGHT, OFTEN = 30, 20
#: Sets of a key are counted up to this number.
MANY = 1 << 14
#: Sets and tokens of a block, on average.
BLOCK, BLOCK_TOKENS = 5000, 2_000_000
#: Blocks that pass by the one a unit holds.
PASSED = 4
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def token_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each text's begin (with the end)."""
    data, starts = text_bytes(texts)
    n = len(starts) - 1
    low, blank = LOWER[data], BLANK[data]
    begin, stop = spans(blank, starts)
    word = hashes(low, blank, begin, stop)
    doc = np.searchsorted(starts, begin, "right") - 1
    count = np.bincount(doc, minlength=n)
    # runs of `shingle` words within a text; a shorter text is one run
    run, last = np.zeros(len(word), np.uint64), count[doc] if len(doc) else doc
    place = np.arange(len(word)) - (np.cumsum(count) - count)[doc] if len(doc) else doc
    short = last < shingle
    for k in range(shingle):
        shifted = np.zeros(len(word), np.uint64)
        shifted[: max(len(word) - k, 0)] = word[k:]
        run = mix(run * A + np.where(short & (place + k >= last), np.uint64(0), shifted) + B)
    keep = (place + shingle <= last) | (short & (place == 0))
    run, doc = run[keep], doc[keep]
    order = np.lexsort((run, doc))
    run, doc = run[order], doc[order]
    first = np.ones(len(run), bool)
    first[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    run, doc = run[first], doc[first]
    return run, np.searchsorted(doc, np.arange(n + 1))


@lru_cache(maxsize=8)
def classes(need: tuple[int, int], longest: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower ends of the size classes, the number of parts of each, and how many of them a set does without: light ones, frequent ones."""
    low, parts, light, often = [1], [], [], []
    p, q = need
    while low[-1] < longest:
        low.append(int(low[-1] * RATIO) + 1)
        top = low[-1] - 1
        both = top + top * q // p  # sizes of the largest pair whose smaller set is in the class
        differ = both * (q - p) // (q + p)
        light.append((differ + 1) * LIGHT // 100 + 1)
        often.append((differ + 1) * OFTEN // 100 + 2)
        parts.append(differ + 1 + light[-1] + often[-1])
    return np.array(low[:-1]), np.array(parts), np.array(light), np.array(often)


def keys_of(tokens: np.ndarray, starts: np.ndarray, need: tuple[int, int], common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) for the parts of each set in each of its classes."""
    return class_keys(tokens, starts, need, common)[:2]


def class_keys(tokens: np.ndarray, starts: np.ndarray, need: tuple[int, int], common: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(set, key, class) for each part of each set in each of its classes, but the lightest parts.

    ``common`` tokens are left out of the parts; what two sets then differ in is no more than before. Linked
    sets agree in more parts than both allowances of their class. A set leaves out as many as the first, in one
    order for all (number of tokens, then key): of the parts that two agree in, at most that many go.
    """
    size = np.diff(starts)
    low, parts, light, _ = classes(need)
    own = np.searchsorted(low, size, "right") - 1
    below = np.searchsorted(low, np.maximum(-(-size * need[0] // need[1]), 1), "right") - 1
    member = np.repeat(np.arange(len(size)), size)
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens
        member, tokens = member[rare], tokens[rare]
    value, deal = mix(tokens ^ C), mix(tokens + B) >> np.uint64(32)
    out = []
    for level in (own, below):
        use = (size > 0) & ((level != own) if level is below else True)
        n = np.where(use, parts[level], 0)
        base = np.cumsum(n) - n
        on = use[member]
        at = member[on]
        slot = base[at] + ((deal[on] * n[at].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(int(n.sum()), np.uint64)
        np.add.at(total, slot, value[on])
        whose = np.repeat(np.arange(len(size)), n)
        held = np.bincount(slot, minlength=len(total))
        place = np.arange(len(total)) - base[whose]
        key = mix(total + mix(place.astype(np.uint64) * A + level[whose].astype(np.uint64) * B + C))
        keep = np.lexsort((key, held, whose))[place >= light[level[whose]]]
        out.append((whose[keep], key[keep], level[whose[keep]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def fingerprints(tokens: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set, which name it."""
    upto = [np.concatenate(([np.uint64(0)], np.cumsum(mix(tokens * k + k)))) for k in (A, C)]
    return [(u[starts[1:]] - u[starts[:-1]]).view(np.int64) for u in upto]


def text_keys(texts: pa.Array) -> pa.Array:
    data, at = text_bytes(texts)
    raw = data.tobytes()
    keys = [xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.array(np.array(keys, np.uint64).view(np.int64))


def doc_rows(texts: pa.Array, doc_ids: pa.Array, shingle: int) -> pa.RecordBatch:
    """The size and the name of each text's set."""
    tokens, starts = token_sets(texts, shingle)
    a, b = fingerprints(tokens, starts)
    return pa.RecordBatch.from_arrays([doc_ids, text_keys(texts), pa.array(np.diff(starts).astype(np.int64)), pa.array(a), pa.array(b)],
                                      ["doc_id", "text_key", "n", "a", "b"])


def key_rows(texts: pa.Array, need: tuple[int, int], shingle: int, common: np.ndarray) -> pa.RecordBatch:
    """Each key of each set (``a``), once a set, with its class."""
    tokens, starts = token_sets(texts, shingle)
    a, _ = fingerprints(tokens, starts)
    _, first = np.unique(a, return_index=True)
    whose, key, level = class_keys(tokens, starts, need, common)
    some = np.isin(whose, first)
    return pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(a[whose[some]]), pa.array(level[some])], ["x", "a", "level"])


def common_tokens(docs: DataFrame, size: int, shingle: int) -> np.ndarray:
    """Tokens of many documents, from a bounded sample; at most MOST_COMMON reach the driver.

    They only keep chance agreement out of the keys: with any choice of them the join is exact.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2 << 20):
            token, n = np.unique(token_sets(batch["text"], shingle)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    share = int(min(1.0, SAMPLE / max(size, 1)) * (1 << 20))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share)
    found = (sample.mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
             .filter(F.col("n") >= max(3, min(SAMPLE, size) * 3 // 1000)).orderBy(F.desc("n"), "token").limit(MOST_COMMON).collect())
    return np.sort(np.array([r.token for r in found], np.int64).view(np.uint64))


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, a, level) sorted by key and set: once each, those of keys that several sets have, with the number of these (``MANY`` at most)."""
    names = ["x", "a", "level"]
    kept, told = [np.zeros(0, np.int64)] * 3, 0  # the last key's rows so far; if they have gone on, the last of them, and 1

    def rows(columns: list[np.ndarray], n: np.ndarray, use: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[use]) for c in (*columns, n)], [*names, "n"])

    for batch in ending(batches):
        x, a, level = (np.concatenate([k, batch[c].to_numpy()]) for k, c in zip(kept, names, strict=True))
        if not len(x):
            continue
        once = np.ones(len(x), bool)
        once[1:] = (x[1:] != x[:-1]) | (a[1:] != a[:-1])
        x, a, level = x[once], a[once], level[once]
        begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        count = np.diff(begin, append=len(x))
        if told:
            count[0] += MANY
        n = np.repeat(np.minimum(count, MANY), np.diff(begin, append=len(x)))
        at = np.arange(len(x))
        full = n[-1] == MANY  # a key known to have so many needn't wait for the rest
        use = (at >= told) & (n > 1) & (full | (at < begin[-1]))
        if use.any():
            yield rows([x, a, level], n, use)
        last = len(x) - 1 if full else begin[-1]
        kept, told = [x[last:], a[last:], level[last:]], int(full)
    if not told and len(kept[0]) > 1:
        yield rows(kept, np.full(len(kept[0]), len(kept[0])), slice(None))


def without_frequent(keys: DataFrame, need: tuple[int, int]) -> DataFrame:
    """Rows (x, a) of ``keys(x, a, level, n)`` but, of each set and class, as many as its second allowance: those of the largest n.

    Linked sets agree in one more key than that, in one order for all, so one stays that both have.
    """
    spare = F.element_at(F.lit(classes(need)[3].tolist()), (F.col("level") + 1).cast("int"))
    own = Window.partitionBy("a", "level").orderBy(F.desc("n"), "x")
    return keys.withColumn("place", F.row_number().over(own)).filter(F.col("place") > spare).select("x", "a")


def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, a) sorted by key: a link (u, v) from each set to the first with the same key."""
    key = first = None
    for batch in ending(batches):
        x, a = batch["x"].to_numpy(), batch["a"].to_numpy()
        if not len(x):
            continue
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        new[0] = key is None or x[0] != key
        heads, at = a[new], np.cumsum(new) - 1
        lead = np.where(at >= 0, heads[np.maximum(at, 0)] if len(heads) else 0, 0 if first is None else first)
        key, first = x[-1], lead[-1]
        far = a != lead
        if far.any():
            both = np.unique(np.column_stack([a[far], lead[far]]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


class Tree:
    """Signature tree over sets ordered by size and content: levels of (OR of bitmaps, sizes, fewest bits)."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray):
        self.maps, self.sizes = maps, sizes
        bits = np.bitwise_count(maps).sum(1).astype(np.int64)
        level = self._up(maps, sizes, sizes, bits, LEAF)
        self.levels = [level]
        while len(level[1]) > 1:
            level = self._up(*level, FAN)
            self.levels.append(level)

    @staticmethod
    def _up(maps, low, high, bits, fan):
        at = np.arange(0, len(low), fan)
        return (np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(bits, at))


def possible(one, two, need: tuple[int, int]) -> np.ndarray:
    """Which pairs of nodes (a row against rows) may hold a pair that links."""
    p, q = need
    shared = np.bitwise_count(one[0] & two[0]).sum(-1).astype(np.int64)
    most = np.minimum(one[2] - np.maximum(one[3] - shared, 0), two[2] - np.maximum(two[3] - shared, 0))
    return (most * (p + q) >= p * (one[1] + two[1])) & (one[2] * q >= p * two[1]) & (two[2] * q >= p * one[1])


def join_sets(sets: list[np.ndarray], need: tuple[int, int] = NEED, apart: np.ndarray | None = None) -> np.ndarray:
    """The first member of each set's group, groups being connected by links. ``apart``: only pairs of unlike marks count."""
    n, (p, q) = len(sets), need
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets], np.int64)
    maps = np.zeros((n, WORDS), np.uint64)
    for i, s in enumerate(sets):
        np.bitwise_or.at(maps[i], ((s >> np.uint64(6)) % np.uint64(WORDS)).astype(np.int64), np.uint64(1) << (s & np.uint64(63)))
    low = np.array([int(s[0]) if len(s) else 0 for s in sets], np.uint64)
    order = np.lexsort((low, size))
    maps, size = maps[order], size[order]
    sets = [sets[i] for i in order]
    mark = None if apart is None else apart[order]

    def compare(i: int, j: int) -> None:
        x, y = find(i), find(j)
        if x != y:
            a, b = sets[i], sets[j]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            common = int((b[at] == a).sum()) if len(b) else 0
            if common * (p + q) >= p * (len(a) + len(b)):
                root[max(x, y)] = min(x, y)

    bits = np.bitwise_count(maps).sum(1).astype(np.int64)
    if mark is None:
        for i in range(n - 1):  # neighbours in order first: most of a group of near copies is connected at once
            compare(i, i + 1)
            compare(0, i + 1)
    tree = Tree(maps, size)
    spans_of = [LEAF * FAN ** k for k in range(len(tree.levels))]

    def uniform(level: int, k: int) -> int:
        """The one group of all sets below a node, or -1."""
        begin = k * spans_of[level]
        own = {find(i) for i in range(begin, min(begin + spans_of[level], n))}
        return own.pop() if len(own) == 1 else -1

    groups = [[uniform(level, k) for k in range(len(tree.levels[level][1]))] for level in range(len(tree.levels))]
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, u, v = stack.pop()
        if groups[level][u] >= 0 and groups[level][v] >= 0 and find(groups[level][u]) == find(groups[level][v]):
            continue
        nodes = tree.levels[level]
        if u != v and not possible(tuple(x[u] for x in nodes), tuple(x[v] for x in nodes), need):
            continue
        if level:
            left = range(u * FAN, min((u + 1) * FAN, len(tree.levels[level - 1][1])))
            right = range(v * FAN, min((v + 1) * FAN, len(tree.levels[level - 1][1])))
            stack += [(level - 1, i, j) for i in left for j in right if i <= j]
            continue
        ends = min((v + 1) * LEAF, n)
        for i in range(u * LEAF, min((u + 1) * LEAF, n)):
            js = np.arange(max(v * LEAF, i + 1), ends)
            if mark is not None:
                js = js[mark[js] != mark[i]]
            if not len(js):
                continue
            one = (maps[i], size[i], size[i], bits[i])
            gone = np.bitwise_count(maps[i] & ~maps[js]).sum(1).astype(np.int64)
            fit = possible(one, (maps[js], size[js], size[js], bits[js]), need) & ((size[i] - gone) * (p + q) >= p * (size[i] + size[js]))
            for j in js[fit].tolist():
                compare(i, j)
    out = np.empty(n, np.int64)
    for i in range(n):
        out[order[i]] = order[find(i)]
    return out


def name(a: str = "a", b: str = "b") -> Column:
    return F.concat(F.hex(a), F.lit("-"), F.hex(b))


def meetings() -> Column:
    """The units of a set in ``block`` of ``blocks``: the block i that is held there, the unit's number u of those that hold it, and
    how many blocks d lie from i to the set's own (in a ring; 0: it is held). Each two blocks meet in one unit.
    """
    block, blocks = F.col("block"), F.col("blocks")
    half = F.floor(blocks / 2).cast("int")
    far = F.sequence(F.lit(0), half)
    held = F.transform(F.filter(far, lambda u: (u == 0) | (u * PASSED < half)), lambda u: F.struct(block.alias("i"), u.alias("u"), F.lit(0).alias("d")))
    start = lambda d: F.pmod(block - d, blocks)
    passing = F.filter(far, lambda d: (d > 0) & ((d * 2 != blocks) | (start(d) < block)))
    return F.concat(held, F.transform(passing, lambda d: F.struct(start(d).alias("i"), F.floor((d - 1) / PASSED).cast("int").alias("u"), d.alias("d"))))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, need: tuple[int, int] = NEED) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs(doc_id, text)``.

    Two rows link when ``need[1] * |A and B| >= need[0] * |A or B|``; component_id is the smallest
    doc_id of all rows connected by links. Null texts and texts without words have no shingles, link
    with nothing and are their own component; repeated rows and rows that share a doc_id stay; a null
    doc_id is never a component's id unless all of it are null; other columns are ignored; an empty
    table gives no rows. Shingles are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 20):
            yield doc_rows(batch["text"], batch["doc_id"], shingle)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 20):
            yield key_rows(batch["text"], need, shingle, common)

    entries = stored(docs.mapInArrow(named, "doc_id long, text_key long, n long, a long, b long"), "set-names")
    common = common_tokens(docs, entries.count(), shingle)
    keys = docs.mapInArrow(keyed, "x long, a long, level long").repartition("x").sortWithinPartitions("x", "a")
    keys = without_frequent(keys.mapInArrow(shared, "x long, a long, level long, n long"), need)
    links = keys.repartition("x").sortWithinPartitions("x", "a").mapInArrow(leaders, "u long, v long")
    hoods = stored(components(links), "neighbourhoods")

    sets = entries.filter("n > 0").groupBy("a", "b").agg(F.min(F.struct("text_key", "doc_id")).alias("pick"), F.max("n").alias("n"))
    sets = sets.join(hoods.withColumnRenamed("node", "a"), "a").select("a", "b", "n", "label", "pick.text_key", "pick.doc_id")
    counts = sets.groupBy("label").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    sets = stored(sets.join(counts, "label").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")), "sets-in-question")

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in sliced(batches):
            packed = pa.array([pack((x or b"").lower()) for x in batch["text"].cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], packed, text_keys(batch["text"])], ["doc_id", "packed", "text_key"])

    # Texts travel in lower case and compressed, which is less than their tokens; the join is by shuffle at any size.
    own = docs.mapInArrow(with_key, "doc_id long, packed binary, text_key long")
    match = own.text_key.eqNullSafe(sets.text_key) & own.doc_id.eqNullSafe(sets.doc_id)
    held = own.join(sets.hint("merge"), match).select(own.packed, sets.a, sets.b, sets.label, sets.blocks, sets.block)
    units = held.withColumn("unit", F.explode(meetings())).select("label", "unit.i", "unit.u", "unit.d", "a", "b", "packed")

    def block_of(rows: dict[tuple, bytes]) -> tuple[list[tuple], list[np.ndarray]]:
        """Names and tokens of a block's sets."""
        unpack, names, sets = zstandard.ZstdDecompressor().decompress, list(rows), []
        for at in range(0, len(names), 64):
            tokens, starts = token_sets(pa.array([unpack(rows[x]) for x in names[at: at + 64]], pa.binary()), shingle)
            sets += [tokens[i:j] for i, j in zip(starts[:-1], starts[1:], strict=True)]
        return names, sets

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks arrive sorted by unit, the one that is held there first; besides it one is in memory at a time."""
        at, rows, kept = None, {}, ([], [])

        def links_of() -> Iterator[pa.RecordBatch]:
            nonlocal kept
            if at is None:
                return
            *_, u, d = at
            block = block_of(rows)
            if not d:
                kept = block
                (names, sets), apart = block, None
            else:
                names, sets = kept[0] + block[0], kept[1] + block[1]
                apart = np.repeat([0, 1], [len(kept[0]), len(block[0])])
            if len(names) > 1 and (d or not u):
                first = join_sets(sets, need, apart)
                if links := [(*names[i], *names[f]) for i, f in enumerate(first.tolist()) if i != f]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b", "c", "d"])

        for batch in ending(batches):
            columns = [batch[c].to_pylist() for c in ("label", "i", "u", "d", "a", "b", "packed")]
            for label, i, u, d, a, b, packed in zip(*columns, strict=True):
                if (label, i, u, d) != at:
                    yield from links_of()
                    if at is None or (label, i, u) != at[:3]:
                        kept = ([], [])
                    at, rows = (label, i, u, d), {}
                rows[a, b] = packed
        yield from links_of()

    key = ["label", "i", "u"]
    links = units.repartition(*key).sortWithinPartitions(*key, "d").mapInArrow(linked, "a long, b long, c long, d long")
    groups = components(links.select(name().alias("u"), name("c", "d").alias("v")))
    labelled = entries.withColumn("node", name()).join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = labelled.select("doc_id", "n", "label")
    least = labelled.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def op8_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS s
      FROM (SELECT *, unnest(range(0, greatest(len(w) - 3, 0) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.doc_id AS u, y.doc_id AS v FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id
          JOIN n a ON a.doc_id = x.doc_id JOIN n b ON b.doc_id = y.doc_id
          GROUP BY x.doc_id, y.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(v) FROM reach r WHERE r.u = w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""
