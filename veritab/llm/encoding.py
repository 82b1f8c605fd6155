"""Token ids of whole texts, in Python workers."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from veritab.llm.common import REMEMBERED, text_bytes
from veritab.llm.words import LOWER, hashes, lookup, spans

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

BLANK = lookup(9, 10, 13, 32)
LETTER = lookup(*range(65, 91), *range(97, 123))
#: ASCII marks other than the apostrophe, at which contractions begin.
MARK = lookup(*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127))
PROBES = ["word", "thninble", "éauxmentier", "weiß", "ñandú", "a", "øre", "façade", "internationalisation"]


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for 256 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes with a tokenizer file; remembers the ids of words.

    ``by_word`` holds for lower-casing tokenizers that drop white space and never join text across
    it. The ids of a text are then those of its pieces: runs between blanks, cut once more where an
    ASCII mark follows a Latin letter. Pieces that occur again are not encoded again, and plain
    words go to the library's model without its normaliser. The memory for pieces is bounded by
    ``keep``; when full it starts anew, which changes no id. Texts with ``<|``, which may begin a
    special token, go to the library whole.
    """

    def __init__(self, path: str, by_word: bool = True, keep: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.by_word, self.keep, self.pieces = by_word, keep, {}
        self.letters = byte_letters()
        self.plain = all(self._word(w) == self._ids([w])[0] for w in PROBES)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.batch(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(word)], "<u4").tobytes()

    def _learn(self, new: list[bytes], plain: list[bool]) -> None:
        hard = []
        for piece, easy in zip(new, plain, strict=True):
            if easy and self.plain:
                self.pieces[piece] = self._word(piece.decode())
            else:
                hard.append(piece)
        for at in range(0, len(hard), 10_000):
            part = hard[at: at + 10_000]
            self.pieces.update(zip(part, self._ids([p.decode() for p in part]), strict=True))

    def _by_word(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, starts = text_bytes(column)
        low, blank, letter = LOWER[data], BLANK[data], LETTER[data]
        pair = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        letter[pair] = letter[pair + 1] = True
        cut = np.zeros(len(data), bool)
        cut[1:] = letter[:-1] & MARK[data[1:]]
        begin, stop = spans(blank, starts, cut)
        _, first, each = np.unique(hashes(low, blank, begin, stop), return_index=True, return_inverse=True)
        raw, easy = low.tobytes(), np.concatenate(([0], np.cumsum(~letter)))
        easy = (easy[stop[first]] == easy[begin[first]]).tolist()
        words = [raw[a:b] for a, b in zip(begin[first].tolist(), stop[first].tolist(), strict=True)]
        if len(self.pieces) > self.keep:
            self.pieces.clear()
        pieces = self.pieces
        fresh = [(w, e) for w, e in zip(words, easy, strict=True) if w not in pieces]
        if fresh:
            self._learn(*zip(*fresh, strict=True))
        known = [pieces[w] for w in words]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool, at = np.frombuffer(b"".join(known), "<u4"), np.concatenate(([0], np.cumsum(size)))
        counts = size[each]
        ends = np.cumsum(counts)
        ids = pool[np.repeat(at[:-1][each] - (ends - counts), counts) + np.arange(counts.sum())]
        upto = np.concatenate(([0], ends))
        return ids, upto[np.searchsorted(begin, starts)]

    def __call__(self, column: pa.Array, end_id: int | None = None) -> list[np.ndarray]:
        """32-bit ids of each text, ``end_id`` appended; null is an empty text."""
        end = np.array([] if end_id is None else [end_id], "<u4")
        texts, found = None, {}
        data, starts = text_bytes(column)
        if not self.by_word:
            found = dict.fromkeys(range(len(column)))
        elif b"<|" in (raw := data.tobytes()):
            found = {i: None for i in range(len(column)) if b"<|" in raw[starts[i]: starts[i + 1]]}
        if found:
            texts = column.to_pylist()
            found = dict(zip(found, self._ids([texts[i] or "" for i in found]), strict=True))
        if len(found) < len(column):
            ids, at = self._by_word(column)
            out = [ids[at[i]: at[i + 1]] for i in range(len(column))]
        else:
            out = [None] * len(column)
        for i, got in found.items():
            out[i] = np.frombuffer(got, "<u4")
        return [np.concatenate((x, end)).astype("<u4", copy=False) for x in out]


@lru_cache(maxsize=4)
def encoder(path: str, by_word: bool = True) -> Encoder:
    """One per worker process, so that tasks after the first know the common words; other tasks drop it."""
    return Encoder(path, by_word)


REMEMBERED.append(encoder.cache_clear)
