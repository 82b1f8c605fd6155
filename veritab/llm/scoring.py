"""What both text classifiers share: byte classes, splits of the labels, isotonic calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veritab.llm.common import ship, sliced, stored, text_bytes

BINS = 2000


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def features(docs: DataFrame, measure: Callable[[pa.Array], np.ndarray], label: str) -> DataFrame:
    """doc_id and the features of each whole text, written once and read by every later step."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 19):
            values = measure(batch["text"])
            flat = pa.array(values.ravel())
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * values.shape[1])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "f"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(own.mapInArrow(rows, "doc_id long, f array<double>"), label)


def per_text(codes: np.ndarray, starts: np.ndarray, kinds: int) -> np.ndarray:
    """How many bytes of each kind a text has."""
    n = len(starts) - 1
    key = np.repeat(np.arange(n, dtype=np.int32) * kinds, np.diff(starts))
    return np.bincount(key + codes, minlength=n * kinds).reshape(n, kinds).astype(float)


def sums(which: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(which, weights, minlength=n).astype(float)


def bins_of(raw: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip((raw - low) / (high - low) * BINS, 0, BINS - 1).astype(np.int64)


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The non-decreasing rates nearest to those of the bins (pool adjacent violators); one pseudo-count a pool."""
    pools: list[list[float]] = []
    for n, p in zip(total, positive, strict=True):
        pools.append([n, p, 1])
        while len(pools) > 1 and (pools[-1][0] == 0 or pools[-2][0] == 0
                                  or pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]):
            n2, p2, w2 = pools.pop()
            pools[-1][0] += n2
            pools[-1][1] += p2
            pools[-1][2] += w2
    rate = sum(positive) / max(sum(total), 1)
    return np.concatenate([np.full(int(w), (p + rate) / (n + 1)) for n, p, w in pools])


def verdict(score: str = "score") -> Column:
    return F.when(F.col(score) >= 0.7, 1).otherwise(0)


__all__ = ["BINS", "bins_of", "features", "isotonic", "per_text", "remainder", "sums", "text_bytes", "verdict"]
