"""Text quality: random Fourier features of document statistics, ridge scores, isotonic calibration.

One pass over the texts takes statistics of each whole text (shares of byte classes, word lengths,
repetition, shouting, marks at word ends). The Gaussian kernel between standardised statistics is
approximated by ``FEATURES`` random cosines; each partition adds up its part of the normal equations,
the parts are added by row on the cluster, and the driver solves one fixed-size system. Scores of the
rows learned from, counted in fixed bins, are calibrated by isotonic regression.

All labelled rows outside the held-out part are used; sizes sent to the driver don't depend on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.llm.common import table, text_bytes
from veritab.llm.scoring import BINS, bins_of, features, isotonic, per_text, remainder, sums, verdict
from veritab.llm.common import mix
from veritab.llm.words import LOWER, hashes, lookup, spans

FEATURES, WIDTH, RIDGE, SEED = 384, 3.0, 1.0, 3
LOW, HIGH = -0.5, 1.5

BLANK = lookup(9, 10, 11, 12, 13, 32)
KINDS = 12
KIND = np.full(256, 11, np.int32)  # other marks and control characters
for kind, codes in enumerate([range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".", b",;:", b"!?", b"#$%&*@", b"|", range(128, 256)]):
    KIND[list(codes)] = kind
LOWERS, UPPERS, FOREIGN = 0, 1, 10


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each text; a null text is an empty one and has zeros."""
    data, starts = text_bytes(texts)
    n = len(starts) - 1
    kinds = per_text(KIND[data], starts, KINDS)
    size = np.maximum(kinds.sum(1), 1)
    low, blank = LOWER[data], BLANK[data]
    begin, stop = spans(blank, starts)
    word = hashes(low, blank, begin, stop)
    doc = np.searchsorted(starts, begin, "right") - 1
    words = np.maximum(sums(doc, n), 1)
    length = (stop - begin).astype(float)
    mean = sums(doc, n, length) / words
    spread = np.sqrt(np.maximum(sums(doc, n, length * length) / words - mean * mean, 0))
    own = mix(word ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    distinct = sums(doc[np.unique(own, return_index=True)[1]], n) / words
    pair = mix(own[1:] * np.uint64(3) + own[:-1])
    pairs = sums(doc[1:][np.unique(pair, return_index=True)[1]], n) / words
    again = sums(doc[1:][own[1:] == own[:-1]], n) / words
    last = KIND[data[stop - 1]] if len(stop) else np.zeros(0, int)
    ends = [sums(doc[last == k], n) / words for k in (5, 6, 7, 8, 9)]
    uppers = np.concatenate(([0], np.cumsum(KIND[data] == UPPERS)))
    lowers = np.concatenate(([0], np.cumsum(KIND[data] == LOWERS)))
    shout = (uppers[stop] - uppers[begin] > 1) & (lowers[stop] == lowers[begin])
    return np.column_stack([
        np.sqrt(kinds / size[:, None]), np.log1p(kinds.sum(1)), np.log1p(sums(doc, n)), mean, spread,
        distinct, pairs, again, *np.sqrt(ends), sums(doc[shout], n) / words])


class Model:
    """Statistics to calibrated scores, in numpy; small enough to go along with each task."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray):
        random = np.random.default_rng(SEED)
        self.centre, self.scale = centre, np.where(scale > 1e-9, scale, 1.0)
        self.turn = random.normal(0, 1 / WIDTH, (len(centre), FEATURES))
        self.shift = random.uniform(0, 2 * np.pi, FEATURES)
        self.weights, self.rates = None, None

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.centre) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.turn + self.shift) * np.sqrt(2 / FEATURES), np.ones(len(z))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.rates[bins_of(self.cosines(stats) @ self.weights, LOW, HIGH)]


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Rows (i, vector) added up by i on the cluster; there are as many i as the model has features."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, vector in zip(batch["i"].to_pylist(), batch["v"].to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(vector)
        if total:
            yield pa.RecordBatch.from_pydict({"i": pa.array(list(total), pa.int32()), "v": [v.tobytes() for v in total.values()]})

    return {r.i: np.frombuffer(r.v) for r in parts.repartition("i").mapInArrow(add, "i int, v binary").collect()}


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """``stats(doc_id, f)`` and ``labels(doc_id, y)``, 0 or 1. None when nothing is labelled."""
    first = stats.select(F.size("f").alias("n")).first()
    if first is None:
        return None
    n = first.n
    moments = stats.select(*[g(F.col("f")[i]).alias(f"{name}{i}") for i in range(n)
                             for name, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    model = Model(np.array([moments[f"m{i}"] for i in range(n)]), np.array([moments[f"s{i}"] for i in range(n)]))
    train = stats.join(labels, "doc_id").select("f", F.col("y").cast("double").alias("y"))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if len(batch):
                x, y = model.cosines(matrix(batch["f"])), batch["y"].to_numpy()
                total += x.T @ np.column_stack([x, y])
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(range(len(total)), pa.int32()), "v": [row.tobytes() for row in total]})

    total = added(train.mapInArrow(equations, "i int, v binary"))
    system = np.array([total.get(i, np.zeros(FEATURES + 2)) for i in range(FEATURES + 1)])
    if not system[FEATURES, FEATURES]:
        return None
    model.weights = np.linalg.solve(system[:, :-1] + RIDGE * np.eye(FEATURES + 1), system[:, -1])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS))
        for batch in batches:
            if len(batch):
                at, y = bins_of(model.cosines(matrix(batch["f"])) @ model.weights, LOW, HIGH), batch["y"].to_numpy()
                total += [np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)]
        yield pa.RecordBatch.from_pydict({"i": pa.array([0, 1], pa.int32()), "v": [row.tobytes() for row in total]})

    total = added(train.mapInArrow(counted, "i int, v binary"))
    model.rates = isotonic(total[0], total[1])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs(doc_id, text)``.

    ``labels(doc_id, quality)``: rows with a null label or doc_id are not learned from, nor are the
    held-out ones (crc32 of the doc_id modulo 4 is 2; a null doc_id counts as held out); repeated
    labels count each. Null and empty texts have a score like any other; without labels each score is
    0.5; an empty table gives no rows; other columns are ignored.
    """
    stats = features(docs, statistics, "quality-statistics")
    known = labels.filter("quality is not null").filter(remainder("doc_id", 4) != 2).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y"))
    model = fit(stats, known)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(matrix(batch["f"])) if model and len(batch) else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score)], ["doc_id", "score"])

    return stats.mapInArrow(scored, "doc_id long, score double").select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "score", verdict().alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
