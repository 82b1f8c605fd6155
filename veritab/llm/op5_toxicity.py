"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, and beginnings of words of 4 to 6 bytes, that occur far more often in
toxic rows of the fitting sample than elsewhere (by odds, and by how unlikely that is by chance). Features of a whole text are lexicon densities and
weights, how near second-person words stand to lexicon words, capitals, marks and obfuscation rates.
Spark's gradient-boosted trees are fitted on the sample; all rows are scored.

The sample is bounded by ``SAMPLE`` labelled rows, chosen by a hash of the doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritab.llm.common import mix, ship, sliced, stored, table, text_bytes
from veritab.llm.scoring import BINS, features, isotonic, per_text, remainder, sums, verdict
from veritab.llm.words import LOWER, RANDOM, REACH, lookup, spans

SAMPLE = 40_000
LEXICON, LEAST_ROWS, LEAST_ODDS, LEAST_SURPRISE = 4096, 4, 2.0, 9.0
PREFIXES = (4, 5, 6)
NEAR = 8
#: Text whose units are counted at once; its arrays take some 40 times as much.
SLICE_BYTES = 1 << 19

#: Second-person words of the corpus' languages.
SECOND_PERSON = (
    "you your yours yourself yourselves u ur ya du dich dir dein deine deinen deinem deiner ihr euch euer eure "
    "tu te toi ton tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra").split()

LETTERS = lookup(*range(65, 91), *range(97, 123), *range(128, 256))
NOT_LETTERS = ~LETTERS
CODE = np.full(256, 7, np.int32)
for kind, codes in enumerate([range(97, 123), range(65, 91), range(48, 58), b" \t\n\r", b"!", b"?", b"#$%&*@~^"]):
    CODE[list(codes)] = kind
DISGUISE = lookup(*b"0123456789@$*!#%+_")


def units(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as runs of letters: begin, end, hashes of the word and its beginnings (a row each), 0 where too short."""
    low, blank = LOWER[data], NOT_LETTERS[data]
    begin, stop = spans(blank, starts)
    if not len(begin):
        return begin, stop, np.zeros((1 + len(PREFIXES), 0), np.uint64), low
    step = np.ones(len(low), np.int32)
    step[begin[1:]] = 1 - np.diff(begin)
    step[: begin[0] + 1] = 0
    place = np.cumsum(step, dtype=np.int32)
    value = RANDOM[place & (REACH - 1)] * (low.astype(np.uint64) + np.uint64(1))
    value[blank] = 0
    length = (stop - begin).astype(np.uint64)
    out = [mix(np.add.reduceat(value, begin) + length)]
    for k in sorted(PREFIXES, reverse=True):
        value[place >= k] = 0
        part = mix(np.add.reduceat(value, begin) + np.uint64(1000 + k))
        part[length <= k] = 0
        out.append(part)
    return begin, stop, np.array(out), low


def hashes_of(words: list[str]) -> np.ndarray:
    data, starts = text_bytes(pa.array(words))
    return np.unique(units(data, starts)[2][0])


class Lexicon:
    """Weights of unit hashes; a small table of bits answers most look-ups."""

    def __init__(self, found: np.ndarray, weights: np.ndarray):
        order = np.argsort(found)
        self.found, self.weights = found[order], weights[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.found & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def weigh(self, hashed: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashed))
        maybe = np.flatnonzero(self.bits[(hashed & np.uint64(0xFFFFF)).astype(np.int64)] & (hashed != 0))
        if len(maybe) and len(self.found):
            at = np.minimum(np.searchsorted(self.found, hashed[maybe]), len(self.found) - 1)
            out[maybe] = np.where(self.found[at] == hashed[maybe], self.weights[at], 0)
        return out


def measure(texts: pa.Array, lexicon: Lexicon, second: np.ndarray) -> np.ndarray:
    """One row of features for each text; null is an empty text."""
    data, starts = text_bytes(texts)
    n = len(starts) - 1
    kinds = per_text(CODE[data], starts, 8)
    size = np.maximum(kinds.sum(1), 1)
    begin, stop, hashed, low = units(data, starts)
    doc = np.searchsorted(starts, begin, "right") - 1
    words = np.maximum(sums(doc, n), 1)
    weight = np.max([lexicon.weigh(h) for h in hashed], axis=0) if len(begin) else np.zeros(0)
    hit = np.flatnonzero(weight > 0)
    person = np.flatnonzero(np.isin(hashed[0], second))
    strongest = np.zeros(n)
    np.maximum.at(strongest, doc[hit], weight[hit])
    near = np.zeros(len(hit), bool)
    if len(person) and len(hit):
        for side in ("left", "right"):
            at = np.clip(np.searchsorted(person, hit, side) - (side == "left"), 0, len(person) - 1)
            near |= (np.abs(person[at] - hit) <= NEAR) & (doc[person[at]] == doc[hit])
    hits = sums(doc[hit], n)
    inside = np.zeros(len(data), bool)
    if len(data) > 2:
        letter = LETTERS[data]
        inside[1:-1] = DISGUISE[data[1:-1]] & letter[:-2] & letter[2:]
        tripled = np.flatnonzero((low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & letter[2:])
    else:
        tripled = np.zeros(0, int)
    of = lambda at: sums(np.searchsorted(starts, at, "right") - 1, n)
    uppers = np.concatenate(([0], np.cumsum(CODE[data] == 1)))
    shout = (uppers[stop] - uppers[begin]) == np.maximum(stop - begin, 2)
    return np.column_stack([
        hits / words, np.log1p(hits), sums(doc[hit], n, weight[hit]) / words, strongest,
        np.log1p(sums(doc[hit], n, weight[hit])), sums(doc[person], n) / words, sums(doc[hit][near], n) / np.maximum(hits, 1),
        kinds[:, 1] / size, sums(doc[shout], n) / words, kinds[:, 4] / size, kinds[:, 5] / size, kinds[:, 6] / size,
        of(np.flatnonzero(inside)) / words, of(tripled) / words, np.log1p(sums(doc, n))])


def rows_of_units(hashed: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units (0 is none) in ascending order, in how many texts each occurs, and in how many with ``y``; ``doc`` ascends."""
    some = np.flatnonzero(hashed)
    some = some[np.argsort(hashed[some], kind="stable")]
    unit, doc = hashed[some], doc[some]
    new = np.ones(len(unit), bool)
    new[1:] = unit[1:] != unit[:-1]
    once = new.copy()
    once[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new[once])
    pos = np.add.reduceat(y[doc[once]], at) if len(at) else np.zeros(0, np.int64)
    return unit[new], np.diff(at, append=np.count_nonzero(once)), pos


def learn_lexicon(train: DataFrame) -> Lexicon:
    """``train(text, y)``, bounded. Units are counted on the cluster; at most LEXICON of them reach the driver."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE_BYTES):
            data, starts = text_bytes(batch["text"])
            begin, _, hashed, _ = units(data, starts)
            doc = np.searchsorted(starts, begin, "right") - 1
            y = batch["y"].to_numpy().astype(np.int64)
            for row in hashed:
                unit, n, pos = rows_of_units(row, doc, y)
                yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(n), pa.array(pos)], ["unit", "n", "pos"])

    size, toxic = train.agg(F.count("*"), F.sum("y")).first()
    if not size or not toxic or toxic == size:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    odds = F.log((F.col("pos") + 0.5) / (F.lit(float(toxic)) + 1)) - F.log((F.col("n") - F.col("pos") + 0.5) / (F.lit(float(size - toxic)) + 1))
    found = (train.mapInArrow(counted, "unit long, n long, pos long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
             .filter(F.col("pos") >= LEAST_ROWS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
             .filter(F.col("pos") * F.log(F.col("pos") / F.col("n") * (size / toxic)) >= LEAST_SURPRISE)
             .orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "unit").limit(LEXICON).collect())
    return Lexicon(np.array([r.unit for r in found], np.int64).astype(np.uint64), np.array([r.odds for r in found]))


def calibrated(train: DataFrame, raw: Column) -> np.ndarray:
    """Isotonic rates of the trees' probabilities in fixed bins."""
    rows = train.select(F.least(F.floor(raw * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), "y").groupBy("bin").agg(
        F.count("*").alias("n"), F.sum("y").alias("pos")).collect()
    total, positive = np.zeros(BINS), np.zeros(BINS)
    for r in rows:
        total[r.bin], positive[r.bin] = r.n, r.pos
    return isotonic(total, positive)


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs(doc_id, text)``.

    ``labels(doc_id, toxic)``: rows with a null label or doc_id are not learned from, nor are the
    held-out ones (crc32 of the doc_id modulo 3 is 1; a null doc_id counts as held out); of rows that
    share a doc_id one is learned from, as toxic if any of its labels says so. Null and
    empty texts have a score like any other; when labels of both kinds are missing each score is the
    share of toxic rows (0 without labels); an empty table gives no rows; other columns are ignored.
    """
    # Workers import this module too, and these hold 30 MB (pandas is among them).
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.filter("toxic is not null").filter(remainder("doc_id", 3) != 1).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    size = max(known.count(), 1)
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < min(1.0, sample / size) * (1 << 20))
    train = stored(docs.join(F.broadcast(known), "doc_id").select(  # known: about `sample` ids at most
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), "y").dropDuplicates(["doc_id"]), "toxicity-sample")
    lexicon, second = learn_lexicon(train), hashes_of(SECOND_PERSON)
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(True)).alias("held_out")
    size, toxic = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic or toxic == size:
        rate = F.lit(float(toxic / size) if size else 0.0)
        return docs.select("doc_id", held_out, rate.alias("score")).withColumn("predicted", verdict())

    ranked = stored(features(train, lambda texts: measure(texts, lexicon, second), "toxicity-sample-features").join(
        train.select("doc_id", "y"), "doc_id").select(array_to_vector("f").alias("f"), F.col("y").cast("double").alias("y")).coalesce(4), "toxicity-fit")
    trees = GBTClassifier(featuresCol="f", labelCol="y", maxIter=15, maxDepth=4, stepSize=0.3, maxBins=64, seed=5,
                          minInstancesPerNode=5).fit(ranked)
    raw = vector_to_array("probability")[1]
    rates = calibrated(trees.transform(ranked), raw)
    steps = F.array(*[F.lit(float(x)) for x in rates])
    scored = trees.transform(features(docs, lambda texts: measure(texts, lexicon, second), "toxicity-features").select("doc_id", array_to_vector("f").alias("f")))
    return scored.select("doc_id", held_out, F.element_at(steps, F.least(F.floor(raw * BINS), F.lit(BINS - 1)).cast("int") + 1).alias("score")).withColumn("predicted", verdict())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
