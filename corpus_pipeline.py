"""A corpus from ``documents`` to packed sequences: five stages, each written and read again.

All but the last return the columns of documents. Rows with one doc_id are one document: a decision
about any of them holds for all; rows without doc_id can't be named and stay.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.llm.common import ARROW_BATCH, SMALL_BATCH, ship, stored, table, tokenizer_path
from veritab.llm.op2_decontamination import contamination
from veritab.llm.op5_toxicity import toxicity_scores
from veritab.llm.op6_packing import pack_documents
from veritab.llm.op7_suffix_dedup import without_repeats
from veritab.llm.op8_signature_join import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Near duplicates share 80 of 100 shingles of five words.
SHINGLE, SIMILARITY = 5, (80, 100)
#: Passages of over 50 words that occur elsewhere are cut out, also where they are shorter than op7's 400 bytes.
PASSAGE_WORDS = 51
#: Ids to leave out are broadcast up to this number (8 bytes each).
BROADCAST_IDS = 500_000
#: Bytes of an Arrow batch and rows of a Parquet reader's here, where the session doesn't say: executors keep memory from stage to stage.
STAGE_BATCH = "1048576b"
READER_ROWS, STAGE_ROWS = "spark.sql.parquet.columnarReaderBatchSize", "512"


def lean(spark: SparkSession) -> None:
    """Small batches of text for all stages, on both sides of the workers."""
    if spark.conf.get(ARROW_BATCH, None) in (None, SMALL_BATCH):
        spark.conf.set(ARROW_BATCH, STAGE_BATCH)
    if spark.conf.get(READER_ROWS, None) is None:
        spark.conf.set(READER_ROWS, STAGE_ROWS)


def without(docs: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """``docs`` without the documents in ``ids(doc_id)``."""
    ids = stored(ids.filter("doc_id is not null").distinct(), label)
    return docs.select(*COLUMNS).join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    lean(spark)
    scores = toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return without(docs, scores.filter("predicted = 1").select("doc_id"), "toxic-ids")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays; repeated rows are one."""
    lean(spark)
    groups = stored(near_duplicates(docs, SHINGLE, SIMILARITY).select("doc_id", "component_id"), "near-duplicates")
    kept = without(docs, groups.filter("doc_id <> component_id").select("doc_id"), "copies")
    again = stored(groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)
    return kept.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(once)


def rest_of_text(batch: pa.RecordBatch, kept: list[tuple]) -> pa.RecordBatch:
    """Texts without their repeats; characters that lost some of their bytes go with them. Null stays null."""
    lang, source, size, null = (batch["rest"].field(k) for k in range(4))
    texts = [None if none else rest.decode(errors="ignore") for (_, _, rest), none in zip(kept, null.to_pylist(), strict=True)]
    size = [len(text) if cuts else n for n, text, (_, cuts, _) in zip(size.to_pylist(), texts, kept, strict=True)]
    return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string()), lang, source, pa.array(size, pa.int64())], COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``PASSAGE_WORDS`` words and strings of 400 bytes that occur elsewhere are cut out; all documents stay."""
    lean(spark)
    typed = docs.select(*COLUMNS).withColumns({"n_chars": F.col("n_chars").cast("long"), "no_text": F.col("text").isNull()})
    return without_repeats(typed, rest_of_text, DOCUMENTS, ["lang", "source", "n_chars", "no_text"], words=PASSAGE_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    lean(spark)
    return without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id"), "contaminated-ids")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the ids of what is left lie in sequences."""
    lean(spark)
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: A classifier decides about the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
