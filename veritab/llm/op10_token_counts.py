"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A rollup is a folder of the shared store:

* ``commits``: one row per committed batch, naming the folders its data are in;
* for each batch, ``counts``: the counts of the documents it touched as they are after it (null when
  deleted), and ``totals``: the totals after it.

A batch says which documents are inserted, deleted or counted anew. Its signed deltas are the new
counts minus those in force (found by joining the batch, not the corpus, with earlier batches) and are
added to the totals. Data are written first, under a folder of their own; the row in ``commits`` is
the commit. A batch whose id is committed already is left alone, so a repeated delivery or a restart
after a lost driver changes nothing; what an attempt without commit wrote is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritab.llm.common import table
from veritab.sources.scratch import scratch_path

KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
COUNTS = "doc_id long, tokenizer string, source string, lang string, n_tokens long, alive boolean, seq long"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
INSERT, DELETE, REVISE = "insert", "delete", "revise"


class TokenRollup:
    """Totals over all batches committed under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], "batch string, folder string, seq long").write.mode("ignore").parquet(f"{self.path}/commits")

    def commits(self) -> list[tuple[str, str, int]]:
        """(batch, folder, seq) in order; one row a batch."""
        rows = self.spark.read.schema("batch string, folder string, seq long").parquet(f"{self.path}/commits").collect()
        return sorted({r.batch: (r.batch, r.folder, r.seq) for r in rows}.values(), key=lambda c: c[2])

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of groups that still have documents."""
        done = self.commits()
        if not done:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{done[-1][1]}/totals").filter("n_docs <> 0")

    def counts(self, touched: DataFrame | None = None) -> DataFrame:
        """The counts in force; with ``touched``, only of its (doc_id, tokenizer)."""
        done = self.commits()
        if not done:
            return self.spark.createDataFrame([], COUNTS)
        log = self.spark.read.schema(COUNTS).parquet(*[f"{folder}/counts" for _, folder, _ in done])
        if touched is not None:
            log = log.join(touched.select(*KEY).distinct(), KEY, "left_semi")
        last = log.groupBy(*KEY).agg(F.max(F.struct("seq", "source", "lang", "n_tokens", "alive")).alias("x"))
        return last.select(*KEY, "x.source", "x.lang", "x.n_tokens", "x.alive", "x.seq").filter("alive")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies ``changes(op, doc_id, tokenizer, source, lang, n_tokens)`` once; False if it was committed before.

        insert and revise set a document's count (an insert of a known document revises it); delete
        takes it out, and does nothing to an unknown one. Among several changes to a document in a
        batch deletes come last, then higher counts win. Null counts are 0; a null source or lang is
        a group of its own; rows without doc_id, tokenizer or a known op raise. Other columns are
        ignored, and an empty batch commits with no effect.
        """
        done = self.commits()
        if any(b == batch for b, _, _ in done):
            return False
        seq, folder = len(done), f"{self.path}/{uuid.uuid4().hex}"
        known = F.col("op").isin(INSERT, DELETE, REVISE) & F.col("doc_id").isNotNull() & F.col("tokenizer").isNotNull()
        bad = F.raise_error(F.concat(F.lit("not a change: "), F.coalesce(F.concat_ws(" ", "op", "doc_id", "tokenizer"), F.lit("null"))))
        checked = changes.select(
            F.when(F.coalesce(known, F.lit(False)), F.col("op")).otherwise(bad.cast("string")).alias("op"),
            F.col("doc_id").cast("long").alias("doc_id"), F.col("tokenizer").cast("string").alias("tokenizer"),
            F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
            F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
        one = checked.groupBy(*KEY).agg(F.max(F.struct((F.col("op") == DELETE).alias("gone"), "n_tokens", "source", "lang")).alias("x"))
        new = one.select(*KEY, "x.source", "x.lang", "x.n_tokens", (~F.col("x.gone")).alias("alive"), F.lit(seq).cast("long").alias("seq"))
        new.write.parquet(f"{folder}/counts")
        new = self.spark.read.schema(COUNTS).parquet(f"{folder}/counts")

        def signed(counts: DataFrame, sign: int) -> DataFrame:
            return counts.select(*GROUP, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"))

        deltas = signed(new.filter("alive"), 1).unionByName(signed(self.counts(new), -1))
        before = self.spark.read.schema(TOTALS).parquet(f"{done[-1][1]}/totals") if done else self.spark.createDataFrame([], TOTALS)
        deltas.unionByName(before).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{folder}/totals")
        self.spark.createDataFrame([(batch, folder, seq)], "batch string, folder string, seq long").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True


def n_matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))).cast("long")


# The tokenizer versions of the query: words between blanks; words and marks; words split at apostrophes.
BLANK_WORDS, WORDS_AND_MARKS, NO_APOSTROPHES = r"[^ \t\n\r]+", r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]", r"[^ \t\n\r']+"


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after six deliveries about all documents, two of them repeated.

    Inserts of all documents under two tokenizer versions; French documents counted anew under the
    first, with words split at apostrophes; documents labelled as of low quality deleted.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    own = docs.filter("doc_id is not null").select("doc_id", "source", "lang", "text")

    def change(op: str, version: str, rows: DataFrame, pattern: str | None) -> DataFrame:
        n = n_matches(F.col("text"), pattern) if pattern else F.lit(None).cast("long")
        return rows.select(F.lit(op).alias("op"), "doc_id", F.lit(version).alias("tokenizer"), "source", "lang", n.alias("n_tokens"))

    first = change(INSERT, "words-1", own, BLANK_WORDS)
    second = change(INSERT, "marks-1", own, WORDS_AND_MARKS)
    anew = change(REVISE, "words-1", own.filter("lang = 'fr'"), NO_APOSTROPHES)
    poor = own.select("doc_id", "source", "lang").join(labels.filter("quality = 0").select("doc_id"), "doc_id", "left_semi")
    gone = change(DELETE, "words-1", poor, None).unionByName(change(DELETE, "marks-1", poor, None))
    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    for batch, changes in (("load", first), ("marks", second), ("load", first), ("french", anew), ("poor", gone), ("french", anew)):
        rollup.commit(batch, changes)
    return rollup.totals()


ORACLE = rf"""
WITH kept AS (SELECT * FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)),
n AS (SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(coalesce(text, ''),
             CASE WHEN lang = 'fr' THEN '[^ \t\n\r'']+' ELSE '[^ \t\n\r]+' END)) AS n FROM kept
      UNION ALL SELECT source, lang, 'marks-1', len(regexp_extract_all(coalesce(text, ''),
             '[A-Za-z0-9\x{{80}}-\x{{10FFFF}}]+|[!-/:-@\[-`{{-~]')) FROM kept)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM n GROUP BY ALL
"""
