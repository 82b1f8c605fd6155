"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A record is a window of an item: 10 consecutive words, or the whole of a shorter item. Its set holds
its shingles of 5 words (of all its words, if fewer), each at its place. A document contains the
window only if it contains every shingle, so one shingle, the rarest over all documents, is a
sufficient prefix:

1. Each document is turned into its shingles with positions, and at once only those that occur in
   some window stay (a join with the items' distinct shingles; broadcast if their number is small
   enough, else shuffled). What stays is written once; all later steps read it.
2. Shingles are ordered by how often they occur in the documents; a window with one that never
   occurs is out, every other window is looked up by its rarest shingle.
3. Where that occurs, the window could begin ``offset`` words before: the positional bound keeps
   beginnings at or after word 0, the length bound those whose last word is inside the document.
4. Each candidate is verified: all shingles of the window at their places, compared as words.
5. Hit words are the union of the windows' places, by a running maximum over a document's hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veritab.llm.common import ascii_lower, stored, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 5
#: A side of a join is broadcast up to this many rows of at most a few dozen words each.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased words; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def shingles(own: str, length: int) -> Column:
    """(pos, shingle) for each run of ``length`` words of the array column ``own``."""
    at = lambda i, k: F.get(F.col(own), i + k)
    run = lambda i: F.struct(
        i.cast("int").alias("pos"), F.concat_ws(" ", *[at(i, k) for k in range(length)]).alias("shingle"))
    none = F.array().cast("array<struct<pos:int,shingle:string>>")
    return F.when(F.size(own) >= length, F.transform(F.sequence(F.lit(0), F.size(own) - length), run)).otherwise(none)


def small(df: DataFrame) -> DataFrame:
    """A stored side, marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, win (words joined by a blank), len: each distinct window of each item."""
    own = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    return own.select("item_id", length.alias("len"), F.explode(F.transform(
        F.sequence(F.lit(0), F.size("w") - length), lambda i: F.array_join(F.slice("w", i + 1, length), " "))).alias("win")).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs(doc_id, text)``.

    ``items(item_id, text)``. Null texts have no words; items without words have no windows and hit
    nothing; items that share an id count once, items with a null id hit words but are not listed;
    rows with equal or null doc_id stay rows of their own; other columns are ignored; empty tables
    give no rows (documents) or no hits (items).
    """
    wins = stored(windows(items, window), "item-windows")
    by_length = F.least(F.col("len"), F.lit(shingle))
    lengths = sorted(r.k for r in wins.select(by_length.alias("k")).distinct().collect())  # at most `shingle` values
    parts = wins.select("win", "len").distinct().withColumn("w", F.split("win", " "))
    pieces = F.array().cast("array<struct<pos:int,shingle:string>>")
    for k in lengths:
        pieces = F.when(by_length == k, shingles("w", k)).otherwise(pieces)
    wanted = stored(parts.select("win", "len", F.inline(pieces)).withColumnRenamed("pos", "offset"), "item-shingles")
    vocabulary = small(stored(wanted.select("shingle").distinct(), "shingle-vocabulary"))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "w")
    mark = F.array(F.struct(F.lit(-1).alias("pos"), F.concat(F.lit("\u0000"), F.col("row").cast("string")).alias("shingle")))
    placed = own.select("row", "doc_id", F.size("w").cast("long").alias("n_words"),
                        F.inline(F.concat(mark, *[shingles("w", k) for k in lengths])))
    kept = stored(placed.join(vocabulary.withColumn("known", F.lit(True)), "shingle", "left")
                  .filter((F.col("pos") < 0) | F.col("known")).drop("known"), "shingle-hits")
    base = kept.filter("pos < 0").select("row", "doc_id", "n_words")
    hits = kept.filter("pos >= 0").select("row", "pos", "shingle", "n_words")

    rarity = hits.groupBy("shingle").agg(F.count("*").alias("df"))
    prefix = wanted.join(rarity, "shingle", "left").groupBy("win", "len").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "shingle")).alias("rarest"), F.count("*").alias("shingles")
    ).filter("rarest.df > 0").select("win", "len", "shingles", "rarest.offset", "rarest.shingle")
    prefix = small(stored(prefix, "window-prefixes"))
    candidates = hits.join(prefix, "shingle").withColumn("begin", F.col("pos") - F.col("offset")).filter(
        (F.col("begin") >= 0) & (F.col("begin") + F.col("len") <= F.col("n_words"))).select("row", "begin", "win", "len", "shingles")
    expected = candidates.join(small(wanted).select("win", "offset", "shingle"), "win").withColumn("pos", F.col("begin") + F.col("offset"))
    found = stored(expected.join(hits.select("row", "pos", "shingle"), ["row", "pos", "shingle"])
                   .groupBy("row", "begin", "win", "len", "shingles").agg(F.count("*").alias("n"))
                   .filter("n = shingles").select("row", "begin", "win", "len"), "window-occurrences")

    order = Window.partitionBy("row").orderBy("begin", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("begin") + F.col("len")
    hit = found.select("row", "begin", "len").distinct().withColumn("before", F.coalesce(F.max(end).over(order), F.lit(0))).groupBy("row").agg(
        F.sum(F.greatest(end - F.greatest("begin", "before"), F.lit(0))).cast("long").alias("n_hit"))
    listed = found.select("row", "win").distinct().join(small(wins).select("win", "item_id"), "win").groupBy("row").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"))
    no_items = F.array().cast("array<string>")
    return base.join(hit, "row", "left").join(listed, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", no_items)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", no_items), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS l, array_to_string(w[s + 1 : s + least({WINDOW}, len(w))], ' ') AS win
       FROM (SELECT *, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, l, array_to_string(w[s + 1 : s + l], ' ') AS win
       FROM (SELECT *, unnest(range(0, len(w) - l + 1)) AS s FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
hits AS (SELECT DISTINCT doc_id, item_id, s, l FROM dw JOIN iw USING (win, l)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hits) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
