"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by its nearest pivots in order, and
posted in the inverted file of each of the first ``POSTED``. A query visits the files of its own first
``PROBED`` pivots; what it finds there is ranked by the footrule distance between the two orders (pivots
missing from an order count as standing right behind it), and the nearest ``KEPT`` are reranked by the
exact inner product.

* The index is dealt by a hash of the id into blocks of about ``BLOCK`` vectors, each with inverted
  files of its own, so a vector is kept once. The stated queries, in parts of ``PART``, visit all
  blocks; only a query's best few leave a block.
* The number of pivots grows with the root of the number of vectors, so a file's share falls.
* Equal vectors are one posting that carries the smallest ids of its group (as many as a result can
  hold), so copies neither fill a file nor multiply pairs.
* Where vectors differ in length, the index appends the missing length as one more coordinate, which
  makes largest inner products nearest directions.
* A query that meets fewer rows than it has to return is answered exactly, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from veritab.llm.common import ship, stored, table

NEAREST = 20
PIVOTS_PER_ROOT, MOST_PIVOTS = 8, 4096
ORDER, POSTED, PROBED, KEPT, BLOCK, PART = 96, 8, 96, 2000, 20_000, 2000
FOUND = "query long, gid long, score double, ids array<long>"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec: rows that take part, of the most common dimension."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vec"))
    big = F.lit(float("inf"))
    own = own.filter(
        F.col("vec_id").isNotNull() & F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)), F.lit(False))
        & F.exists("vec", lambda x: x != 0))
    common = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.filter(F.size("vec") == (common.n if common else 0))


def stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class Pivots:
    def __init__(self, vectors: np.ndarray, longest: float):
        self.longest = longest
        self.vectors = self.lengthened(vectors)

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest ** 2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest])

    def order(self, x: np.ndarray, query: bool) -> np.ndarray:
        """The nearest pivots of each vector, nearest first."""
        x = np.column_stack([x, np.zeros(len(x))]) if query else self.lengthened(x)
        near = x @ self.vectors.T
        n = min(ORDER, near.shape[1])
        part = np.argpartition(-near, n - 1, axis=1)[:, :n]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1).astype(np.int32)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def footrule(order: np.ndarray, others: np.ndarray, pivots: int) -> np.ndarray:
    """Distance of one order from each of the others; absent pivots stand right behind the end."""
    n = len(order)
    place = np.full(pivots, n, np.int16)
    place[order] = np.arange(n, dtype=np.int16)
    at = place[others]
    own = np.arange(n, dtype=np.int16)
    return (np.abs(at - own) + at).sum(1, dtype=np.int32) + (n * (n + 1) // 2 - n * n)


class Block:
    """A block's inverted files: for each pivot the rows posted there."""

    def __init__(self, orders: np.ndarray, pivots: int):
        self.orders, self.pivots = orders.astype(np.int16), pivots
        posted = orders[:, :POSTED]
        by_pivot = np.argsort(posted.ravel(), kind="stable")
        self.rows = by_pivot // posted.shape[1]
        self.at = np.searchsorted(posted.ravel()[by_pivot], np.arange(pivots + 1))

    def candidates(self, order: np.ndarray, gids: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(self.orders), bool)
        for p in order[:PROBED]:
            seen[self.rows[self.at[p]: self.at[p + 1]]] = True
        some = np.flatnonzero(seen)
        return some[best(-footrule(order, self.orders[some], self.pivots), gids[some], KEPT)]


def best(scores: np.ndarray, gids: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` highest scores, ties by smaller gid."""
    if len(scores) > most:
        edge = -np.partition(-scores, most - 1)[most - 1]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((gids[some], -scores[some]))][:most]


def nearest(vectors: DataFrame, every: int, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each row whose vec_id is divisible by ``every``.

    ``vectors(vec_id, embedding)``. Rows without vec_id, and vectors null, empty, zero, holding null or
    non-finite components or of another than the most common dimension take no part. Candidates are
    all other rows than the query's own vec_id; ties go to the smaller vec_id; repeated rows are
    candidates each. Fewer than k candidates are all returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(usable(vectors), "vectors")
    own = Window.partitionBy("vec").orderBy("vec_id")
    groups = stored(rows.withColumn("at", F.row_number().over(own)).filter(F.col("at") <= k + 1)
                    .groupBy("vec").agg(F.min("vec_id").alias("gid"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vector-groups")
    size, longest = groups.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()
    queries = rows.filter(F.col("vec_id") % every == 0)
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_pivots = min(MOST_PIVOTS, size, max(ORDER, math.ceil(PIVOTS_PER_ROOT * math.sqrt(size))))
    sample = groups.orderBy(F.xxhash64("gid"), "gid").limit(n_pivots).select("vec").collect()
    pivots = Pivots(np.array([r.vec for r in sample], float), longest)

    def ordered(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                orders = pivots.order(stack(batch["vec"]), query)
                yield pa.RecordBatch.from_arrays([batch["gid"], batch["vec"], batch["ids"], lists(orders, pa.int32())], ["gid", "vec", "ids", "order"])

    shape = "gid long, vec array<float>, ids array<long>, order array<int>"
    posted = stored(groups.select("gid", "vec", "ids").mapInArrow(lambda b: ordered(b, False), shape), "postings")
    asked = queries.select("vec").distinct().join(groups, "vec").select("gid", "vec", "ids")
    asked = stored(asked.mapInArrow(lambda b: ordered(b, True), shape), "queries")

    def in_blocks(queries: DataFrame, ask) -> DataFrame:
        """All blocks of the index against all parts of the queries."""
        n_blocks, n_parts = -(-size // BLOCK), max(1, -(-queries.count() // PART))
        block, part = (F.pmod(F.xxhash64("gid"), F.lit(n)).cast("int") for n in (n_blocks, n_parts))
        all_of = lambda n: F.explode(F.array(*[F.lit(i) for i in range(n)]))
        columns = ["gid", "vec", "order", "ids"]
        left = queries.select(part.alias("part"), *columns).select(all_of(n_blocks).alias("block"), "part", *columns)
        right = posted.select(block.alias("block"), *columns).select("block", all_of(n_parts).alias("part"), *columns)
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(ask, FOUND)

    def found(q: pa.Table, c: pa.Table, chosen) -> pa.Table:
        out = []
        if len(q) and len(c):
            x, y = stack(q["vec"].combine_chunks()), stack(c["vec"].combine_chunks())
            gids, ids = c["gid"].to_numpy(), c["ids"].combine_chunks()
            for i, query in enumerate(q["gid"].to_pylist()):
                some = chosen(i)
                scores = (y[some] * x[i]).sum(1)
                top = best(scores, gids[some], k + 1)
                take = some[top]
                out.append(pa.Table.from_arrays([pa.array(np.full(len(take), query)), pa.array(gids[take]), pa.array(scores[top]),
                                                 ids.take(pa.array(take))], ["query", "gid", "score", "ids"]))
        empty = pa.schema([("query", pa.int64()), ("gid", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
        return pa.concat_tables([t.cast(empty) for t in out]) if out else empty.empty_table()

    def visit(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return found(q, c, None)
        theirs, gids = stack(q["order"].combine_chunks()).astype(int), c["gid"].to_numpy()
        block = Block(stack(c["order"].combine_chunks()).astype(int), len(sample))
        return found(q, c, lambda i: block.candidates(theirs[i], gids))

    def answer(hits: DataFrame) -> DataFrame:
        """The k + 1 best rows of each distinct query vector."""
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        return (hits.dropDuplicates(["query", "gid"]).select("query", "score", F.explode("ids").alias("vec_id"))
                .withColumn("at", rank).filter(F.col("at") <= k + 1).drop("at"))

    answers = stored(answer(in_blocks(asked, visit)), "answers")
    total = rows.count()
    short = asked.join(answers.groupBy("query").count().filter(F.col("count") >= min(k + 1, total)).select(F.col("query").alias("gid")), "gid", "left_anti")
    short = stored(short, "short-queries")
    if not short.isEmpty():
        exact = in_blocks(short.select("gid", "vec", "order", "ids"), lambda q, c: found(q, c, lambda i: np.arange(len(c))))
        answers = answers.join(short.select(F.col("gid").alias("query")), "query", "left_anti").unionByName(answer(exact))

    whose = queries.join(groups.select("vec", F.col("gid").alias("query")), "vec").select("query", F.col("vec_id").alias("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (whose.distinct().join(answers, "query").filter("vec_id <> query_id").withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), 20)
