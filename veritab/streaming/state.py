"""Uniqueness over all batches of a stream, from a table of keys that grows with the batches.

The table says how many rows each key had so far and names its first row. It is dealt into buckets by
the key's hash; a batch reads and writes the buckets of its own keys only, into a folder of its own
version. The manifest of a batch names the current version and the counts of every bucket; writing it is
the commit. A batch that is repeated starts from the manifest before it and overwrites what it
left, so repeating changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from veritab.model import Check
from veritab.operators.uniqueness import keyed
from veritab.sources.scratch import numbered_folders

BUCKETS = 64
MANIFEST = "bucket int, version long, total_rows long, failed_rows long, duplicate_groups long, max_group_size long"


def manifest(spark: SparkSession, state: str, before: int | None = None) -> DataFrame:
    """The buckets after the last batch (before a batch): version and counts of each."""
    batches = [b for b in numbered_folders(spark, f"{state}/manifest", "batch_id") if before is None or b < before]
    if not batches:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{state}/manifest/batch_id={batches[-1]}")


def merge_batch(batch: DataFrame, batch_id: int, check: Check, refs: Sequence[str], out: str, state: str,
                buckets: int = BUCKETS) -> None:
    """Adds a batch to the key table and writes the rows it makes repeats to ``out/batch_id=N``.

    Those are the batch's own rows of repeated keys, and the first row of each key that was
    unique until now, as ``refs`` columns: over all batches, every member of every repeated key once.
    """
    spark = batch.sparkSession
    if check.filter:
        batch = batch.where(check.filter)
    rows = keyed(check, batch)
    names = [c for c in rows.columns if c.startswith("__k")]
    rows = rows.select(F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int").alias("bucket"), *names,
                       F.struct(*refs).alias("ref")).persist()
    try:
        counts = rows.groupBy("bucket", *names).agg(F.count("*").alias("new"), F.min("ref").alias("first"))
        held = manifest(spark, state, before=batch_id)
        versions = {r.bucket: r.version for r in held.collect()}  # a row a bucket
        touched = [r.bucket for r in counts.select("bucket").distinct().collect()]
        zero = F.lit(0).cast("long")
        keys = f"{state}/keys"
        merged = counts.select("bucket", *names, zero.alias("old"), "new", F.lit(None).cast("boolean").alias("was"), "first")
        paths = [f"{keys}/version={versions[b]}/bucket={b}" for b in touched if b in versions]
        if paths:
            known = spark.read.option("basePath", keys).schema(merged.drop("was", "bucket").schema).parquet(*paths)
            merged = merged.unionByName(known.select(
                F.col("bucket").cast("int").alias("bucket"), *names, (F.col("old") + F.col("new")).alias("old"), zero.alias("new"),
                F.lit(True).alias("was"), "first"))
        # The first row stays the one known before.
        merged = merged.groupBy("bucket", *names).agg(
            F.sum("old").alias("old"), F.sum("new").alias("new"), F.min_by("first", F.when(F.col("was"), 0).otherwise(1)).alias("first"))
        version = f"{keys}/version={batch_id}"
        merged.write.mode("overwrite").partitionBy("bucket").parquet(version)
        schema = T.StructType([*merged.drop("bucket").schema.fields, T.StructField("bucket", T.IntegerType())])
        merged = spark.read.schema(schema).parquet(version) if touched else spark.createDataFrame([], schema)

        n = F.col("old") + F.col("new")
        repeated = merged.where((n > 1) & (F.col("new") > 0))
        on = [F.col(c).eqNullSafe(F.col(f"{c}__r")) for c in names]
        theirs = repeated.select(*[F.col(c).alias(f"{c}__r") for c in names])
        earlier = repeated.where(F.col("old") == 1).select("first.*")
        (rows.join(theirs, on, "left_semi").select("ref.*").unionByName(earlier)
         .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}"))

        now = merged.groupBy("bucket").agg(
            F.sum(n).alias("total_rows"), F.sum(F.when(n > 1, n).otherwise(0)).alias("failed_rows"),
            F.count_if(n > 1).alias("duplicate_groups"), F.max(F.when(n > 1, n).otherwise(0)).alias("max_group_size"))
        now = now.withColumn("version", F.lit(batch_id).cast("long"))
        rest = held.where(~F.col("bucket").isin(touched)) if touched else held
        columns = [c.split()[0] for c in MANIFEST.split(", ")]
        now.select(*columns).unionByName(rest.select(*columns)).coalesce(1).write.mode("overwrite").parquet(
            f"{state}/manifest/batch_id={batch_id}")
    finally:
        rows.unpersist()


def unique_stream(stream: DataFrame, check: Check, refs: Sequence[str], out: str, state: str, checkpoint: str,
                  buckets: int = BUCKETS, trigger: dict | None = None) -> StreamingQuery:
    """A uniqueness check (exact, composite or scoped) over all batches of a stream. ``buckets`` stays the same for a state."""
    def run(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, check, refs, out, state, buckets)

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def counts_so_far(spark: SparkSession, state: str) -> DataFrame:
    """One row: total_rows, failed_rows, duplicate_groups, max_group_size over all batches."""
    zero = F.lit(0).cast("long")
    return manifest(spark, state).agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("total_rows", "failed_rows", "duplicate_groups")],
        F.coalesce(F.max("max_group_size"), zero).alias("max_group_size"))
