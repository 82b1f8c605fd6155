"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veritab.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, label: each node of ``links(u, v)`` with the smallest node it is linked to by any path.

    Rounds of two steps: every node hands its larger neighbours its smallest one, then its smaller
    neighbours likewise. Sums and minima are taken before each shuffle, rounds are written to the
    shared folder, and the number of rounds grows with the logarithm of the longest path.
    """
    u, v = F.col("u"), F.col("v")
    edges = stored(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter(u != v).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(u.alias("node"), v.alias("label")).unionByName(edges.select(v.alias("node"), v.alias("label")).distinct())
