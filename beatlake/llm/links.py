"""Connected components of a table of links, for the operators on near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatlake.llm._shared import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component (its least node) of all nodes of links (a, b), by large-star and small-star rounds.

    Each round is two aggregations; a centre with very many links only meets them in a minimum, which tasks combine before
    the shuffle, and in a join whose other side has one row for each node. The number of rounds grows with the logarithm
    of the longest chain.
    """
    now = scratch.table(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = scratch.table(both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("of"), F.least("m", "of").alias("m")))
        # Large star: greater neighbours of a node link to the least of its neighbours and itself.
        large = both.join(least, F.col("hi") == F.col("of")).filter(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        large = scratch.table(large)
        # Small star: lesser neighbours of a node and itself link to the least of them.
        lesser = scratch.table(large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "of"))
        small = large.join(lesser, F.col("hi") == F.col("of")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(lesser.select(F.col("of").alias("hi"), F.col("m").alias("lo")))
        small = scratch.table(small.filter("hi <> lo").distinct())
        found = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        scratch.drop(now, least, large, lesser)
        now = small
        if found == state:
            break
        state = found
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
