"""Connected components of a table of links, in joins and partial aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kilnflow.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b) of longs, in any order and with repeats. Returns (node, root): root is the least node reachable.

    Each round hangs every larger neighbour below the least one and then every
    smaller neighbour likewise, until the links form stars. Rounds grow with
    the logarithm of the longest path; every round's links are written to the
    shared folder. Minima are aggregated before the shuffle, and the join that
    follows may be split by Spark where one node has very many links.
    """
    oriented = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, mark = cut(oriented(edges), "links"), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = oriented(both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(down, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        links = cut(oriented(small), "links")
        seen = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if seen == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
        mark = seen
