"""Connected components of a distributed set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostelry.functions.storage import cut


def dealt_anew(rows: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """The inner join of ``rows`` with an aggregation of them by the same long ``key``.

    Both sides join on the key's complement, so neither stays where the aggregation
    left it, and adaptive execution can split a key that very many rows have.
    """
    turned = least.withColumn("_turned", F.bitwise_not(F.col(key))).drop(key)
    return rows.join(turned, F.bitwise_not(rows[key]) == F.col("_turned")).drop("_turned")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes. Each step
    is one aggregation and one join on a node: a node with very many links is
    pre-aggregated, and in the join adaptive execution splits it. Nothing is
    collected but a count and a checksum.
    """
    edges = cut(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct()
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = dealt_anew(both, least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where(F.col("v") != F.col("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = dealt_anew(large, least, "v")
        small = small.select("v", F.col("m").alias("u")).union(small.select(F.col("u"), F.col("m")))
        edges = cut(small.where(F.col("v") != F.col("u")).distinct())
        before, now = now, state(edges)
        if before == now:
            break
    nodes = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return nodes.union(edges.select("u", "u").distinct())
