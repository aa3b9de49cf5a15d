"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.tables import joined_back, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of ``edges`` (a, b) with the smallest node it reaches.

    Edges may repeat, point either way or join a node to itself; rows with a null end are ignored,
    and no edges give no rows. Every round is a grouped minimum and a join, and is written to the
    shared folder; nothing is collected but a checksum and two counts a round. A node with very many
    edges isn't gathered in one task.
    """
    pairs = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    pairs, before = written(pairs), None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")))
        total = least.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        large = joined_back(both.where("v > u"), least, "u", "n", total)
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        total = low.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        small = (
            joined_back(large, low, "u", "n", total)
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        pairs = written(small)
        after = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
