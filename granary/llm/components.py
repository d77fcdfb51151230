"""Connected components of an edge table, in joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import removed, stored


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Large-star and small-star steps (Kiveris et al., 2014) turn the edges into stars in a
    logarithmic number of rounds. Each step is one minimum per node, summed in the map tasks,
    and one equi join; a node of very many neighbours is split by adaptive execution. Every
    round is written to the shared folder, so a lost executor repeats one round at most.
    """
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lower.select("u", F.col("m").alias("v"))
        ).distinct()
        before, edges = edges, stored(small, label)
        removed(before)
        # Done when the edges are stars: one edge a node, and no root has an edge of its own.
        several = edges.groupBy("u").count().where("count > 1")
        chained = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if several.isEmpty() and chained.isEmpty():
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    out.stored_at = edges.stored_at  # to be removed once it has been read
    return out
