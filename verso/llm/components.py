"""Connected components of a table of edges, by alternating large-star and small-star steps.

Nodes with one edge, to a smaller node, are leaves: they are set aside and take their neighbour's class at the end, so a hub with
ever so many of them meets them in a join only, whose large partitions Spark splits. What is left goes through the steps. Each
is an aggregation of neighbours to their minimum and a join back, so edges stay distributed; the number of steps grows with
the logarithm of the longest path. Each round is written to the shared folder, which cuts the lineage. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.cluster import dropped, stored


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): u's neighbours. Links each neighbour, and u itself, to the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").select("u", "v", "m")


def _done(now: DataFrame) -> bool:
    """Whether each node has one edge, to a node that has none."""
    ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x"))
    ends = ends.select("x.*").groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    return ends.where("ups > 1 OR ups = 1 AND n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b (nulls and loops are ignored). Returns (node, comp): for each node of an edge the least node that it reaches."""
    all_edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct())
    ends = all_edges.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count("*").alias("n"))
    ranked = stored(all_edges.join(ends, "u").select("u", "v", (F.col("n") == 1).alias("leaf")))
    dropped(all_edges)
    leaves, now = ranked.where("leaf").select("u", "v"), ranked.where("NOT leaf").select("u", "v")
    rounds = []
    while not _done(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = _star(large).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = stored(small)
        dropped(*rounds)
        rounds = [now]
    known = now.select(F.col("u").alias("v"), F.col("v").alias("comp"))
    hung = leaves.join(known, "v", "left").select("u", F.coalesce("comp", "v").alias("v"))
    found = stored(hung.unionByName(now))
    dropped(ranked, *rounds)
    roots = found.select(F.col("v").alias("node")).distinct()
    return found.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))
