"""Connected components of a graph given as rows (a, b) of longs.

Alternating large-star and small-star steps: each lets every node link its
neighbours to the least node known nearby, which needs a minimum per node (combined
map-side) and an equi-join that salts nodes of very many edges.
Each round is written to the shared checkpoint folder, and the loop ends when a
round changes nothing; nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, discard, salted_join


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges: (a, b) with a > b, about ``total`` rows.  New edges (a, b), a > b, of a large or small star step."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        linked = salted_join(both, least, ["a"], ["b"], 2 * total).where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = salted_join(edges, least, ["a"], ["b"], total)
        linked = joined.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return linked.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; a component is named by its least node.

    Self-loops, repeated and null edges change nothing (a node seen in those only
    is left out).
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = checkpoint(now), None
    total = now.count()
    while True:
        wide = checkpoint(_stars(now, True, total), "stars")
        before, now = now, checkpoint(_stars(wide, False, total), "stars")
        discard(wide)
        discard(before)
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if seen == tuple(mark):
            break
        seen, total = tuple(mark), mark[0]
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
