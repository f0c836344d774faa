"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.ranking import written


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the least node reachable.

    Large and small stars in turn: every node hands its larger neighbours, then its smaller ones and itself, to the
    least of them, until all hang on one centre. Rounds grow with the logarithm of the longest chain. The least neighbour is
    combined before the shuffle, and each round is written to the shared folder, so a hub costs no list and a lost executor one round. Nulls,
    loops and repeated edges don't count.
    """
    pairs = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    if pairs.isEmpty():
        return pairs.toDF("node", "component")
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = both.join(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "u")
        large = written(hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        star = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        after = written(star.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct())
        pairs = after
        # settled: every node hangs on one centre, and no centre hangs
        ends = after.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(after.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            centres = after.select(F.col("v").alias("node")).distinct()
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres.withColumn("component", F.col("node")))
    raise RuntimeError("connected components: more rounds are needed")
