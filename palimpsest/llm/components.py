"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import remove, scratch


def _smallest_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and its neighbours. The minimum is pre-aggregated; the join may be dealt anew if u is hot."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _held(pairs: DataFrame) -> tuple[DataFrame, str]:
    """Pairs written to the shared folder, so that plans stay small and a lost executor costs one step."""
    spark = pairs.sparkSession
    path = scratch(spark, "stars")
    pairs.select("u", "v").write.parquet(path)
    return spark.read.schema("u long, v long").parquet(path), path


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge to another node; component is the least node reachable.

    Null ends and loops are no edges, repeated edges count once, and an empty table gives an empty
    result. Each round is written to the shared folder, so lineage never grows and a lost executor
    costs one round at most. Raises if max_rounds don't suffice (rounds grow with the logarithm of
    the longest chain).
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    old = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, large_path = _held(_smallest_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        star = _smallest_neighbour(large)
        # of each row (u, v, m): v and u itself go below m
        small = star.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        after, path = _held(small)
        remove(spark, large_path)
        # a star forest: every node has one centre, and no centre has a centre
        seen = after.select(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("c")).unionByName(after.select("v", F.lit(0), F.lit(1)).toDF("x", "a", "c").distinct())
        settled = seen.groupBy("x").agg(F.sum("a").alias("a"), F.sum("c").alias("c")).filter("a > 1 OR (a > 0 AND c > 0)").isEmpty()
        if old:
            remove(spark, old)
        now, old = after, path
        if settled:
            break
    else:
        raise RuntimeError("connected components: more rounds are needed")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
