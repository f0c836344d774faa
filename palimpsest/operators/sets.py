"""Sets of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_by_alias(rows: DataFrame, aliases: DataFrame, name: str, text: str, order: str) -> DataFrame:
    """(name, text) with names put in their canonical form (aliases: alias, canonical) and the longest text of each kept; of equal lengths the first by `order`."""
    canonical = rows.join(aliases, F.col(name) == F.col("alias"), "left").withColumn(name, F.coalesce("canonical", F.col(name)))
    best = F.min(F.struct((-F.length(text)).alias("shorter"), F.col(order), F.col(text))).alias("_b")
    return canonical.groupBy(name).agg(best).select(name, F.col(f"_b.{text}").alias(text))
