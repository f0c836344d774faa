"""Audits: each gives the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks. A rule is a condition that must hold; one that is null holds, as a CHECK does."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def absence_charged(df: DataFrame, kind: str = "kind", expected: str = "expected", delta: str = "delta") -> DataFrame:
    """Rows that charge for an absence that was not expected; there must be none."""
    return df.filter((F.col(kind) == "expected_absent") & ~F.col(expected) & (F.col(delta) != 0))


def schema_drift(df: DataFrame, name: str, expected: list[str]) -> DataFrame:
    """(table_name, column_name, drift): expected columns that are missing, and extra ones."""
    have = set(df.columns)
    rows = [(name, c, "missing") for c in expected if c not in have] + [(name, c, "extra") for c in df.columns if c not in expected]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, drift string")


def changed_states(stored: DataFrame, computed: DataFrame, key: str, stored_state: str, state: str) -> DataFrame:
    """(key, stored, recomputed) where they differ; rows without a computed state count as differing."""
    return stored.select(key, F.col(stored_state).alias("stored")).join(computed.select(key, F.col(state).alias("recomputed")), key, "left").filter(~F.col("stored").eqNullSafe(F.col("recomputed")))


def monotone(counts: DataFrame, order: str, n: str) -> DataFrame:
    """counts with `grows`: more than at the instant before. counts is one row an instant."""
    before = F.lag(n).over(Window.orderBy(order))
    return counts.withColumn("grows", F.coalesce(F.col(n) > before, F.lit(True)))


def values_without_n(df: DataFrame, quantities: list[str]) -> DataFrame:
    """(quantity, n_without): values of each x whose x_n is missing."""
    wide = df.agg(*[F.count_if(F.col(q).isNotNull() & F.col(f"{q}_n").isNull()).alias(q) for q in quantities])
    return wide.unpivot([], quantities, "quantity", "n_without")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key is set and not in the parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_parent")).distinct(), F.col(key) == F.col("_parent"), "left_anti")
