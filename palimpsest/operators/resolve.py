"""Entity resolution by exact keys."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.operators.graphs import connected_components
from palimpsest.operators.ranking import written


@F.pandas_udf(StringType())
def _decomposed(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKD without combining marks; Spark has no such function."""
    for x in names:
        yield x.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def name_key(name: Column) -> Column:
    """Letters and digits in lower case, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(_decomposed(name)), r"[^\p{L}\p{N}]+", " "))


def domain_key(domain: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(domain)), r"^[a-z]+://", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, r"[/?#:].*$", ""), r"^www\.", ""), F.lit(""))


def handle_key(handle: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(handle)), "^@+", ""), F.lit(""))


def with_keys(df: DataFrame, name: str = "name", domain: str = "domain", handle: str = "handle") -> DataFrame:
    return df.withColumns({"name_key": name_key(F.col(name)), "domain_key": domain_key(F.col(domain)), "handle_key": handle_key(F.col(handle))})


def _unique(spine: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The least person of each key."""
    return spine.dropna(subset=keys).groupBy(*keys).agg(F.min("person_id").alias(out))


def _compatible(spine: DataFrame) -> DataFrame:
    """For each name the people of it, counted and the least told: all, those without a handle, without a domain, without both. A row that the handle, and name and domain, didn't match can only go with such as these."""
    bare = {"both": F.lit(True), "no_handle": F.col("handle_key").isNull(), "no_domain": F.col("domain_key").isNull(), "neither": F.col("handle_key").isNull() & F.col("domain_key").isNull()}
    return spine.filter("name_key <> ''").groupBy("name_key").agg(*[F.struct(F.countDistinct(F.when(c, F.col("person_id"))).alias("n"), F.min(F.when(c, F.col("person_id"))).alias("id")).alias(f"_{w}") for w, c in bare.items()])


def resolve_entities(rows: DataFrame, spine: DataFrame, aliases: DataFrame) -> DataFrame:
    """(row_id, person_id, matched_on) for a batch of keyed rows (row_id, given_id, name_key, domain_key, handle_key).

    In this order: the given id, an alias, the handle, name and domain, the name alone where exactly one person of it
    is compatible (no other handle and no other domain than the row's). Rows that match nothing are new: they are one person if a chain
    of shared handles, or of shared names with domains, joins them, however long (new ids are `new:` and the least key, handles first). A
    new row of a name alone goes with the one new person of that name that is joined by other keys, if there is just
    one, else with the others of the name alone; a row without any key is a person of its own. Matching is exact, and
    a batch is resolved as a whole: the order of its rows doesn't matter.

    Keys, not rows, are joined into components, each pair of keys once, so a handle on a third of the rows is one node.
    """
    out = (
        rows.join(spine.select(F.col("person_id").alias("given_id"), F.col("person_id").alias("_by_id")), "given_id", "left")
        .join(aliases.groupBy("name_key").agg(F.min("person_id").alias("_by_alias")), "name_key", "left")
        .join(_unique(spine, ["handle_key"], "_by_handle"), "handle_key", "left")
        .join(_unique(spine, ["name_key", "domain_key"], "_by_both"), ["name_key", "domain_key"], "left")
        .join(_compatible(spine), "name_key", "left")
    )
    no_handle, no_domain = F.col("handle_key").isNull(), F.col("domain_key").isNull()
    fits = F.when(no_handle & no_domain, F.col("_both")).when(no_handle, F.col("_no_domain")).when(no_domain, F.col("_no_handle")).otherwise(F.col("_neither"))
    out = out.withColumn("_by_name", F.when(fits["n"] == 1, fits["id"]))
    steps = [("_by_id", "id"), ("_by_alias", "alias"), ("_by_handle", "handle"), ("_by_both", "name_domain"), ("_by_name", "name")]
    on = reduce(lambda c, s: c.when(F.col(s[0]).isNotNull(), s[1]), steps[1:], F.when(F.col("_by_id").isNotNull(), "id")).otherwise("new")
    handle, both = F.concat(F.lit("@"), "handle_key"), F.concat(F.lit("|"), F.col("name_key"), F.lit("|"), F.col("domain_key"))
    met = written(out.select("row_id", "name_key", F.coalesce(*[F.col(c).cast("string") for c, _ in steps]).alias("_met"), on.alias("matched_on"), handle.alias("_h"), both.alias("_b")))
    new = met.filter(F.col("_met").isNull())
    joined = connected_components(new.filter(F.col("_h").isNotNull() & F.col("_b").isNotNull()).select("_h", "_b"), "_h", "_b")
    met = met.withColumn("_key", F.when(F.col("_met").isNull(), F.coalesce("_h", "_b"))).join(joined.select(F.col("node").alias("_key"), "component"), "_key", "left").withColumn("_own", F.coalesce("component", "_key"))
    named = met.filter(F.col("_own").isNotNull() & (F.col("name_key") != "")).groupBy("name_key").agg(F.min("_own").alias("_first"), F.max("_own").alias("_last")).filter("_first = _last").select("name_key", F.col("_first").alias("_by_new"))
    alone = F.when(F.col("name_key") != "", F.concat(F.lit("|"), F.col("name_key"))).otherwise(F.concat(F.lit("#"), F.col("row_id").cast("string")))
    fresh = F.concat(F.lit("new:"), F.coalesce("_own", "_by_new", alone))
    return met.join(named, "name_key", "left").select("row_id", F.coalesce("_met", fresh).alias("person_id"), "matched_on")


def alias_rows(resolved: DataFrame, rows: DataFrame, spine: DataFrame, aliases: DataFrame) -> DataFrame:
    """(person_id, name_key) of names by which known people were met and that aren't known yet."""
    met = resolved.filter("matched_on <> 'new'").join(rows.select("row_id", "name_key"), "row_id").filter("name_key <> ''").select("person_id", "name_key").distinct()
    known = spine.select(F.col("person_id").cast("string").alias("person_id"), "name_key").unionByName(aliases.select(F.col("person_id").cast("string").alias("person_id"), "name_key"))
    return met.join(known.distinct(), ["person_id", "name_key"], "left_anti")


def resolve_org(rows: DataFrame, orgs: DataFrame) -> DataFrame:
    """(row_id, org_id, matched_on): by id, then domain, then exact name; null where none fits."""
    by = lambda k, out: orgs.dropna(subset=[k]).groupBy(k).agg(F.min("org_id").alias(out))
    out = rows.join(orgs.select(F.col("org_id").alias("given_id"), F.col("org_id").alias("_i")), "given_id", "left").join(by("domain_key", "_d"), "domain_key", "left").join(by("org_name", "_n"), "org_name", "left")
    return out.select("row_id", F.coalesce("_i", "_d", "_n").alias("org_id"), F.when(F.col("_i").isNotNull(), "id").when(F.col("_d").isNotNull(), "domain").when(F.col("_n").isNotNull(), "name").otherwise("none").alias("matched_on"))
