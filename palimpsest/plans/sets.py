"""I: set operations (I1 and I2 stand with their inputs)."""

from pyspark.sql import functions as F

from palimpsest.operators.ledger import append_missing
from palimpsest.operators.sets import dedupe_by_alias
from palimpsest.plans.registry import query


@query("i3_dedupe_by_alias", "SELECT name, arg_min(reason, (-length(reason), id)) AS reason FROM (SELECT coalesce(c, n) AS name, reason, id FROM (SELECT 'src' || (user_id % 60) AS n, substr(props || event_type || '.....', 1, CAST(8 + event_id % 9 AS BIGINT)) AS reason, event_id AS id FROM events) LEFT JOIN (SELECT 'src' || i AS a, 'src' || (i - 30) AS c FROM range(30, 60) t(i)) ON n = a) GROUP BY 1")
def by_alias(v):
    rows = v.table("events").select(F.concat(F.lit("src"), (F.col("user_id") % 60).cast("string")).alias("name"), F.expr("substr(concat(props, event_type, '.....'), 1, cast(8 + event_id % 9 AS int))").alias("reason"), F.col("event_id").alias("id"))
    aliases = v.spark.range(30, 60).select(F.format_string("src%d", "id").alias("alias"), F.format_string("src%d", F.col("id") - 30).alias("canonical"))
    return dedupe_by_alias(rows, aliases, "name", "reason", "id")


@query("i4_append_missing", "SELECT s_suppkey, s_name FROM supplier WHERE s_name NOT IN (SELECT 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') FROM customer WHERE c_custkey % 2 = 0) AND s_name NOT IN (SELECT 'Supplier#' || lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0') FROM customer WHERE c_custkey % 10 = 0)")
def missing(v):
    name = lambda c: F.concat(F.lit("Supplier#"), F.lpad(c.cast("string"), 9, "0"))
    held = v.table("customer").filter("c_custkey % 2 = 0").select(name(F.col("c_custkey")).alias("s_name"), F.when(F.col("c_custkey") % 10 == 0, F.array(name(F.col("c_custkey") + 1))).otherwise(F.array().cast("array<string>")).alias("also"))
    return append_missing(v.table("supplier").select("s_suppkey", "s_name"), held, "s_name", "also")
