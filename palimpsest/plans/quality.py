"""D: audits (D2 and D4 stand with the claims)."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import quality as Q
from palimpsest.operators.temporal import asof_slices
from palimpsest.plans.registry import query

RULES = {
    "flag_known": "l_returnflag IN ('A', 'N')", "quantity_range": "l_quantity BETWEEN 2 AND 49", "discount_below_tax": "l_discount <= 0.08 OR l_tax > 0.01", "open_has_no_return": "NOT (l_linestatus = 'O' AND l_returnflag = 'R')",
}
ROW = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query("d1_constraint_violations", " UNION ALL ".join(f"SELECT {ROW} AS row_id, '{n}' AS rule FROM lineitem WHERE NOT ({r})" for n, r in RULES.items()))
def constraints(v):
    return Q.violations(v.table("lineitem").withColumn("row_id", F.expr(ROW)), "row_id", {n: F.expr(r) for n, r in RULES.items()})


EXPECTED = {"events": ["event_id", "ts", "user_id", "event_type", "value", "props", "channel"], "orders": ["o_orderkey", "o_custkey"]}


def _drift_sql(table: str, names: list[str]) -> str:
    have, want = f"(SELECT column_name AS c FROM (DESCRIBE {table}))", f"(SELECT unnest({names!r}) AS c)"
    return f"SELECT '{table}' AS table_name, c AS column_name, 'missing' AS drift FROM {want} WHERE c NOT IN {have} UNION ALL SELECT '{table}', c, 'extra' FROM {have} WHERE c NOT IN {want}"


@query("d3_schema_drift", " UNION ALL ".join(_drift_sql(t, names) for t, names in EXPECTED.items()))
def drift(v):
    """Columns of the driver's tables against those that the views read."""
    return reduce(DataFrame.unionByName, [Q.schema_drift(v.table(t), t, names) for t, names in EXPECTED.items()])


@query("d5_monotone_visibility", "SELECT days_before, n_visible, coalesce(n_visible > lag(n_visible) OVER (ORDER BY days_before DESC), TRUE) AS grows FROM (" + " UNION ALL ".join(f"SELECT CAST({d} AS BIGINT) AS days_before, count(*) FILTER (observed_at <= TIMESTAMP '2024-01-31' - INTERVAL {d} DAY) AS n_visible FROM observation" for d in (24, 16, 8, 0)) + ")")
def monotone(v):
    slices = asof_slices(v.observation(), "2024-01-31 00:00:00", [24, 16, 8, 0]).withColumn("at", -F.col("days_before"))
    return Q.monotone(slices, "at", "n_visible").select("days_before", "n_visible", "grows")


@query("d6_quantity_without_n", "SELECT 'edge' AS quantity, count(*) FILTER (edge IS NOT NULL AND edge_n IS NULL) AS n_without FROM q UNION ALL SELECT 'score', count(*) FILTER (score IS NOT NULL AND score_n IS NULL) FROM q", {"q": "SELECT CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS edge, CASE WHEN c_custkey % 5 > 0 THEN c_custkey END AS edge_n, c_acctbal AS score, CASE WHEN c_custkey % 50 > 0 THEN c_custkey END AS score_n FROM customer"})
def without_n(v):
    rows = v.table("customer").selectExpr("CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS edge", "CASE WHEN c_custkey % 5 > 0 THEN c_custkey END AS edge_n", "c_acctbal AS score", "CASE WHEN c_custkey % 50 > 0 THEN c_custkey END AS score_n")
    return Q.values_without_n(rows, ["edge", "score"])


@query("d7_referential_orphans", "SELECT observation_id, person_id FROM observation WHERE person_id IS NOT NULL AND person_id NOT IN (SELECT person_id FROM person WHERE person_id % 3 > 0)")
def orphans(v):
    return Q.orphans(v.observation().select("observation_id", "person_id"), v.person().filter("person_id % 3 > 0"), "person_id", "person_id")
