"""Canonical views: the shapes of an evidence ledger, bound to the driver's tables.

Every view is lazy; nulls are put in by rule, since the tables have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Log-odds by class of source.
RELIABILITY = [("self_report", -1.2), ("interview", 0.0), ("forum_post", 0.0), ("press", 0.2), ("code_host", 0.8), ("preprint", 0.9), ("third_party_observable", 1.1), ("registry_filing", 2.4)]
CLASSES = [name for name, _ in RELIABILITY]


def reliability(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELIABILITY, "source_class string, weight double")


class Views:
    """The views of one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def person(self) -> DataFrame:
        c, n, r = self.table("customer"), self.table("nation"), self.table("region")
        return (
            c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(
                F.col("c_custkey").alias("person_id"), F.col("c_name").alias("display_name"),
                F.expr("CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE r_name END").alias("region"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END").alias("sector"),
                F.expr("CASE c_custkey % 3 WHEN 0 THEN 'solo' WHEN 1 THEN 'team' END").alias("solo_or_team"),
                F.expr("CASE WHEN c_acctbal < 1500 THEN 'bootstrapped' WHEN c_acctbal < 5500 THEN 'angel_backed' ELSE 'institutionally_backed' END").alias("resource_tier"),
                F.expr("c_custkey % 11 <> 0").alias("is_real_person"), F.col("c_acctbal").alias("balance"), F.col("n_name").alias("nation"),
            )
        )

    def observation(self) -> DataFrame:
        e = self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        return e.select(
            F.col("event_id").alias("observation_id"), F.expr("CASE WHEN k % 25 = 0 THEN NULL ELSE user_id END").alias("person_id"), F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 50 END").alias("org_id"),
            F.expr("concat('ch', cast(event_id % 6 AS string))").alias("channel_id"), F.expr("concat(event_type, '_', cast(k % 4 AS string))").alias("artifact_type"), F.col("event_type").alias("claim_type"),
            F.expr("CASE event_type WHEN 'error' THEN 'self_report' WHEN 'view' THEN 'forum_post' WHEN 'click' THEN 'code_host' WHEN 'signup' THEN 'third_party_observable' ELSE CASE WHEN k >= 97 THEN 'press' ELSE 'registry_filing' END END").alias("source_class"),
            F.expr("CASE WHEN k % 20 = 3 THEN 'fixture' ELSE 'live' END").alias("provenance_class"), F.expr("CASE WHEN k % 10 = 0 THEN NULL ELSE concat('http://src', cast(user_id % 40 AS string), '.example.net/', event_type) END").alias("source_url"),
            F.expr("cast(cast(round(value) AS bigint) AS string)").alias("value_text"), F.expr("k % 8 = 1").alias("is_milestone"), F.col("k").cast("long").alias("k"),
            F.col("ts").cast("timestamp_ntz").alias("observed_at"), F.expr("cast(ts AS timestamp_ntz) + make_dt_interval(0, k)").alias("ingested_at"), "value",
        )

    def claim(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("claim_type"), F.col("o_totalprice").alias("stated_value"),
            F.expr("o_orderkey % 17 = 0").alias("is_manifest_predicted"), F.col("o_orderdate").cast("timestamp_ntz").alias("observed_at"),
        )

    def evidence(self) -> DataFrame:
        classes = F.array(*[F.lit(c) for c in CLASSES])
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("claim_id"), F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)").alias("evidence_id"), F.col("l_linenumber").alias("ordinal"),
            F.expr("CASE l_returnflag WHEN 'A' THEN 'corroborating' WHEN 'R' THEN 'contradicting' ELSE 'expected_absent' END").alias("kind"),
            F.expr("l_returnflag <> 'N'").alias("found"), F.expr("l_linestatus = 'O'").alias("expected"), F.expr("l_tax >= 0.04 AND l_linestatus = 'O'").alias("penalised"),
            F.get(classes, (F.col("l_suppkey") % 8).cast("int")).alias("source_class"),
            F.expr("CASE WHEN l_discount < 0.03 AND l_returnflag <> 'N' THEN (CASE l_returnflag WHEN 'A' THEN 1 ELSE -1 END) * l_quantity / 25 END").alias("log_odds_delta"),
            F.expr("CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_tax * 10 END").alias("findability_prior"), F.expr("l_discount * 50").alias("interval_widen"), F.col("l_shipdate").cast("timestamp_ntz").alias("observed_at"),
            F.expr("concat('http://src', cast(l_suppkey % 40 AS string), '.example.net/')").alias("source_url"),
        )

    def stage(self) -> DataFrame:
        line, o = self.table("lineitem").filter("l_linenumber <= 4"), self.table("orders")
        rows = line.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        at = "cast(o_orderdate AS timestamp_ntz) + make_dt_interval(l_linenumber, cast(p % 20 {} AS int))"
        return rows.select(
            F.col("l_orderkey").alias("opportunity_id"), F.expr("CASE l_linenumber WHEN 1 THEN 'sourcing' WHEN 2 THEN 'screening' WHEN 3 THEN 'diligence' ELSE 'decision' END").alias("stage"),
            F.expr(at.format("")).alias("entered_at"), F.expr("s % 4 = 0").alias("wait_is_human"), F.expr(f"CASE WHEN p % 3 = 0 THEN {at.format('+ 1 + p % 4')} END").alias("exited_at"),
            F.expr("CASE WHEN o_orderstatus = 'P' AND l_linenumber < 4 THEN 'screened_out' ELSE 'advanced' END").alias("exited_reason"),
        )

    def opportunity(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("opportunity_id"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 150 END").alias("person_id"), F.expr("CASE WHEN o_orderkey % 6 < 3 THEN NULL ELSE o_orderkey % 50 END").alias("org_id"),
            F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END").alias("sector"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("opened_at"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderdate AS timestamp_ntz) - make_dt_interval(cast(o_orderkey % 30 AS int)) END").alias("first_signal_at"),
            F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
        )
