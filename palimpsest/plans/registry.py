"""Registered queries: an operator bound to views, with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.sources.views import RELIABILITY, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "reliability": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', CAST({w} AS DOUBLE))" for c, w in RELIABILITY) + ") AS r(source_class, weight)",
    "person": """SELECT c_custkey AS person_id, c_name AS display_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE r_name END AS region, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS sector,
        CASE c_custkey % 3 WHEN 0 THEN 'solo' WHEN 1 THEN 'team' END AS solo_or_team, CASE WHEN c_acctbal < 1500 THEN 'bootstrapped' WHEN c_acctbal < 5500 THEN 'angel_backed' ELSE 'institutionally_backed' END AS resource_tier,
        c_custkey % 11 <> 0 AS is_real_person, c_acctbal AS balance, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "observation": """SELECT event_id AS observation_id, CASE WHEN k % 25 = 0 THEN NULL ELSE user_id END AS person_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 50 END AS org_id,
        'ch' || CAST(event_id % 6 AS VARCHAR) AS channel_id, event_type || '_' || CAST(k % 4 AS VARCHAR) AS artifact_type, event_type AS claim_type,
        CASE event_type WHEN 'error' THEN 'self_report' WHEN 'view' THEN 'forum_post' WHEN 'click' THEN 'code_host' WHEN 'signup' THEN 'third_party_observable' ELSE CASE WHEN k >= 97 THEN 'press' ELSE 'registry_filing' END END AS source_class,
        CASE WHEN k % 20 = 3 THEN 'fixture' ELSE 'live' END AS provenance_class, CASE WHEN k % 10 = 0 THEN NULL ELSE 'http://src' || CAST(user_id % 40 AS VARCHAR) || '.example.net/' || event_type END AS source_url,
        CAST(CAST(round(value) AS BIGINT) AS VARCHAR) AS value_text, k % 8 = 1 AS is_milestone, CAST(k AS BIGINT) AS k, ts AS observed_at, ts + k * INTERVAL 1 HOUR AS ingested_at, value
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "claim": "SELECT o_orderkey AS claim_id, o_custkey AS person_id, o_orderpriority AS claim_type, o_totalprice AS stated_value, o_orderkey % 17 = 0 AS is_manifest_predicted, o_orderdate AS observed_at FROM orders",
    "evidence": """SELECT l_orderkey AS claim_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS evidence_id, l_linenumber AS ordinal,
        CASE l_returnflag WHEN 'A' THEN 'corroborating' WHEN 'R' THEN 'contradicting' ELSE 'expected_absent' END AS kind, l_returnflag <> 'N' AS found, l_linestatus = 'O' AS expected, l_tax >= 0.04 AND l_linestatus = 'O' AS penalised,
        CASE l_suppkey % 8 """ + " ".join(f"WHEN {i} THEN '{c}'" for i, (c, _) in enumerate(RELIABILITY)) + """ END AS source_class,
        CASE WHEN l_discount < 0.03 AND l_returnflag <> 'N' THEN (CASE l_returnflag WHEN 'A' THEN 1 ELSE -1 END) * l_quantity / 25 END AS log_odds_delta, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_tax * 10 END AS findability_prior,
        l_discount * 50 AS interval_widen, l_shipdate AS observed_at, 'http://src' || CAST(l_suppkey % 40 AS VARCHAR) || '.example.net/' AS source_url FROM lineitem""",
    "stage": """SELECT opportunity_id, stage, entered_at, s % 4 = 0 AS wait_is_human, CASE WHEN p % 3 = 0 THEN entered_at + (1 + p % 4) * INTERVAL 1 HOUR END AS exited_at, CASE WHEN st = 'P' AND ln < 4 THEN 'screened_out' ELSE 'advanced' END AS exited_reason
        FROM (SELECT l_orderkey AS opportunity_id, CASE l_linenumber WHEN 1 THEN 'sourcing' WHEN 2 THEN 'screening' WHEN 3 THEN 'diligence' ELSE 'decision' END AS stage, l_linenumber AS ln, o_orderstatus AS st,
          o_orderdate + l_linenumber * INTERVAL 1 DAY + (max(l_partkey) % 20) * INTERVAL 1 HOUR AS entered_at, max(l_partkey) AS p, max(l_suppkey) AS s
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 4 GROUP BY l_orderkey, l_linenumber, o_orderdate, o_orderstatus)""",
    "opportunity": """SELECT o_orderkey AS opportunity_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 150 END AS person_id, CASE WHEN o_orderkey % 6 < 3 THEN NULL ELSE o_orderkey % 50 END AS org_id,
        CASE o_orderkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS sector, o_orderdate AS opened_at,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate - (o_orderkey % 30) * INTERVAL 1 DAY END AS first_signal_at, o_orderstatus AS status, o_totalprice AS price FROM orders""",
}


def query(name: str, sql: str | None = None, more: dict[str, str] | None = None):
    """Registers a function of Views. sql may use the views by name; more are CTEs that come after them."""

    def put(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            # views by need, so that oracles stay short
            text = " ".join([sql, *(more or {}).values()])
            used = {v: s for v, s in VIEWS.items() if re.search(rf"\b{v}\b", text)}
            recursive = "RECURSIVE " if any("(" in k for k in more or {}) else ""
            ORACLES[name] = f"WITH {recursive}" + ", ".join(f"{k} AS ({s})" for k, s in (used | (more or {})).items()) + " " + sql if used or more else sql
        return f

    return put
