"""C: joins."""

from pyspark.sql import functions as F

from palimpsest.operators import joins as J
from palimpsest.operators.ledger import asof
from palimpsest.operators.temporal import rank_shift
from palimpsest.plans.registry import query

AT = "2024-01-20 00:00:00"
DIMS = ["sector", "solo_or_team", "region"]
LADDER = [["sector", "solo_or_team", "region"], ["sector", "solo_or_team"], ["sector"], []]
UNKNOWN = "coalesce(sector, 'unknown') AS sector, coalesce(solo_or_team, 'unknown') AS solo_or_team, coalesce(region, 'unknown') AS region"
CELLS = {
    "profile": f"SELECT person_id, {UNKNOWN}, balance FROM person",
    "cells": """SELECT CAST(CASE WHEN g = 0 THEN 0 WHEN g = 1 THEN 1 WHEN g = 3 THEN 2 ELSE 3 END AS INT) AS level, CASE g WHEN 0 THEN 'sector=' || sector || '|solo_or_team=' || solo_or_team || '|region=' || region WHEN 1 THEN 'sector=' || sector || '|solo_or_team=' || solo_or_team WHEN 3 THEN 'sector=' || sector ELSE '' END AS cell, n, mean
        FROM (SELECT grouping(sector, solo_or_team, region) AS g, sector, solo_or_team, region, count(*) AS n, round(avg(balance), 6) AS mean FROM profile GROUP BY GROUPING SETS ((sector, solo_or_team, region), (sector, solo_or_team), (sector), ()))""",
}


@query("c1_spine_enrichment", f"SELECT p.person_id, p.sector, count(o.observation_id) AS n_rows, max(o.observed_at) AS last_seen FROM person p LEFT JOIN (SELECT * FROM observation WHERE observed_at <= TIMESTAMP '{AT}') o USING (person_id) GROUP BY ALL")
def spine(v):
    return v.person().join(asof(v.observation(), AT), "person_id", "left").groupBy("person_id", "sector").agg(F.count("observation_id").alias("n_rows"), F.max("observed_at").alias("last_seen"))


@query("c1_rows_without_spine", f"SELECT o.observation_id, o.person_id, p.sector FROM observation o LEFT JOIN person p USING (person_id) WHERE observed_at <= TIMESTAMP '{AT}'")
def rows_first(v):
    return asof(v.observation(), AT).join(v.person().select("person_id", "sector"), "person_id", "left").select("observation_id", "person_id", "sector")


@query("c2_backoff_join", "SELECT person_id, level, cell, n, mean FROM (SELECT person_id, level, cell, n, mean, row_number() OVER (PARTITION BY person_id ORDER BY level) AS nth FROM (SELECT person_id, unnest([{'l': 0, 'c': 'sector=' || sector || '|solo_or_team=' || solo_or_team || '|region=' || region}, {'l': 1, 'c': 'sector=' || sector || '|solo_or_team=' || solo_or_team}, {'l': 2, 'c': 'sector=' || sector}, {'l': 3, 'c': ''}]) AS r FROM profile) JOIN cells ON level = r.l AND cell = r.c WHERE n >= 60 OR level = 3) WHERE nth = 1", CELLS)
def backoff(v):
    people = v.person().select("person_id", *DIMS, "balance")
    cells = J.grouping_cells(people, LADDER, DIMS, {"n": F.count(F.lit(1)), "mean": F.round(F.avg("balance"), 6)})
    return J.backoff_join(people.select("person_id", *DIMS), cells, LADDER, DIMS, ["mean"], least=60).select("person_id", "level", "cell", "n", "mean")


RULES = [(0, "site", None, None, {}, 0.5), (1, "site", "BUILDING", None, {}, 0.6), (2, "site", "BUILDING", "team", {}, 0.7), (3, "site", None, None, {"region": "EUROPE"}, 0.4), (4, "repo", None, "solo", {}, 0.3), (5, "repo", "MACHINERY", None, {"region": "ASIA"}, 0.9), (6, "repo", None, None, {"region": "AFRICA"}, 0.2)]


@query("c3_most_specific_match", "SELECT person_id, base, rule_no, weight FROM (SELECT person_id, base, rule_no, weight, row_number() OVER (PARTITION BY person_id, base ORDER BY (rule_sector IS NOT NULL)::INT + (rule_shape IS NOT NULL)::INT + (cond_region IS NOT NULL)::INT DESC, rule_no) AS nth FROM person JOIN rules ON (rule_sector IS NULL OR rule_sector = sector) AND (rule_shape IS NULL OR rule_shape = solo_or_team) AND (cond_region IS NULL OR cond_region = region)) WHERE nth = 1",
    {"rules": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(["CAST(%d AS BIGINT)" % r[0], f"'{r[1]}'", *(f"'{x}'" if x else "NULL" for x in (r[2], r[3], r[4].get('region'))), f"CAST({r[5]} AS DOUBLE)"]) + ")" for r in RULES) + ") AS r(rule_no, base, rule_sector, rule_shape, cond_region, weight)"})
def specific(v):
    rules = v.spark.createDataFrame(RULES, "rule_no long, base string, rule_sector string, rule_solo_or_team string, conditions map<string,string>, weight double").withColumn("rule_region", F.lit(None).cast("string"))
    return J.most_specific(v.person().select("person_id", *DIMS), rules, "person_id", "base", DIMS, "rule_no").select("person_id", "base", "rule_no", "weight")


PRIORS = """SELECT artifact_type, sector, solo_or_team, CAST(count(DISTINCT person_id) AS BIGINT) AS n, round(count(*) FILTER (is_milestone) / count(*), 6) AS p, max(observed_at) AS observed_at FROM observation JOIN person USING (person_id) WHERE person_id % 2 = 0 GROUP BY ALL"""


@query("c4_exact_then_margin_lookup", """SELECT person_id, artifact_type, coalesce(e.p, round(m.p, 3)) AS p, coalesce(e.n, m.n) AS n, CASE WHEN e.n IS NOT NULL THEN 'exact' WHEN m.p IS NOT NULL THEN 'margin' ELSE 'none' END AS basis, coalesce(e.n, m.n) < 25 AS thin
    FROM asked a LEFT JOIN priors e ON e.artifact_type = a.artifact_type AND e.sector IS NOT DISTINCT FROM a.sector AND e.solo_or_team IS NOT DISTINCT FROM a.solo_or_team
    LEFT JOIN (SELECT artifact_type, sector, sum(p * n) / sum(n) AS p, CAST(sum(n) AS BIGINT) AS n FROM priors GROUP BY ALL) m ON m.artifact_type = a.artifact_type AND m.sector IS NOT DISTINCT FROM a.sector""".replace("SELECT person_id, artifact_type", "SELECT person_id, a.artifact_type"),
    {"priors": PRIORS, "asked": "SELECT DISTINCT person_id, artifact_type, sector, solo_or_team FROM observation JOIN person USING (person_id)"})
def exact_margin(v):
    rows = v.observation().join(v.person().select("person_id", "sector", "solo_or_team"), "person_id")
    priors = rows.filter("person_id % 2 = 0").groupBy("artifact_type", "sector", "solo_or_team").agg(F.countDistinct("person_id").alias("n"), F.round(F.count_if("is_milestone") / F.count(F.lit(1)), 6).alias("p"), F.max("observed_at").alias("observed_at"))
    asked = rows.select("person_id", "artifact_type", "sector", "solo_or_team").distinct()
    return J.exact_then_margin(asked, priors, ["artifact_type", "sector", "solo_or_team"], ["artifact_type", "sector"]).select("person_id", "artifact_type", "p", "n", "basis", "thin")


@query("c5_evidence_join", "SELECT c.claim_id, count(e.evidence_id) AS n_evidence, round(coalesce(sum(e.interval_widen), 0), 6) AS widen FROM (SELECT * FROM claim WHERE observed_at <= TIMESTAMP '1999-01-01') c LEFT JOIN (SELECT * FROM evidence WHERE observed_at <= TIMESTAMP '1999-01-01') e USING (claim_id) GROUP BY c.claim_id")
def evidence_join(v):
    at = "1999-01-01 00:00:00"
    return asof(v.claim(), at).join(asof(v.evidence(), at), "claim_id", "left").groupBy("claim_id").agg(F.count("evidence_id").alias("n_evidence"), F.round(F.coalesce(F.sum("interval_widen"), F.lit(0.0)), 6).alias("widen"))


@query("c6_receipt_join", """SELECT e.evidence_id, r.verdict, coalesce(e.final_url, r.receipt_url) AS final_url, coalesce(r.receipt_status, e.http_status) AS http_status FROM (SELECT evidence_id, CASE WHEN ordinal = 1 THEN source_url END AS final_url, CAST(0 AS BIGINT) AS http_status FROM evidence) e
    LEFT JOIN (SELECT * FROM receipts WHERE verdict <> 'SKIPPED' AND receipt_status <> 0) r USING (evidence_id)""",
    {"receipts": "SELECT evidence_id, CASE claim_id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'SKIPPED' WHEN 2 THEN 'SOFT-OK' ELSE 'ABSENT-OK' END AS verdict, CAST(CASE claim_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 0 END AS BIGINT) AS receipt_status, source_url || 'final' AS receipt_url FROM evidence WHERE found"})
def receipts(v):
    e = v.evidence()
    r = e.filter("found").select("evidence_id", F.expr("CASE claim_id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'SKIPPED' WHEN 2 THEN 'SOFT-OK' ELSE 'ABSENT-OK' END").alias("verdict"), F.expr("cast(CASE claim_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 0 END AS bigint)").alias("receipt_status"), F.concat("source_url", F.lit("final")).alias("receipt_url"))
    rows = e.select("evidence_id", F.when(F.col("ordinal") == 1, F.col("source_url")).alias("final_url"), F.lit(0).cast("long").alias("http_status"))
    return J.receipt_join(rows, r, "evidence_id")


IDS = "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'ch_' ELSE '' END || substr('Supplier#' || CAST(s_suppkey % 97 AS VARCHAR), 1, CAST(4 + s_suppkey % 9 AS INT)) AS id FROM supplier"


@query("c7_id_drift_pairs", "SELECT a.id AS drifted, b.id AS other FROM (SELECT DISTINCT id FROM ids WHERE id LIKE 'ch\\_%' ESCAPE '\\') a JOIN (SELECT DISTINCT id FROM ids WHERE id NOT LIKE 'ch\\_%' ESCAPE '\\') b ON starts_with(substr(a.id, 4), b.id) OR starts_with(b.id, substr(a.id, 4))", {"ids": IDS})
def drift(v):
    ids = v.table("supplier").select(F.expr("concat(CASE WHEN s_suppkey % 3 = 0 THEN 'ch_' ELSE '' END, substr(concat('Supplier#', cast(s_suppkey % 97 AS string)), 1, cast(4 + s_suppkey % 9 AS int)))").alias("id")).distinct()
    return J.id_drift_pairs(ids, "id")


BOARD = "SELECT c_custkey AS id, row_number() OVER (ORDER BY {0}, c_custkey) AS rank, CASE WHEN {1} THEN 'decide' ELSE 'pass' END AS verdict FROM customer WHERE {2}"
BOARDS = {"a": BOARD.format("c_acctbal", "c_acctbal > 5000", "c_custkey % 10 <> 1"), "b": BOARD.format("c_acctbal * (1 + c_custkey % 3)", "c_acctbal * (1 + c_custkey % 3) > 6000", "c_custkey % 10 <> 2")}


def boards(v):
    from palimpsest.operators.ranking import global_rank

    c = v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    moved = c.withColumn("x", F.col("x") * (1 + F.col("id") % 3))
    one = lambda d, cut, gone: global_rank(d.filter(F.col("id") % 10 != gone), ["x", "id"], "rank").select("id", "rank", F.when(F.col("x") > cut, "decide").otherwise("pass").alias("verdict"))
    return one(c, 5000, 1), one(moved, 6000, 2)


@query("c8_board_diff", "SELECT id, CASE WHEN a.rank IS NULL THEN 'entered' WHEN b.rank IS NULL THEN 'left' ELSE 'both' END AS status, a.rank AS rank_a, b.rank AS rank_b, a.rank - b.rank AS rank_delta, coalesce(a.verdict <> b.verdict, FALSE) AS verdict_changed FROM a FULL OUTER JOIN b USING (id)", BOARDS)
def diff(v):
    return J.board_diff(*boards(v), "id")


@query("i2_board_sets", "SELECT 'both' AS side, id FROM a JOIN b USING (id) UNION ALL SELECT 'entered', id FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT 'left', id FROM a WHERE id NOT IN (SELECT id FROM b)", BOARDS)
def board_sets(v):
    a, b = (x.select("id") for x in boards(v))
    side = lambda name, df: df.select(F.lit(name).alias("side"), "id")
    return side("both", a.intersect(b)).unionByName(side("entered", b.exceptAll(a))).unionByName(side("left", a.exceptAll(b)))


@query("c9_raw_vs_adjusted_rank_shift", "SELECT id, raw_rank, adjusted_rank, raw_rank - adjusted_rank AS shift FROM (SELECT c_custkey AS id, row_number() OVER (ORDER BY raw DESC NULLS LAST, c_custkey) AS raw_rank, row_number() OVER (ORDER BY adj DESC NULLS LAST, c_custkey) AS adjusted_rank FROM (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS raw, c_acctbal - 100 * (c_custkey % 7) AS adj FROM customer))")
def shift(v):
    c = v.table("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal")).alias("raw"), (F.col("c_acctbal") - 100 * (F.col("c_custkey") % 7)).alias("adj"))
    return rank_shift(c, "id", "raw", "adj")


@query("c10_pii_leak_scan", "SELECT page_id, display_name AS name FROM (SELECT page_id, html || ' seen by ' || 'Customer#' || lpad(CAST(page_id % 3000 AS VARCHAR), 9, '0') || ' today' AS body FROM pages) t JOIN person p ON p.person_id % 11 <> 0 AND contains(lower(t.body), lower(p.display_name))")
def leaks(v):
    texts = v.table("pages").select("page_id", F.concat("html", F.lit(" seen by Customer#"), F.lpad((F.col("page_id") % 3000).cast("string"), 9, "0"), F.lit(" today")).alias("body"))
    return J.name_leaks(v.person().filter("is_real_person"), texts, "display_name", "page_id", "body")


@query("c11_asof_join", "SELECT e.opportunity_id, e.entered_at, s.claim_id, s.observed_at FROM (SELECT opportunity_id, opportunity_id % 200 AS k, entered_at FROM stage) e ASOF LEFT JOIN (SELECT claim_id % 200 AS k, observed_at, max(claim_id) AS claim_id FROM claim GROUP BY ALL) s ON e.k = s.k AND e.entered_at >= s.observed_at")
def asof_latest(v):
    left = v.stage().select("opportunity_id", (F.col("opportunity_id") % 200).alias("k"), "entered_at")
    right = v.claim().select((F.col("claim_id") % 200).alias("k"), "observed_at", "claim_id")
    return J.asof_join(left, right, "k", "entered_at", "observed_at", ["claim_id", "observed_at"], "claim_id").select("opportunity_id", "entered_at", "claim_id", "observed_at")
