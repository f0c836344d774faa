"""G: ranking, sort, top-k."""

from pyspark.sql import functions as F

from palimpsest.operators import ranking as R
from palimpsest.plans.registry import query

VECTORS = "SELECT DISTINCT CAST(round(c_acctbal / 10) AS BIGINT) AS a, CAST(c_custkey % 3 AS BIGINT) AS level, CAST(c_custkey * 7919 % 1000 AS BIGINT) AS b FROM customer"

def vectors(v):
    return v.table("customer").select(F.round(F.col("c_acctbal") / 10).cast("long").alias("a"), (F.col("c_custkey") % 3).cast("long").alias("level"), (F.col("c_custkey") * 7919 % 1000).cast("long").alias("b"))


@query("g1_pareto_fronts", f"""WITH RECURSIVE vec AS ({VECTORS}), peel(front, a, level, b, gone) AS (
    SELECT CAST(0 AS BIGINT), a, level, b, NOT EXISTS (SELECT 1 FROM vec o WHERE o.a >= v.a AND o.level >= v.level AND o.b >= v.b AND (o.a, o.level, o.b) <> (v.a, v.level, v.b)) FROM vec v
    UNION ALL SELECT p.front + 1, p.a, p.level, p.b, NOT EXISTS (SELECT 1 FROM (SELECT * FROM peel WHERE NOT gone) o WHERE o.a >= p.a AND o.level >= p.level AND o.b >= p.b AND (o.a, o.level, o.b) <> (p.a, p.level, p.b)) FROM peel p WHERE NOT p.gone)
    SELECT a, level, b, front FROM peel WHERE gone""".replace("\n", " "))
def fronts(v):
    return R.pareto_fronts(vectors(v), "a", "level", "b")


@query("g2_pareto_skyline", "SELECT a, level, b FROM vec v WHERE NOT EXISTS (SELECT 1 FROM vec o WHERE o.a >= v.a AND o.level >= v.level AND o.b >= v.b AND (o.a, o.level, o.b) <> (v.a, v.level, v.b))", {"vec": VECTORS})
def skyline(v):
    return R.skyline(vectors(v).distinct(), "a", "level", "b").filter("NOT dominated").drop("dominated")


@query("g3_index_percentile_rank", "SELECT c_custkey, (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) / (count(*) OVER () - 1) AS pct FROM customer")
def percentile(v):
    return R.index_percentile(v.table("customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", "pct").select("c_custkey", "pct")


@query("g5_cap_per_key", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE value > 10) WHERE nth <= 4")
def cap(v):
    return R.cap_per_key(v.table("events").filter("value > 10"), "user_id", ["ts", "event_id"], 4).select("user_id", "event_id")


@query("g6_quota_topk", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS nth FROM events) WHERE event_type = 'click' AND nth <= 6 OR event_type = 'view' AND nth <= 4")
def quota(v):
    return R.quota_topk(v.table("events"), "event_type", {"click": 6, "view": 4}, [F.desc("value"), F.asc("event_id")]).select("event_type", "event_id")


@query("g7_round_robin_budget", "SELECT event_type, event_id, turn FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS turn FROM events) ORDER BY turn, event_type LIMIT 128")
def robin(v):
    return R.round_robin(v.table("events"), "event_type", ["ts", "event_id"], 128).select("event_type", "event_id", "turn")


@query("g8_funnel_share_of_max", "SELECT stage, n, n / max(n) OVER () AS share FROM (SELECT stage, count(*) AS n FROM stage GROUP BY stage)")
def shares(v):
    return R.share_of_largest(v.stage().groupBy("stage").agg(F.count(F.lit(1)).alias("n")), "n")


COUNTS = "SELECT person_id, count(o.observation_id) AS n FROM person LEFT JOIN observation o USING (person_id) GROUP BY person_id"


@query("g9_pick_examples", "SELECT (SELECT person_id FROM c WHERE n > 0 ORDER BY n, person_id LIMIT 1) AS fewest, (SELECT min(person_id) FROM c WHERE n = 0) AS none, (SELECT person_id FROM c ORDER BY n DESC, person_id LIMIT 1) AS most", {"c": COUNTS})
def examples(v):
    counts = v.person().select("person_id").join(v.observation(), "person_id", "left").groupBy("person_id").agg(F.count("observation_id").alias("n"))
    return R.pick_examples(counts, "person_id", "n")


@query("g10_cold_start_bench", """SELECT person_id, kind, string_agg(artifact_type, ',' ORDER BY nth) AS items FROM (SELECT person_id, kind, artifact_type, row_number() OVER (PARTITION BY person_id, kind ORDER BY rate DESC, artifact_type) AS nth FROM
    (SELECT p.person_id, r.artifact_type, r.rate, CASE WHEN r.rate >= 0.9 THEN 'expected' ELSE 'priced' END AS kind FROM (SELECT DISTINCT person_id FROM observation WHERE person_id IS NOT NULL) p CROSS JOIN rates r
     WHERE NOT EXISTS (SELECT 1 FROM observation o WHERE o.person_id = p.person_id AND o.artifact_type = r.artifact_type))) WHERE nth <= CASE kind WHEN 'expected' THEN 4 ELSE 2 END GROUP BY person_id, kind""",
    {"rates": "SELECT artifact_type, count(DISTINCT person_id) / (SELECT count(DISTINCT person_id) FROM observation) AS rate FROM observation WHERE person_id IS NOT NULL GROUP BY 1"})
def bench(v):
    held = v.observation().filter("person_id IS NOT NULL").select("person_id", "artifact_type").distinct()
    out = R.missing_by_rate(held, "person_id", "artifact_type", 0.9, {"expected": 4, "priced": 2})
    return out.select("person_id", "kind", F.array_join("items", ",").alias("items"))
