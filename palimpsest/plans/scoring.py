"""F: scoring; E19, G4 and N1 on top of it."""

from pyspark.sql import functions as F

from palimpsest.operators import aggregates as A
from palimpsest.operators import scoring as S
from palimpsest.operators.ledger import asof
from palimpsest.plans.registry import query
from palimpsest.sources.views import reliability

AT = "1999-01-01 00:00:00"
SIG = "1 / (1 + exp(-({0})))"
CLIPP = "least(greatest({0}, 0.01), 0.99)"
ABSENT_LLR = f"least(greatest(least(ln((1 - {CLIPP.format('{0}')}) / (1 - {CLIPP.format('{1}')})), 2.5), -2.5), 0)"
FOUND_LLR = f"greatest(least(ln({CLIPP.format('{0}')} / {CLIPP.format('{1}')}), 2.5), -2.5)"
STATE = "CASE WHEN {1} THEN 'absent_but_expected' WHEN {0} >= 2 THEN 'verified' WHEN {0} <= -2 THEN 'contradicted' ELSE 'unverified' END"
DELTAS = {
    "deltas": f"""SELECT e.*, weight, CASE WHEN coalesce(log_odds_delta, 0) <> 0 THEN log_odds_delta WHEN kind = 'expected_absent' THEN CASE WHEN NOT found AND expected AND penalised AND findability_prior IS NOT NULL THEN {ABSENT_LLR.format('findability_prior', '0.1')} ELSE 0 END
        WHEN source_class = 'self_report' THEN weight WHEN kind = 'contradicting' THEN -abs(weight) ELSE abs(weight) END AS delta FROM evidence e LEFT JOIN reliability USING (source_class) WHERE observed_at <= TIMESTAMP '1999-01-01'""",
}
CLAIMS = DELTAS | {
    "scored": f"""SELECT claim_id, person_id, n_evidence, log_odds, widen, state, CASE WHEN state <> 'absent_but_expected' THEN round({SIG.format('log_odds')}, 6) END AS posterior FROM (
        SELECT claim_id, person_id, coalesce(n, 0) AS n_evidence, coalesce(s, 0.0) AS log_odds, coalesce(w, 0.0) AS widen, {STATE.format('coalesce(s, 0.0)', 'is_manifest_predicted OR coalesce(a, FALSE)')} AS state
        FROM (SELECT * FROM claim WHERE observed_at <= TIMESTAMP '1999-01-01') LEFT JOIN (SELECT claim_id, count(*) AS n, round(sum(delta), 2) AS s, bool_and(kind = 'expected_absent') AS a, round(sum(interval_widen), 6) AS w FROM deltas GROUP BY 1) USING (claim_id))""",
}


def deltas(v):
    return S.with_delta(asof(v.evidence(), AT), reliability(v.spark))


def scored(v):
    return S.claim_log_odds(asof(v.claim(), AT), asof(v.evidence(), AT), reliability(v.spark))


@query("f1_claim_log_odds", "SELECT * FROM scored", CLAIMS)
def claim_log_odds(v):
    return scored(v)


@query("f2_claim_waterfall", "SELECT claim_id, evidence_id, ordinal, round(delta, 6) + 0.0::DOUBLE AS delta, round(sum(delta) OVER (PARTITION BY claim_id ORDER BY coalesce(ordinal, 99), evidence_id ROWS UNBOUNDED PRECEDING), 6) + 0.0::DOUBLE AS running FROM deltas", DELTAS)
def waterfall(v):
    return S.claim_waterfall(deltas(v))


LOO = f"""SELECT claim_id, evidence_id, lo AS log_odds_without, round({SIG.format('lo')}, 6) AS posterior_without, {STATE.format('lo', 'FALSE')} AS state_without, {STATE.format('lo', 'FALSE')} <> state AS flips_state
    FROM (SELECT claim_id, evidence_id, round(sum(delta) OVER w - delta, 2) AS lo, count(*) OVER w AS n FROM deltas WINDOW w AS (PARTITION BY claim_id)) JOIN scored USING (claim_id) WHERE n >= 2"""


@query("f3_claim_leave_one_out", LOO, CLAIMS)
def leave_one_out(v):
    return S.claim_leave_one_out(deltas(v), scored(v))


@query("f21_claim_routing", "SELECT claim_id, CASE WHEN state = 'absent_but_expected' THEN 'gap_row' WHEN state = 'contradicted' THEN 'bear_case' WHEN n_evidence = 0 THEN 'blocked_gap' ELSE 'body' END AS route FROM scored", CLAIMS)
def routing(v):
    return scored(v).select("claim_id", S.claim_routing(F.col("state"), F.col("n_evidence")).alias("route"))


@query("f22_receipt_pairs", "SELECT claim_id, said, evidence_id AS checked FROM evidence JOIN (SELECT claim_id, arg_min(evidence_id, (ordinal, evidence_id)) AS said FROM evidence WHERE source_class = 'self_report' GROUP BY 1) USING (claim_id) WHERE source_class <> 'self_report'")
def pairs(v):
    return S.receipt_pairs(v.evidence().withColumn("http_status", F.lit(None).cast("int")))


@query("e19_entity_claim_rollup", "SELECT person_id, count(*) FILTER (state = 'verified') AS n_verified, count(*) FILTER (state = 'contradicted') AS n_contradicted, count(*) FILTER (state NOT IN ('verified', 'contradicted')) AS n_open FROM scored GROUP BY 1", CLAIMS)
def rollup(v):
    return A.claim_rollup(scored(v), "person_id", "state")


@query("d4_stored_vs_recomputed", "SELECT claim_id, CASE WHEN claim_id % 10 = 0 THEN 'verified' ELSE 'unverified' END AS stored, state AS recomputed FROM scored WHERE (CASE WHEN claim_id % 10 = 0 THEN 'verified' ELSE 'unverified' END) <> state", CLAIMS)
def stored(v):
    from palimpsest.operators.quality import changed_states

    s = scored(v)
    return changed_states(s.select("claim_id", F.when(F.col("claim_id") % 10 == 0, "verified").otherwise("unverified").alias("stored_state")), s, "claim_id", "stored_state", "state")


# --- pooled scores over observations -------------------------------------------------------------------------------------------------

BUILD = "least(greatest(base + 0.5 * (coalesce(p_pop, 0) - coalesce(p_class, 0)), 0), 1)"
POOL = CLAIMS | {
    "obs": "SELECT *, (k % 100) / 100.0 AS confidence FROM observation WHERE person_id IS NOT NULL",
    "rates": "SELECT artifact_type, count(DISTINCT person_id) / (SELECT count(DISTINCT person_id) FROM obs) AS p_pop, count(DISTINCT person_id) FILTER (person_id % 2 = 0) / (SELECT count(DISTINCT person_id) FROM obs WHERE person_id % 2 = 0) AS p_class FROM obs GROUP BY 1",
    "resolved": "SELECT person_id % 400 AS person_id, claim_id, posterior FROM scored WHERE state IN ('verified', 'contradicted')",
    "streams": f"""SELECT person_id, 'credibility' AS component, source_class AS stream, {SIG.format('weight')} AS y FROM (SELECT DISTINCT person_id, source_class FROM obs WHERE person_id NOT IN (SELECT person_id FROM resolved)) JOIN reliability USING (source_class)
        UNION ALL SELECT person_id, 'credibility', 'claim ' || claim_id, posterior FROM resolved
        UNION ALL SELECT person_id, 'build', artifact_type || '/' || CASE WHEN is_milestone THEN 'true' ELSE 'false' END, {BUILD} FROM (SELECT person_id, artifact_type, is_milestone, arg_min(confidence, (observed_at, observation_id)) AS base FROM obs GROUP BY 1, 2, 3) LEFT JOIN rates USING (artifact_type)""",
    "people": "SELECT person_id, coalesce(sector, 'unknown') AS cell FROM person",
    "cellrates": "SELECT cell, artifact_type, count(DISTINCT person_id) / max(n) AS p FROM (SELECT cell, count(*) AS n FROM people GROUP BY 1) JOIN people USING (cell) JOIN (SELECT DISTINCT person_id, artifact_type FROM obs) USING (person_id) GROUP BY 1, 2",
    "gone": "SELECT person_id, artifact_type, p, p >= 0.07 AS expected FROM people JOIN cellrates USING (cell) WHERE p >= 0.05 AND NOT EXISTS (SELECT 1 FROM obs WHERE obs.person_id = people.person_id AND obs.artifact_type = cellrates.artifact_type)",
}


def pool(v):
    obs = v.observation().filter("person_id IS NOT NULL").withColumn("confidence", (F.col("k") % 100) / 100.0)
    even = F.col("person_id") % 2 == 0
    totals = obs.agg(F.countDistinct("person_id").alias("a"), F.countDistinct(F.when(even, F.col("person_id"))).alias("b"))
    rates = obs.groupBy("artifact_type").agg(F.countDistinct("person_id").alias("x"), F.countDistinct(F.when(even, F.col("person_id"))).alias("y")).crossJoin(F.broadcast(totals)).select("artifact_type", (F.col("x") / F.col("a")).alias("p_pop"), (F.col("y") / F.col("b")).alias("p_class"))
    resolved = scored(v).filter("state IN ('verified', 'contradicted')").select((F.col("person_id") % 400).alias("person_id"), "claim_id", "posterior")
    streams = S.evidence_streams(obs, reliability(v.spark), rates, resolved)
    people = v.person().select("person_id", F.coalesce("sector", F.lit("unknown")).alias("cell"))
    return obs, streams, people


def missing(v, obs, people):
    held = obs.select("person_id", "artifact_type").distinct()
    sizes = people.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = people.join(held, "person_id").groupBy("cell", "artifact_type").agg(F.count(F.lit(1)).alias("k")).join(sizes, "cell").select("cell", "artifact_type", (F.col("k") / F.col("n")).alias("p"))
    return S.absences(people, cells, held, "cell", 0.05, 0.07)


@query("f4_evidence_streams", "SELECT person_id, component, stream, round(y, 6) AS y FROM streams", POOL)
def streams(v):
    return pool(v)[1].withColumn("y", F.round("y", 6))


@query("f5_absences", "SELECT person_id, artifact_type, round(p, 9) AS p, expected FROM gone", POOL)
def absences(v):
    obs, _, people = pool(v)
    return missing(v, obs, people).withColumn("p", F.round("p", 9))


RANK = {k: POOL[k] for k in ("obs", "people", "cellrates", "gone")} | {
    "prof": "SELECT person_id, n, log_odds, cell FROM (SELECT person_id, count(*) AS n, round(sum(weight), 3) AS log_odds FROM obs LEFT JOIN reliability USING (source_class) GROUP BY 1) JOIN people USING (person_id)",
    "cm": "SELECT cell, n / (n + 20) * mean + 20 / (n + 20) * all_ AS shrunk FROM (SELECT cell, count(*) AS n, avg(100 / (1 + exp(-log_odds / 6))) AS mean FROM prof GROUP BY 1), (SELECT avg(100 / (1 + exp(-log_odds / 6))) AS all_ FROM prof)",
    "est": f"""SELECT person_id, n, round(pt, 6) AS point, round(least(greatest(pt - h, 0), 100), 6) AS low, round(least(greatest(pt + h, 0), 100), 6) AS high FROM (SELECT person_id, n, n / (n + 5) * 100 * {SIG.format('log_odds / 6')} + (1 - n / (n + 5)) * shrunk AS pt, least(24 * sqrt(5 / (n + 5)) + coalesce(more, 0), 45) AS h
        FROM prof LEFT JOIN cm USING (cell) LEFT JOIN (SELECT person_id, sum(6 * p) AS more FROM gone WHERE p >= 0.4 GROUP BY 1) USING (person_id))""",
}


def estimate(v):
    obs = v.observation().filter("person_id IS NOT NULL")
    people = v.person().select("person_id", F.coalesce("sector", F.lit("unknown")).alias("cell"))
    profiles = A.entity_profile(obs, reliability(v.spark)).select("person_id", "n", "log_odds").join(people, "person_id")
    return S.ranking_estimate(profiles, missing(v, obs, people), A.reference_class_means(profiles, ["cell"]), ["cell"])


@query("f8_ranking_estimate", "SELECT * FROM est", RANK)
def ranking_estimate(v):
    return estimate(v)


GATE = "CASE WHEN low >= 55 AND high - low <= {0} THEN 'decide_now' WHEN low >= 55 OR point >= 55 THEN 'probe_further' ELSE 'pass' END"


@query("f15_gate", f"SELECT person_id, {GATE.format(30)} AS verdict FROM est", RANK)
def gate(v):
    return estimate(v).select("person_id", S.gate(F.col("low"), F.col("point"), F.col("high") - F.col("low"), F.lit(55.0), F.lit(30.0)).alias("verdict"))


@query("e14_verdict_counts", f"SELECT verdict, count(*) AS n FROM (SELECT {GATE.format(30)} AS verdict FROM est) GROUP BY 1", RANK)
def verdicts(v):
    return gate(v).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("f16_appetite_sweep", f"SELECT *, NOT (verdict_low = verdict_medium AND verdict_medium = verdict_high) AS differs FROM (SELECT person_id, {GATE.format(20)} AS verdict_low, {GATE.format(30)} AS verdict_medium, {GATE.format(42)} AS verdict_high FROM est)", RANK)
def sweep(v):
    return S.appetite_sweep(estimate(v), "person_id", 55.0)


VECTOR = "CAST(round(point) AS BIGINT) AS a, CAST(n % 3 AS BIGINT) AS level, CAST(n AS BIGINT) AS b"
DOMINATED = "SELECT 1 FROM {0} o WHERE o.a >= v.a AND o.level >= v.level AND o.b >= v.b AND (o.a, o.level, o.b) <> (v.a, v.level, v.b)"
PEEL = RANK | {
    "board": f"SELECT *, {VECTOR}, (row_number() OVER (ORDER BY point, person_id) - 1) / (count(*) OVER () - 1) AS p1, (row_number() OVER (ORDER BY n, person_id) - 1) / (count(*) OVER () - 1) AS p2 FROM est",
    "vec": "SELECT DISTINCT a, level, b FROM board",
    "peel(front, a, level, b, gone)": f"SELECT CAST(0 AS BIGINT), a, level, b, NOT EXISTS ({DOMINATED.format('vec')}) FROM vec v UNION ALL SELECT v.front + 1, v.a, v.level, v.b, NOT EXISTS ({DOMINATED.format('(SELECT * FROM peel WHERE NOT gone)')}) FROM peel v WHERE NOT v.gone",
}


@query("g4_rank_board", f"SELECT person_id, {GATE.format(30)} AS verdict, front, row_number() OVER (ORDER BY front, 0.6 * p1 + 0.4 * p2 DESC, person_id) AS rank FROM board JOIN peel USING (a, level, b) WHERE gone", PEEL)
def rank_board(v):
    from palimpsest.operators import ranking as R

    def score(df):
        verdict = S.gate(F.col("low"), F.col("point"), F.col("high") - F.col("low"), F.lit(55.0), F.lit(30.0))
        return df.withColumns({"verdict": verdict, "a": F.round("point").cast("long"), "level": (F.col("n") % 3).cast("long"), "b": F.col("n").cast("long")})

    return R.rank_board(estimate(v), score, "person_id", ("a", "level", "b"), {"point": 0.6, "n": 0.4}).select("person_id", "verdict", "front", "rank")


@query("d2_absence_invariant", "SELECT claim_id, evidence_id FROM deltas WHERE kind = 'expected_absent' AND NOT expected AND delta <> 0", DELTAS)
def absence(v):
    from palimpsest.operators.quality import absence_charged

    return absence_charged(deltas(v)).select("claim_id", "evidence_id")


@query("d2_absence_charged_as_stored", "SELECT claim_id, evidence_id FROM evidence WHERE kind = 'expected_absent' AND NOT expected AND interval_widen > 3.75")
def absence_stored(v):
    """The same audit over charges as a careless writer would have stored them: a point for each wide interval, expected or not."""
    from palimpsest.operators.quality import absence_charged

    stored = v.evidence().withColumn("delta", F.when(F.col("interval_widen") > 3.75, -1.0).otherwise(0.0))
    return absence_charged(stored).select("claim_id", "evidence_id")


AXF = CLAIMS | {"rel": "SELECT claim_id, max(findability_prior) AS fp FROM deltas GROUP BY 1",
    "cl": "SELECT claim_id % 1500 AS opp, count(*) FILTER (state = 'verified') AS v, count(*) FILTER (state = 'contradicted') AS c, count(*) FILTER (state = 'absent_but_expected' AND coalesce(fp, 0) >= 0.5) AS p, count(*) FILTER (state = 'absent_but_expected') AS a FROM scored LEFT JOIN rel USING (claim_id) GROUP BY 1",
    "ob": "SELECT person_id % 1500 AS opp, count(*) AS n, avg(coalesce(weight, 0)) AS rel_ FROM observation LEFT JOIN reliability USING (source_class) WHERE person_id IS NOT NULL GROUP BY 1",
    "ctx": "SELECT DISTINCT person_id % 1500 AS opp, CASE WHEN person_id % 1500 % 3 = 0 THEN (person_id % 1500 % 100) / 1.0 END AS memory, (person_id % 1500 % 9 - 4) / 4.0 AS shift FROM person"}


@query("f10_axis_founder", """SELECT opp, n, round(pt, 6) AS point, round(least(greatest(pt - h, 0), 100), 6) AS low, round(least(greatest(pt + h, 0), 100), 6) AS high FROM (SELECT opp, n, w * least(greatest(CASE WHEN memory IS NOT NULL THEN 0.55 * raw + 0.45 * memory ELSE raw END, 0), 100) + (1 - w) * least(greatest(50 + 8 * coalesce(shift, 0), 0), 100) AS pt, least(45, 8 + 22 * (1 - w) + 2.5 * (a - p)) AS h
    FROM (SELECT *, n / (n + 6) AS w, least(greatest(50 + 9 * coalesce(rel_, 0), 0), 100) + 4 * v - 9 * c - 6 * p AS raw FROM (SELECT opp, coalesce(n, 0) AS n, rel_, coalesce(v, 0) AS v, coalesce(c, 0) AS c, coalesce(p, 0) AS p, coalesce(a, 0) AS a, memory, shift FROM ob FULL JOIN cl USING (opp) LEFT JOIN ctx USING (opp))))""", AXF)
def founder(v):
    rel = deltas(v).groupBy("claim_id").agg(F.max("findability_prior").alias("fp"))
    claims = scored(v).join(rel, "claim_id", "left").withColumn("opp", F.col("claim_id") % 1500)
    seen = v.observation().filter("person_id IS NOT NULL").join(F.broadcast(reliability(v.spark)), "source_class", "left").select((F.col("person_id") % 1500).alias("opp"), F.col("weight").alias("reliability"))
    opp = (F.col("person_id") % 1500).alias("opp")
    context = v.person().select(opp).distinct().select("opp", F.when(F.col("opp") % 3 == 0, (F.col("opp") % 100) / 1.0).alias("memory"), ((F.col("opp") % 9 - 4) / 4.0).alias("shift"))
    return S.axis_founder(claims, seen, context, "opp", "fp")


TERMS = {
    "terms": "SELECT CAST(event_id % 300 AS BIGINT) AS opp, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'comparable' WHEN 'signup' THEN 'review' WHEN 'error' THEN CASE WHEN event_id % 9 = 0 THEN 'wind_down' ELSE 'none' END ELSE 'press' END AS kind, CASE WHEN event_type = 'view' THEN value - 40 ELSE value END AS value, ts AS tm FROM events",
    "mk": """SELECT opp, CAST(n + CASE WHEN ok THEN nr ELSE 0 END AS BIGINT) AS n, round(0.3 * g - 0.8 * b - 0.4 * least(comp, 2) + CASE WHEN ok THEN sign(la - fi) * least(1, la / 50) * 0.6 ELSE 0 END - CASE WHEN wi > 0 THEN 0.6 ELSE 0 END + CASE WHEN pr > 0 THEN 0.2 ELSE 0 END + coalesce(shift, 0), 3) + 0.0::DOUBLE AS index
        FROM (SELECT opp, coalesce(n, 0) AS n, coalesce(ok, FALSE) AS ok, coalesce(nr, 0) AS nr, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(comp, 0) AS comp, fi, la, coalesce(wi, 0) AS wi, coalesce(pr, 0) AS pr, shift FROM (SELECT *, coalesce(nr >= 2 AND fi > 0, FALSE) AS ok FROM (SELECT opp, count(*) FILTER (kind <> 'review') AS n, count(*) FILTER (kind = 'claim' AND value > 0) AS g, count(*) FILTER (kind = 'claim' AND value < 0) AS b, count(*) FILTER (kind = 'comparable') AS comp, count(*) FILTER (kind = 'review') AS nr, arg_min(value, tm) FILTER (kind = 'review') AS fi, arg_max(value, tm) FILTER (kind = 'review') AS la, count(*) FILTER (kind = 'wind_down') AS wi, count(*) FILTER (kind = 'press') AS pr FROM terms WHERE kind <> 'none' GROUP BY 1))
        FULL JOIN (SELECT person_id AS opp, (person_id % 7 - 3) / 10.0 AS shift FROM person WHERE person_id % 2 = 0) USING (opp))""",
    "mkl": "SELECT *, CASE WHEN index <= -0.35 THEN 'bear' WHEN index >= 0.35 THEN 'bullish' ELSE 'neutral' END AS label FROM mk",
}


def market_axis(v):
    terms = v.table("events").select(
        (F.col("event_id") % 300).alias("opp"), F.expr("CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'comparable' WHEN 'signup' THEN 'review' WHEN 'error' THEN CASE WHEN event_id % 9 = 0 THEN 'wind_down' ELSE 'none' END ELSE 'press' END").alias("kind"),
        F.expr("CASE WHEN event_type = 'view' THEN value - 40 ELSE value END").alias("value"), F.col("ts").alias("at"),
    )
    return S.axis_market(terms.filter("kind <> 'none'"), "opp", v.person().filter("person_id % 2 = 0").select(F.col("person_id").alias("opp"), ((F.col("person_id") % 7 - 3) / 10.0).alias("shift")))


@query("f11_axis_market", "SELECT opp, n, index, label FROM mkl", TERMS)
def market(v):
    return market_axis(v)


@query("f14_sector_writeback", "SELECT opp, sector, CASE WHEN n > 20 THEN round(0.5 * index, 3) END AS written, round(coalesce(sum(CASE WHEN n > 20 THEN round(0.5 * index, 3) END) OVER (PARTITION BY sector ORDER BY opp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS prior FROM (SELECT *, 'sector ' || (opp % 6) AS sector FROM mk)", TERMS)
def writeback(v):
    own = market_axis(v).withColumn("sector", F.concat(F.lit("sector "), (F.col("opp") % 6).cast("string"))).withColumn("m", F.greatest(F.col("n") - 20, F.lit(0)))
    return S.sector_writeback(own, "sector", ["opp"], "index", "m").select("opp", "sector", "written", "prior")


KIND = "CASE event_type WHEN 'view' THEN 'domain' WHEN 'click' THEN 'cadence' WHEN 'signup' THEN CASE WHEN event_id % 7 = 0 THEN 'verified' ELSE 'none' END WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'contradicted' ELSE 'none' END ELSE CASE WHEN event_id % 11 = 0 THEN 'comparable' ELSE 'none' END END"
LATEST = "CASE event_id % 8 WHEN 0 THEN 'transacting' WHEN 1 THEN 'pricing_page' WHEN 2 THEN 'changelog' WHEN 3 THEN 'calendly' WHEN 4 THEN 'waitlist' WHEN 5 THEN 'parked' WHEN 6 THEN 'unreachable' ELSE 'other' END"


@query("f12_axis_fit", """SELECT opp, n, point, round(least(greatest(point - h, 0), 100), 1) AS low, round(least(greatest(point + h, 0), 100), 1) AS high, point >= 50 AS survives, CASE WHEN point < 50 THEN round(build_low, 1) >= 60 END AS carries FROM (SELECT *, round(w * direct + (1 - w) * least(greatest(50 + 8 * coalesce(shift, 0), 0), 100), 1) AS point, least(45, 7 + 20 * (1 - w) + 2.5 * coalesce(widening, 0)) AS h FROM (SELECT *, n / (n + 5) AS w,
        least(greatest(50 + coalesce(st, 0) + 8 * CASE WHEN ok THEN least(greatest((la - fi) / fi, -1), 1) ELSE 0 END + 5 * coalesce(g, 0) - 8 * coalesce(b, 0) - 6 * least(coalesce(co, 0), 2) + CASE label WHEN 'bullish' THEN 6 WHEN 'bear' THEN -6 ELSE 0 END, 0), 100) AS direct
    FROM (SELECT *, CAST(coalesce(other, 0) + CASE WHEN ok THEN nc ELSE 0 END + coalesce(market_n, 0) AS BIGINT) AS n FROM (SELECT *, coalesce(nc >= 2 AND fi > 0, FALSE) AS ok FROM fitted FULL JOIN fctx USING (opp)))))""",
    TERMS | {"fit": f"SELECT CAST(event_id % 300 AS BIGINT) AS opp, {KIND} AS kind, {LATEST} AS state, value, ts AS tm FROM events",
    "fitted": "SELECT opp, count(*) FILTER (kind <> 'cadence') AS other, arg_max(CASE state WHEN 'transacting' THEN 12 WHEN 'pricing_page' THEN 6 WHEN 'changelog' THEN 4 WHEN 'waitlist' THEN -4 WHEN 'parked' THEN -10 WHEN 'unreachable' THEN -10 ELSE 0 END, tm) FILTER (kind = 'domain') AS st, count(*) FILTER (kind = 'cadence') AS nc, arg_min(value, tm) FILTER (kind = 'cadence') AS fi, arg_max(value, tm) FILTER (kind = 'cadence') AS la, count(*) FILTER (kind = 'verified') AS g, count(*) FILTER (kind = 'contradicted') AS b, count(*) FILTER (kind = 'comparable') AS co FROM fit WHERE kind <> 'none' GROUP BY 1",
    "fctx": "SELECT mkl.opp, label, mkl.n AS market_n, (person_id % 7 - 3) / 10.0 AS shift, person_id % 4 AS widening, CASE WHEN person_id % 3 > 0 THEN (person_id % 100) / 1.0 END AS build_low FROM mkl LEFT JOIN person ON person_id = mkl.opp"})
def fit(v):
    terms = v.table("events").selectExpr("event_id % 300 AS opp", f"{KIND} AS kind", f"{LATEST} AS state", "value", "ts AS at").filter("kind <> 'none'")
    own = v.person().selectExpr("person_id AS opp", "(person_id % 7 - 3) / 10.0 AS shift", "person_id % 4 AS widening", "CASE WHEN person_id % 3 > 0 THEN (person_id % 100) / 1.0 END AS build_low")
    context = market_axis(v).select("opp", "label", F.col("n").alias("market_n")).join(own, "opp", "left")
    return S.axis_fit(terms, context, "opp", 60.0)


@query("f13_axis_disagreement", "SELECT id, disagree, binding, arg_max(axis, (rank, axis)) FILTER (stance <> bound) AS dissent FROM ax JOIN (SELECT id, count(DISTINCT stance) > 1 AS disagree, arg_min(axis, (rank, axis)) AS binding, arg_min(stance, (rank, axis)) AS bound FROM ax GROUP BY id) USING (id) GROUP BY id, disagree, binding",
    {"ax": """SELECT *, CASE stance WHEN 'bear' THEN 0 WHEN 'bullish' THEN 2 ELSE 1 END AS rank FROM (SELECT id, axis, coalesce(label, CASE WHEN score IS NULL THEN 'unknown' WHEN score < 45 THEN 'bear' WHEN score > 65 THEN 'bullish' ELSE 'neutral' END) AS stance FROM (
    SELECT c_custkey AS id, 'founder' AS axis, c_acctbal / 100 AS score, NULL AS label FROM customer UNION ALL SELECT c_custkey, 'market', NULL, CASE c_custkey % 3 WHEN 0 THEN 'bear' WHEN 1 THEN 'neutral' ELSE 'bullish' END FROM customer UNION ALL SELECT c_custkey, 'idea_vs_market', CASE WHEN c_custkey % 9 > 0 THEN (c_custkey * 53 % 103)::DOUBLE END, NULL FROM customer))"""})
def disagreement(v):
    c = v.table("customer")
    one = lambda axis, score, label: c.selectExpr("c_custkey AS id", f"'{axis}' AS axis", f"cast({score} AS double) AS score", f"cast({label} AS string) AS label")
    market = one("market", "NULL", "CASE c_custkey % 3 WHEN 0 THEN 'bear' WHEN 1 THEN 'neutral' ELSE 'bullish' END")
    return S.axis_disagreement(one("founder", "c_acctbal / 100", "NULL").unionByName(market).unionByName(one("idea_vs_market", "CASE WHEN c_custkey % 9 > 0 THEN c_custkey * 53 % 103 END", "NULL")), "id", 55.0)


PRIOR = "CASE WHEN coalesce({0}, 0) > 0 THEN {1} ELSE {2} END"
PRESENCE = {"hits": "SELECT person_id, count(*) AS n, count(*) FILTER (source_class IN ('registry_filing', 'third_party_observable')) AS m, count(*) FILTER (artifact_type = 'click_0') AS h FROM observation WHERE person_id IS NOT NULL GROUP BY 1",
    "probs": "SELECT person_id, n, sector, region, CASE WHEN h > 0 THEN 0.0 ELSE (1 - 0.18) / ((1 - 0.18) + 0.18 * pow(1 - 0.1, m)) END AS p_absent, CASE WHEN h > 0 THEN 1 - pow(0.5, h) ELSE 0.18 * pow(1 - 0.1, m) / (0.18 * pow(1 - 0.1, m) + (1 - 0.18)) END AS p_present FROM hits JOIN person USING (person_id)"}


def presence(v):
    g = v.observation().filter("person_id IS NOT NULL").groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source_class").isin("registry_filing", "third_party_observable")).alias("m"), F.count_if(F.col("artifact_type") == "click_0").alias("h"))
    args = (F.lit(0.18), F.lit(0.1), F.col("m"), F.col("h"))
    return g.join(v.person().select("person_id", "sector", "region"), "person_id").withColumns({"p_absent": S.p_absent(*args), "p_present": S.p_present(*args)})


@query("f17_p_absent_present", "SELECT person_id, round(p_absent, 9) AS p_absent, round(p_present, 9) AS p_present FROM probs", PRESENCE)
def absent_present(v):
    return presence(v).select("person_id", F.round("p_absent", 9).alias("p_absent"), F.round("p_present", 9).alias("p_present"))


CONSTRAINTS = [
    (1, "sector", "in", ["BUILDING", "MACHINERY"], None, None, None, True, False), (2, "region", "in", ["ASIA"], None, None, None, True, True), (3, "balance", "at_least", None, 0.0, None, None, True, False), (4, "name", "contains", ["13", "#X"], None, None, None, True, True),
    (5, "funding", "evidence", None, None, 0.18, 0.1, False, True), (6, "traction", "evidence", None, None, 0.3, 0.05, False, False), (7, "founder_type", "in", ["technical"], None, None, None, False, False), (8, "nothing_known", "in", ["x"], None, None, None, False, False),
]
THREE = "CASE WHEN ({0}) IS NULL THEN 'unresolved' WHEN {0} THEN '{1}' ELSE '{2}' END"
COMPOUND = {
    "asked": "SELECT p.person_id, sector, region, balance, display_name AS name, coalesce(n, 0) AS n, coalesce(funding, 0) AS funding, coalesce(traction, 0) AS traction, CASE WHEN funding > 2 THEN 'technical' WHEN p.person_id % 3 = 0 THEN 'operator' END AS founder_type, (p.person_id * 7 % 100) / 1.0 AS point FROM person p LEFT JOIN (SELECT person_id, count(*) AS n, count(*) FILTER (artifact_type = 'click_0') AS funding, count(*) FILTER (artifact_type = 'purchase_1') AS traction FROM observation GROUP BY 1) USING (person_id)",
    "states": f"""SELECT *, {THREE.format("sector IN ('BUILDING', 'MACHINERY')", "match", "mismatch")} AS s1, {THREE.format("region = 'ASIA'", "mismatch", "match")} AS s2, {THREE.format("balance >= 0", "match", "mismatch")} AS s3, {THREE.format("contains(lower(name), '13') OR contains(lower(name), '#x')", "mismatch", "match")} AS s4,
        round(CASE WHEN funding > 0 THEN 0.0 ELSE (1 - 0.18) / ((1 - 0.18) + 0.18 * pow(1 - 0.1, n)) END, 4) AS p5, round(CASE WHEN traction > 0 THEN 1 - pow(0.5, traction) ELSE 0.3 * pow(1 - 0.05, n) / (0.3 * pow(1 - 0.05, n) + (1 - 0.3)) END, 4) AS p6, CASE WHEN founder_type IS NULL THEN 0.5 WHEN founder_type = 'technical' THEN 0.95 ELSE 0.05 END::DOUBLE AS p7, 0.5::DOUBLE AS p8 FROM asked""",
    "judged": "SELECT *, 'mismatch' NOT IN (s1, s2, s3, s4) AS kept, (s1 = 'unresolved')::INT + (s2 = 'unresolved')::INT + (s3 = 'unresolved')::INT + (s4 = 'unresolved')::INT AS n_unresolved, p5 * p6 * p7 * p8 AS p_all FROM states",
}


def judged(v):
    from palimpsest.operators import compound as C

    g = v.observation().groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("artifact_type") == "click_0").alias("funding"), F.count_if(F.col("artifact_type") == "purchase_1").alias("traction"))
    people = v.person().select("person_id", "sector", "region", "balance", F.col("display_name").alias("name")).join(g, "person_id", "left").fillna(0, ["n", "funding", "traction"])
    people = people.withColumn("founder_type", F.when(F.col("funding") > 2, "technical").when(F.col("person_id") % 3 == 0, "operator")).withColumn("point", (F.col("person_id") * 7 % 100) / 1.0)
    known = C.attributes(["sector", "region", "name", "founder_type"], ["balance"], ["funding", "traction"])
    return C.evaluate(people, v.spark.createDataFrame(CONSTRAINTS, C.CONSTRAINT), known, "n")


@query("f18_compound_resolve", "SELECT person_id, point, n, concat_ws(',', s1, s2, s3, s4) AS states, concat_ws(',', p5, p6, p7, p8) AS chances, round(p_all, 9) AS p_all FROM judged WHERE kept", COMPOUND)
def compound(v):
    from palimpsest.operators import compound as C

    joined = lambda c, f: F.array_join(F.transform(c, lambda s: s[f].cast("string")), ",")
    return C.ranked(judged(v), "point", "n", "person_id").select("person_id", "point", "n", joined("hard", "state").alias("states"), joined("soft", "p").alias("chances"), F.round("p_all", 9).alias("p_all"))


@query("f18_top", "SELECT person_id, round(p_all, 9) AS p_all FROM judged WHERE kept ORDER BY judged.p_all DESC, point DESC, n DESC, person_id LIMIT 10", COMPOUND)
def compound_top(v):
    from palimpsest.operators import compound as C

    return C.ranked(judged(v), "point", "n", "person_id", 10).select("person_id", F.round("p_all", 9).alias("p_all"))


@query("f18_constraint_chips", " UNION ALL ".join([f"SELECT {i}::INT AS constraint_id, count(*) FILTER (s{i} = 'match') AS n_match, count(*) FILTER (s{i} = 'mismatch') AS n_mismatch, count(*) FILTER (s{i} = 'unresolved') AS n_unresolved, 0 AS n_scored, NULL::DOUBLE AS mean_p FROM judged" for i in range(1, 5)] + [f"SELECT {i}, 0, 0, 0, count(*), round(avg(p{i}), 6) FROM judged WHERE kept" for i in range(5, 9)]), COMPOUND)
def chips(v):
    from palimpsest.operators import compound as C

    return C.constraint_chips(judged(v)).withColumn("mean_p", F.round("mean_p", 6))


@query("f18_cold_start_survival", "SELECT count(*) AS n_total, count(*) FILTER (kept) AS n_kept, count(*) FILTER (kept AND funding = 0) AS n_without_evidence, count(*) FILTER (kept AND n <= 2) AS n_thin, sum(n_unresolved) AS kept_unresolved, TRUE AS applies FROM judged", COMPOUND)
def survival(v):
    from palimpsest.operators import compound as C

    return C.cold_start_survival(judged(v), "n", "funding")


@query("f19_idea_fit", "SELECT doc_id, CASE WHEN n_chars > 300 THEN CASE WHEN source IN ('src1', 'src2') THEN 70.0 ELSE 40.0 END + least(15, 3 * w) + least(10, 2 * (doc_id % 7)) END::DOUBLE AS fit FROM (SELECT *, contains(lower(text), 'license')::INT + contains(lower(text), 'token')::INT + contains(lower(text), 'the')::INT AS w FROM documents)")
def idea(v):
    d = v.table("documents")
    words = sum(F.lower("text").contains(w).cast("int") for w in ("license", "token", "the"))
    return d.select("doc_id", S.idea_fit(F.col("source").isin("src1", "src2"), words, F.col("doc_id") % 7, F.col("n_chars") > 300).cast("double").alias("fit"))


@query("n1_portfolio_conflict", "SELECT opportunity_id, sector, EXISTS (SELECT 1 FROM positions p WHERE p.sector = o.sector) AS conflict, (SELECT count(*) FROM positions) AS n_checked FROM opportunity o", {"positions": "SELECT c_custkey, c_mktsegment AS sector FROM customer WHERE c_acctbal > 9800 AND c_mktsegment IN ('BUILDING', 'HOUSEHOLD')"})
def conflict(v):
    positions = v.table("customer").filter("c_acctbal > 9800 AND c_mktsegment IN ('BUILDING', 'HOUSEHOLD')").select(F.col("c_mktsegment").alias("sector"))
    return S.portfolio_conflict(v.opportunity().select("opportunity_id", "sector"), positions, "sector")
