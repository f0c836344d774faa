"""E: aggregations (E9 and E16 stand with their inputs)."""

from pyspark.sql import functions as F

from palimpsest.operators import aggregates as A
from palimpsest.operators.joins import grouping_cells
from palimpsest.plans.filters import CONSENSUS, consensus
from palimpsest.plans.registry import query
from palimpsest.sources.views import reliability

AT = "2024-01-20 00:00:00"
DIMS = ["sector", "solo_or_team"]
LADDER = [["sector", "solo_or_team"], ["sector"], []]
CELL = "CASE g WHEN 0 THEN 'sector=' || sector || '|solo_or_team=' || shape WHEN 1 THEN 'sector=' || sector ELSE '' END AS cell, CAST(CASE g WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INT) AS level"
PEOPLE = "SELECT person_id, coalesce(sector, 'unknown') AS sector, coalesce(solo_or_team, 'unknown') AS shape FROM person"
HELD = "SELECT DISTINCT person_id, artifact_type FROM observation WHERE person_id IS NOT NULL"


@query("e1_entity_profile", "SELECT person_id, count(*) AS n, min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) FILTER (source_class IN ('registry_filing', 'third_party_observable')) AS n_outside, count(*) FILTER (source_class = 'self_report') AS n_self, round(sum(weight), 3) AS log_odds, array_to_string(list_sort(list(DISTINCT channel_id)), ',') AS channels, array_to_string(list_sort(list(DISTINCT artifact_type)), ',') AS artifacts FROM observation LEFT JOIN reliability USING (source_class) WHERE person_id IS NOT NULL GROUP BY 1")
def profile(v):
    return A.entity_profile(v.observation(), reliability(v.spark)).withColumns({c: F.array_join(c, ",") for c in ("channels", "artifacts")})


@query("e2_class_level_means", f"SELECT level, cell, n, mean FROM (SELECT {CELL}, n, mean FROM (SELECT grouping(sector, shape) AS g, sector, shape, count(*) AS n, round(avg(m), 6) AS mean FROM (SELECT person_id, avg(value) AS m FROM observation WHERE person_id IS NOT NULL GROUP BY 1) JOIN people USING (person_id) GROUP BY GROUPING SETS ((sector, shape), (sector), ())))", {"people": PEOPLE})
def class_means(v):
    own = v.observation().filter("person_id IS NOT NULL").groupBy("person_id").agg(F.avg("value").alias("m"))
    return grouping_cells(own.join(v.person().select("person_id", *DIMS), "person_id"), LADDER, DIMS, {"n": F.count(F.lit(1)), "mean": F.round(F.avg("m"), 6)})


@query("e3_findability_rates", f"""SELECT s.level, s.cell, t.artifact_type, CAST(coalesce(h.k, 0) AS BIGINT) AS k, s.n, round(coalesce(h.k, 0) / s.n, 9) AS p FROM (SELECT {CELL}, n FROM (SELECT grouping(sector, shape) AS g, sector, shape, count(*) AS n FROM people GROUP BY GROUPING SETS ((sector, shape), (sector), ()))) s
    CROSS JOIN (SELECT DISTINCT artifact_type FROM held) t LEFT JOIN (SELECT {CELL}, artifact_type, k FROM (SELECT grouping(sector, shape) AS g, sector, shape, artifact_type, count(*) AS k FROM people JOIN held USING (person_id) GROUP BY GROUPING SETS ((sector, shape, artifact_type), (sector, artifact_type), (artifact_type)))) h ON h.level = s.level AND h.cell = s.cell AND h.artifact_type = t.artifact_type""", {"people": PEOPLE, "held": HELD})
def findability(v):
    held = v.observation().filter("person_id IS NOT NULL").select("person_id", "artifact_type").distinct()
    return A.rates_by_cell(v.person().select("person_id", *DIMS), held, LADDER, DIMS).withColumn("p", F.round("p", 9))


MOM = {
    "val": "SELECT claim_type AS component, person_id, value FROM observation WHERE person_id IS NOT NULL AND (claim_type <> 'error' OR observation_id % 40 = 0)",
    "grp": "SELECT component, person_id, count(*) AS n, avg(value) AS mean, var_pop(value) * count(*) AS ss FROM val GROUP BY 1, 2",
    "lev": "SELECT component, count(*) AS n_groups, count(*) FILTER (n >= 2) AS n_multi, sum(ss) FILTER (n >= 2) / nullif(sum(n - 1) FILTER (n >= 2), 0) AS within, var_pop(mean) AS between_, avg(1 / n) AS inv FROM grp GROUP BY 1",
    "sig": "SELECT *, n_multi >= 20 AS identified, CASE WHEN n_multi >= 20 THEN within ELSE all_ END AS sigma2 FROM lev JOIN (SELECT component, var_pop(value) AS all_ FROM val GROUP BY 1) USING (component)",
    "tau": "SELECT *, CASE WHEN identified THEN greatest(between_ - sigma2 * inv, sigma2 / 50, 1e-9) END AS tau2 FROM sig",
}


@query("e5_mom_shrinkage", "SELECT component, n_groups, n_multi, round(sigma2, 6) AS sigma2, round(tau2, 6) AS tau2, round(coalesce(CASE WHEN identified THEN least(greatest(sigma2 / tau2, 1), 50) END, (SELECT least(greatest(sigma2 / tau2, 1), 50) FROM tau WHERE identified ORDER BY n_multi DESC LIMIT 1), least(greatest(sigma2 / greatest(between_, sigma2 / 50), 1), 50), 4), 6) AS k, identified FROM tau", MOM)
def shrinkage(v):
    rows = v.observation().filter("person_id IS NOT NULL AND (claim_type <> 'error' OR observation_id % 40 = 0)")
    out = A.mom_shrinkage(rows.select(F.col("claim_type").alias("component"), "person_id", "value"), "component", "person_id", "value", least_groups=60)
    return out.withColumns({c: F.round(c, 6) for c in ("sigma2", "tau2", "k")})


SECTORED = "SELECT o.*, p.sector FROM observation o JOIN person p USING (person_id)"


@query("e6_momentum_label", """SELECT sector, n_now, n_before, CASE WHEN n_now + n_before < 8 THEN 'neutral' WHEN n_now > 1.25 * n_before THEN 'bullish' WHEN n_now * 1.25 < n_before THEN 'bear' ELSE 'neutral' END AS label FROM (SELECT sector, count(*) FILTER (observed_at >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND observed_at <= TIMESTAMP '2024-01-20') AS n_now,
    count(*) FILTER (observed_at >= TIMESTAMP '2024-01-20' - INTERVAL 14 DAY AND observed_at < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY) AS n_before FROM sectored GROUP BY 1)""", {"sectored": SECTORED})
def momentum(v):
    return A.momentum(v.observation().join(v.person().select("person_id", "sector"), "person_id"), "sector", AT, days=7)


@query("e7_reference_class_mean", """SELECT sector, solo_or_team, resource_tier, region_known, n, round(mean, 6) AS mean, round(n / (n + 20) * mean + 20 / (n + 20) * all_, 6) AS shrunk, n < 20 AS thin FROM (SELECT sector, solo_or_team, resource_tier, region IS NOT NULL AS region_known, count(*) AS n, avg(y) AS mean FROM prof GROUP BY ALL), (SELECT avg(y) AS all_ FROM prof)""",
    {"prof": "SELECT *, 100 / (1 + exp(-log_odds / 6)) AS y FROM (SELECT person_id, round(sum(weight), 3) AS log_odds FROM observation LEFT JOIN reliability USING (source_class) WHERE person_id IS NOT NULL GROUP BY 1) JOIN person USING (person_id)"})
def class_mean(v):
    p = A.entity_profile(v.observation(), reliability(v.spark)).select("person_id", "log_odds").join(v.person(), "person_id").withColumn("region_known", F.col("region").isNotNull())
    out = A.reference_class_means(p, ["sector", "solo_or_team", "resource_tier", "region_known"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "shrunk")})


KINDS = ["corroborating", "contradicting", "expected_absent", "withdrawn"]


@query("e8_distribution_by_state", " UNION ALL ".join(f"SELECT '{s}' AS state, count(*) FILTER (kind = '{s}') AS n, count(*) - count(*) FILTER (kind = 'expected_absent') AS extracted FROM evidence" for s in KINDS))
def distribution(v):
    return A.state_distribution(v.evidence(), "kind", KINDS, "expected_absent")


EDGE_AT = "2024-02-08 00:00:00"
REGISTERED = [("ch0", "discovery", True, True), ("ch1", "discovery", True, True), ("ch2", "discovery", False, True), ("ch3", "confirmation", True, True), ("ch4", "discovery", True, True), ("ch9", "discovery", True, True)]
BUILT = ["ch4"]
LAGS = {
    "seen": f"SELECT *, {CONSENSUS} AS c, split_part(channel_id, '#v', 1) AS base FROM observation WHERE observed_at <= TIMESTAMP '{EDGE_AT}'",
    "lag_rows": f"SELECT channel_id, person_id, round(date_diff('microsecond', first_signal, first_consensus) / 86400000000.0, 1) AS lag_days, round(date_diff('microsecond', first_signal, TIMESTAMP '{EDGE_AT}') / 86400000000.0, 1) AS followed_days FROM (SELECT base AS channel_id, person_id, min(observed_at) AS first_signal FROM seen WHERE person_id IS NOT NULL AND base IS NOT NULL GROUP BY 1, 2) LEFT JOIN (SELECT person_id, min(observed_at) AS first_consensus FROM seen WHERE c GROUP BY 1) USING (person_id)",
    "registered": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{k}', {n}, {a})" for c, k, n, a in REGISTERED) + ") AS r(channel_id, kind, native, active)",
    "edges": f"""SELECT channel_id, registered, kind, native, active, n_lags, n_censored, n_late, CASE basis WHEN 'by_construction' THEN 0 WHEN 'measured' THEN median_ END::DOUBLE AS median_days_edge, censored_followed, volume, volume_denominator, n_rows, n_unkeyed, basis, basis = 'measured' AND n_lags < 12 AS thin
        FROM (SELECT *, CASE WHEN kind = 'confirmation' THEN 'not_applicable' WHEN channel_id IN ('{"', '".join(BUILT)}') THEN 'by_construction' WHEN n_lags > 0 THEN 'measured' WHEN n_censored > 0 THEN 'fully_censored' ELSE 'insufficient' END AS basis, (SELECT count(*) FROM seen WHERE base IS NOT NULL AND observed_at > TIMESTAMP '{EDGE_AT}' - INTERVAL 30 DAY) AS volume_denominator
        FROM (SELECT channel_id, r.channel_id IS NOT NULL AS registered, coalesce(kind, 'unregistered') AS kind, coalesce(native, FALSE) AS native, coalesce(active, TRUE) AS active, coalesce(n_lags, 0) AS n_lags, coalesce(n_censored, 0) AS n_censored, coalesce(n_late, 0) AS n_late, median_, censored_followed, coalesce(volume, 0) AS volume, coalesce(n_rows, 0) AS n_rows, coalesce(n_unkeyed, 0) AS n_unkeyed
        FROM registered r FULL JOIN (SELECT channel_id, count(lag_days) AS n_lags, count(*) FILTER (lag_days IS NULL) AS n_censored, median(lag_days) AS median_, median(followed_days) FILTER (lag_days IS NULL) AS censored_followed, count(*) FILTER (lag_days < 0) AS n_late FROM lag_rows GROUP BY 1) USING (channel_id)
        FULL JOIN (SELECT base AS channel_id, count(*) FILTER (observed_at > TIMESTAMP '{EDGE_AT}' - INTERVAL 30 DAY) AS volume, count(*) AS n_rows, count(*) FILTER (person_id IS NULL) AS n_unkeyed FROM seen WHERE base IS NOT NULL GROUP BY 1) USING (channel_id)) WHERE registered OR n_lags + n_censored + volume > 0)""",
}


def lag_rows(v):
    return A.lags(v.observation(), consensus(), EDGE_AT)


def channel_edges(v):
    return A.days_of_edge(v.observation(), consensus(), v.spark.createDataFrame(REGISTERED, "channel_id string, kind string, native boolean, active boolean"), EDGE_AT, BUILT)


@query("e10_days_of_edge", "SELECT * FROM edges", LAGS)
def edges(v):
    return channel_edges(v)


#: l for n up to 400, from exact binomial sums, as rows for SQL.
INDEX = ", ".join(f"({n}, {A.order_index(n)})" for n in range(1, 401))


@query("e11_median_order_ci", """SELECT k.channel_id, coalesce(n, 0) AS n, CASE WHEN l >= 1 AND n >= 6 THEN xs[CAST(l + 1 AS BIGINT)] ELSE list_min(xs) END AS ci_low, CASE WHEN l >= 1 AND n >= 6 THEN xs[CAST(n - l AS BIGINT)] ELSE list_max(xs) END AS ci_high, CASE WHEN n IS NULL THEN 'insufficient' WHEN n = 1 THEN 'single' WHEN l >= 1 AND n >= 6 THEN 'order_statistic_95' ELSE 'observed_range' END AS ci_kind
    FROM (SELECT DISTINCT channel_id FROM lag_rows) k LEFT JOIN (SELECT channel_id, count(*) AS n, list_sort(list(lag_days)) AS xs FROM lag_rows WHERE lag_days IS NOT NULL GROUP BY 1) USING (channel_id) LEFT JOIN (SELECT * FROM (VALUES """ + INDEX + ") AS i(n_, l)) ON n_ = n", {k: LAGS[k] for k in ("seen", "lag_rows")})
def intervals(v):
    return A.median_interval(lag_rows(v), "channel_id", "lag_days")


@query("e12_coverage_gap_flag", """SELECT channel_id, CASE WHEN m >= 3 THEN coalesce(basis = 'measured' AND median_days_edge > 0 AND median_days_edge >= e AND volume <= vol AND active AND native, FALSE) ELSE coalesce(basis = 'measured' AND median_days_edge > 0 AND median_days_edge >= 14 AND volume < 10 AND active AND native, FALSE) END AS coverage_gap
    FROM edges, (SELECT count(*) AS m, median(median_days_edge) AS e, median(volume) AS vol FROM edges WHERE basis = 'measured' AND median_days_edge > 0)""", LAGS)
def gaps(v):
    return A.coverage_gap(channel_edges(v)).select("channel_id", "coverage_gap")


@query("e13_revealing_rate", "SELECT greatest(least(count(*) FILTER (source_class IN ('registry_filing', 'third_party_observable')) / count(*), 0.9), 0.02) AS rate FROM observation")
def rate(v):
    return A.revealing_rate(v.observation(), ["registry_filing", "third_party_observable"])


SHIFTS = {"shifts": "SELECT CAST(o_orderkey AS BIGINT) AS written_by, CASE o_orderkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' ELSE 'FURNITURE' END AS sector, CASE WHEN o_orderkey % 2 = 0 THEN 'market' ELSE 'founder' END AS axis, (o_orderkey % 21 - 10) / 10.0 AS shift, o_orderdate AS observed_at FROM orders"}


@query("e15_prior_shift", "SELECT sector, axis, round(sum(shift), 3) AS shift, count(*) AS n FROM shifts WHERE observed_at <= TIMESTAMP '1999-01-01' AND NOT EXISTS (SELECT 1 FROM opportunity WHERE opportunity_id = written_by AND status = 'P') GROUP BY ALL", SHIFTS)
def shifts(v):
    rows = v.table("orders").select(F.col("o_orderkey").alias("written_by"), F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' ELSE 'FURNITURE' END").alias("sector"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'market' ELSE 'founder' END").alias("axis"), ((F.col("o_orderkey") % 21 - 10) / 10.0).alias("shift"), F.col("o_orderdate").cast("timestamp_ntz").alias("observed_at"))
    return A.prior_shift(rows, "1999-01-01 00:00:00", v.opportunity().filter("status = 'P'"))


@query("e17_narrowing", "SELECT person_id, arg_min(width, (observed_at, claim_id)) AS first_width, arg_max(width, (observed_at, claim_id)) AS last_width FROM (SELECT *, CAST(claim_id * 31 % 97 AS BIGINT) AS width FROM claim) GROUP BY 1 HAVING last_width < first_width")
def narrowing(v):
    rows = v.claim().select("person_id", (F.col("claim_id") * 31 % 97).alias("width"), F.struct("observed_at", "claim_id").alias("at"))
    return A.narrowing(rows, "person_id", "at", "width")


@query("e18_manifest_summary", "SELECT claim_id, count(*) AS n_rows, count(*) FILTER (found) AS n_found, count(*) FILTER (NOT found AND expected) AS n_missing, count(*) FILTER (NOT found AND NOT expected) AS n_harmless, count(*) FILTER (penalised) AS n_penalised, round(sum(interval_widen), 6) AS widen FROM evidence GROUP BY 1")
def manifest(v):
    return A.manifest_summary(v.evidence().withColumn("widen", F.col("interval_widen")), "claim_id")
