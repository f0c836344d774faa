"""H: window and temporal operators, T6, N3, and E9 on top of H5."""

from pyspark.sql import functions as F

from palimpsest.operators import temporal as T
from palimpsest.plans.registry import query

AT = "2024-01-20 00:00:00"


@query("h1_version_number", "SELECT claim_id, person_id, CAST(coalesce(m, 0) + row_number() OVER (PARTITION BY person_id ORDER BY observed_at, claim_id) AS BIGINT) AS version_number FROM (SELECT * FROM claim WHERE claim_id % 5 = 0) LEFT JOIN (SELECT person_id, count(*) AS m FROM claim WHERE claim_id % 5 <> 0 GROUP BY 1) USING (person_id)")
def versions(v):
    c = v.claim()
    held = c.filter("claim_id % 5 <> 0").groupBy("person_id").agg(F.count(F.lit(1)).alias("version_number"))
    return T.next_versions(c.filter("claim_id % 5 = 0"), held, ["person_id"], ["observed_at", "claim_id"]).select("claim_id", "person_id", "version_number")


STEPS = "SELECT person_id, claim_id, observed_at, CASE WHEN claim_id % 7 <> 0 THEN CAST(floor(stated_value / 50000) AS BIGINT) END AS point, CASE WHEN claim_id % 11 <> 0 THEN stated_value END AS low FROM claim"


@query("h2_score_step_function", "SELECT person_id, claim_id, point, row_number() OVER w = 1 OR point IS DISTINCT FROM lag(point) OVER w AS changed FROM s WHERE point IS NOT NULL OR low IS NOT NULL WINDOW w AS (PARTITION BY person_id ORDER BY observed_at, claim_id)", {"s": STEPS})
def steps(v):
    rows = v.claim().select("person_id", "claim_id", "observed_at", F.expr("CASE WHEN claim_id % 7 <> 0 THEN cast(floor(stated_value / 50000) AS bigint) END").alias("point"), F.expr("CASE WHEN claim_id % 11 <> 0 THEN stated_value END").alias("low"))
    return T.step_function(rows, ["person_id"], ["observed_at", "claim_id"], "point", "low").select("person_id", "claim_id", "point", "changed")


DURATIONS = "SELECT *, coalesce(exited_at, lead(entered_at) OVER (PARTITION BY opportunity_id ORDER BY entered_at, stage)) AS ended_at FROM stage"
MINUTES = "round(date_diff('microsecond', {1}, {0}) / 60000000.0, 1)"


@query("h3_stage_durations", f"SELECT opportunity_id, stage, ended_at, {MINUTES.format('ended_at', 'entered_at')} AS minutes, ended_at IS NULL AS is_open FROM d", {"d": DURATIONS})
def durations(v):
    return T.stage_durations(v.stage()).select("opportunity_id", "stage", "ended_at", "minutes", "is_open")


@query("h4_asof_slices", " UNION ALL ".join(f"SELECT CAST({d} AS BIGINT) AS days_before, count(*) FILTER (observed_at <= TIMESTAMP '2024-01-31' - INTERVAL {d} DAY) AS n_visible, count(*) AS n_total FROM observation" for d in (24, 16, 8, 0)))
def slices(v):
    return T.asof_slices(v.observation(), "2024-01-31 00:00:00", [24, 16, 8, 0])


TIMING = {
    "d": DURATIONS,
    "dm": f"SELECT *, {MINUTES.format('ended_at', 'entered_at')} AS minutes FROM d",
    "own": "SELECT opportunity_id, min(entered_at) AS first_stage_at, min(entered_at) FILTER (stage = 'decision') AS decided_at, arg_max(stage, (entered_at, stage)) AS last_stage, arg_max(exited_reason, (entered_at, stage)) AS last_reason, sum(minutes) FILTER (wait_is_human) AS human FROM dm GROUP BY 1",
    "timing": f"""SELECT opportunity_id, signal AS first_signal_at, decided_at, state, CASE WHEN state IN ('stalled', 'closed') THEN last_stage END AS stalled_in, {MINUTES.format("coalesce(decided_at, TIMESTAMP '2003-01-01')", 'first_stage_at')} AS elapsed_minutes, round(coalesce(human, 0.0), 1) AS human_minutes, round(date_diff('microsecond', signal, opened_at) / 86400000000.0, 1) AS discovery_lag_days
        FROM (SELECT *, coalesce(first_signal_at, seen, first_stage_at) AS signal, CASE WHEN first_stage_at IS NULL THEN 'not_entered' WHEN decided_at IS NOT NULL THEN 'decided' WHEN last_reason = 'screened_out' THEN 'closed' ELSE 'stalled' END AS state
        FROM opportunity LEFT JOIN own USING (opportunity_id) LEFT JOIN (SELECT person_id, min(observed_at) AS seen FROM observation WHERE person_id IS NOT NULL GROUP BY 1) USING (person_id))""",
}


def timing(v):
    return T.opportunity_timing(v.stage(), v.opportunity(), v.observation(), "2003-01-01 00:00:00", ["decision"])


@query("h5_opportunity_timing", "SELECT * FROM timing", TIMING)
def opportunity_timing(v):
    return timing(v)


@query("e9_cohort_timing", """SELECT count(*) AS n, count(*) FILTER (state = 'decided') AS n_decided, count(*) FILTER (state = 'stalled') AS n_stalled, count(*) FILTER (state = 'closed') AS n_closed, round(100 * count(*) FILTER (state = 'decided') / count(*), 1) AS decided_pct, round(100 * count(*) FILTER (state IN ('stalled', 'closed')) / count(*), 1) AS stalled_pct,
    median(elapsed_minutes) FILTER (state = 'decided') AS median_minutes, median(elapsed_minutes - human_minutes) FILTER (state = 'decided') AS median_machine_minutes, median(human_minutes) FILTER (state = 'decided') AS median_human_minutes, median(discovery_lag_days) AS median_lag_days FROM timing WHERE state <> 'not_entered'""", TIMING)
def cohort(v):
    return T.cohort_timing(timing(v))


@query("e9_stall_breakdown", "SELECT coalesce(stalled_in, 'unknown') AS stage, count(*) FILTER (state = 'stalled') AS n_stalled, count(*) FILTER (state = 'closed') AS n_closed, count(*) AS n FROM timing WHERE state IN ('stalled', 'closed') GROUP BY 1", TIMING)
def stalls(v):
    return T.stall_breakdown(timing(v))


@query("e9_stage_medians", "SELECT stage, count(minutes) AS n, median(minutes) AS median_minutes FROM dm GROUP BY stage", {k: TIMING[k] for k in ("d", "dm")})
def stage_medians(v):
    from palimpsest.operators.ranking import medians

    rows = T.stage_durations(v.stage())
    return rows.groupBy("stage").agg(F.count("minutes").alias("n")).join(medians(rows, ["stage"], {"median_minutes": F.col("minutes")}), "stage", "left")


TREND = """SELECT person_id, n_points, slope, half_width, CASE WHEN slope IS NULL THEN 'insufficient_data' WHEN slope - half_width > 0 THEN 'improving' WHEN slope + half_width < 0 THEN 'declining' ELSE 'stable' END AS trend FROM (
    SELECT person_id, n_points, CASE WHEN n_points >= 3 AND sxx > 0 THEN round(b * 30, 2) END AS slope, CASE WHEN n_points >= 3 AND sxx > 0 THEN round(CASE n_points - 2 WHEN 1 THEN 12.706 WHEN 2 THEN 4.303 WHEN 3 THEN 3.182 WHEN 4 THEN 2.776 WHEN 5 THEN 2.571 WHEN 6 THEN 2.447 ELSE 1.96 END * sqrt(greatest(0, syy - sxy * sxy / sxx) / (n_points - 2) / sxx) * 30, 2) END AS half_width
    FROM (SELECT person_id, count(*) AS n_points, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM (SELECT person_id, date_diff('day', TIMESTAMP '1990-01-01', observed_at)::DOUBLE AS x, round(stated_value / 1000, 0) AS y FROM claim) GROUP BY person_id))"""


@query("h6_ols_trend", TREND)
def trend(v):
    points = v.claim().select("person_id", F.date_diff("observed_at", F.lit("1990-01-01").cast("date")).cast("double").alias("x"), F.round(F.col("stated_value") / 1000, 0).alias("y"))
    return T.ols_trend(points, ["person_id"], "x", "y", per=30.0, digits=2)


@query("h7_multi_asof_rescore", " UNION ALL ".join(f"SELECT CAST({d} AS BIGINT) AS slice, person_id, count(*) AS n, round(sum(weight), 6) AS log_odds FROM observation JOIN reliability USING (source_class) WHERE observed_at <= TIMESTAMP '2024-01-31' - INTERVAL {d} DAY GROUP BY person_id" for d in (24, 16, 8, 0)))
def rescore(v):
    from palimpsest.sources.views import reliability

    rows = T.visible_slices(v.observation(), "2024-01-31 00:00:00", [24, 16, 8, 0])
    return rows.join(F.broadcast(reliability(v.spark)), "source_class").groupBy("slice", "person_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("log_odds"))


CHANNELS = "SELECT channel_id || CASE WHEN v > 1 THEN '#v' || CAST(v AS VARCHAR) ELSE '' END AS channel, v, max(observed_at) AS computed_at, count(*) AS n, round(avg(value), 6) AS edge FROM (SELECT *, 1 + observation_id % 3 AS v FROM observation) GROUP BY channel_id, v"


def channel_versions(v):
    rows = v.observation().withColumn("v", 1 + F.col("observation_id") % 3)
    return rows.groupBy("channel_id", "v").agg(F.max("observed_at").alias("computed_at"), F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("edge")).withColumn("channel", F.concat("channel_id", F.when(F.col("v") > 1, F.concat(F.lit("#v"), F.col("v").cast("string"))).otherwise("")))


@query("t6_collapse_versions", "SELECT split_part(channel, '#v', 1) AS base, arg_max(channel, (computed_at, v)) AS channel FROM c WHERE computed_at <= TIMESTAMP '2024-02-01' GROUP BY 1", {"c": CHANNELS})
def collapse(v):
    return T.collapse_versions(channel_versions(v), "channel", ["computed_at", "v"], "2024-02-01 00:00:00", "computed_at").select("base", "channel")


@query("h8_version_append_if_changed", """SELECT nw.base, nw.n, nw.edge FROM (SELECT channel_id AS base, count(*) AS n, round(avg(value), 6) AS edge FROM observation WHERE channel_id IN ('ch0', 'ch1') OR k > 10 GROUP BY 1) nw
    LEFT JOIN (SELECT split_part(channel, '#v', 1) AS base, n, edge, row_number() OVER (PARTITION BY split_part(channel, '#v', 1) ORDER BY v DESC) AS nth FROM c) cur ON cur.base = nw.base AND nth = 1 WHERE cur.n IS NULL OR abs(cur.n - nw.n) > 1e-6 OR abs(cur.edge - nw.edge) > 1e-6""", {"c": CHANNELS})
def append_changed(v):
    now = v.observation().filter("channel_id IN ('ch0', 'ch1') OR k > 10").groupBy(F.col("channel_id").alias("base")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("edge"))
    current = T.collapse_versions(channel_versions(v), "channel", ["v"], "2025-01-01 00:00:00", "computed_at").select("base", "n", "edge")
    return T.changed_versions(now, current, "base", ["n", "edge"])


@query("h9_account_age_footprint", "SELECT user_id, n_items, first_at, age_days, age_days <= 90 AS is_young, n_items <= 60 AS low_footprint FROM (SELECT user_id, count(*) AS n_items, min(ts) AS first_at, round(date_diff('microsecond', min(ts), TIMESTAMP '2024-03-31') / 86400000000.0, 1) AS age_days FROM events GROUP BY 1)")
def footprint(v):
    rows = v.table("events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return T.account_footprint(rows, "user_id", "ts", "2024-03-31 00:00:00").select("user_id", "n_items", "first_at", "age_days", "is_young", "low_footprint")


@query("n3_sla_state", "SELECT opportunity_id, CASE WHEN state = 'decided' THEN 'closed' WHEN opened_at + INTERVAL 30 DAY < TIMESTAMP '1999-01-01' THEN 'breached' WHEN opened_at + INTERVAL 30 DAY < TIMESTAMP '1999-01-01' + INTERVAL 10 DAY THEN 'at_risk' ELSE 'on_track' END AS sla_state FROM opportunity JOIN timing USING (opportunity_id)", TIMING)
def sla(v):
    both = v.opportunity().select("opportunity_id", "opened_at").join(timing(v).select("opportunity_id", "state"), "opportunity_id")
    return both.select("opportunity_id", T.sla_state(F.col("state") == "decided", F.col("opened_at") + F.expr("INTERVAL 30 DAYS"), "1999-01-01 00:00:00", 10).alias("sla_state"))
