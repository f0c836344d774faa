"""E, F, H: a population fitted at one instant and at four; classes, rates, constants, scores, trends."""

from pyspark.sql import functions as F

from palimpsest.operators import population as P
from palimpsest.operators import temporal as T
from palimpsest.plans.registry import query
from palimpsest.plans.scoring import CLAIMS, SIG, scored
from palimpsest.sources.views import reliability

END, SLICES = "2024-01-31 00:00:00", [24, 16, 8, 0]


def rung(level: int, dims: list[str]) -> str:
    return f"{level} AS level, {'list_value(' + ', '.join(dims) + ')' if dims else 'CAST([] AS VARCHAR[])'} AS cell"


def ladder(source: str, rungs: list[list[str]], aggs: str, by: str = "slice") -> str:
    return " UNION ALL ".join(f"SELECT {by}, {rung(i, r)}, {aggs} FROM {source} GROUP BY {', '.join([by, *r])}" for i, r in enumerate(rungs))


def climb(rungs: list[list[str]], columns: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns}, {rung(i, r)} FROM {source}" for i, r in enumerate(rungs))


def pooled(source: str) -> str:
    bound = "greatest(least(coalesce({0}, 1), 50), 1)"
    own = bound.format("CASE WHEN n_multi >= 20 THEN sigma2 / greatest(between_ - sigma2 * inv, sigma2 / 50, 1e-9) ELSE sigma2 / nullif(greatest(between_, sigma2 / 50), 0) END")
    return f"""SELECT *, {own} AS own_k, n_multi >= 20 AS identified FROM (SELECT *, CASE WHEN n_multi >= 20 THEN ss / df WHEN total > 1 THEN greatest(0, (inner_ + square) / total - grand_mean * grand_mean) ELSE 0.04 END AS sigma2
        FROM (SELECT slice, component, count(*) AS n_groups, count(*) FILTER (n >= 2) AS n_multi, sum(n) AS total, sum(ss) AS inner_, sum(n * mean * mean) AS square, sum(n * mean) / sum(n) AS grand_mean, sum(ss) FILTER (n >= 2) AS ss, sum(n - 1) FILTER (n >= 2) AS df, var_pop(mean) AS between_, avg(1 / n) AS inv FROM {source} GROUP BY 1, 2))"""


def fit(slices: list[int]) -> dict[str, str]:
    """The whole fit in SQL."""
    dims = ", ".join(P.CLASS_LADDER[0])
    return CLAIMS | {
        "sl": f"SELECT CAST(d AS BIGINT) AS slice, TIMESTAMP '2024-01-31' - d * INTERVAL 1 DAY AS until FROM (VALUES {', '.join(f'({d})' for d in slices)}) AS t(d)",
        "ppl": "SELECT slice, person_id, coalesce(sector, 'unknown') AS sector, coalesce(solo_or_team, 'unknown') AS solo_or_team, coalesce(resource_tier, 'unknown') AS resource_tier, coalesce(region, 'unknown') AS region FROM person JOIN sl ON TIMESTAMP '2024-01-01' + (person_id % 12) * INTERVAL 1 DAY <= until",
        "ob": "SELECT slice, o.*, (k % 100) / 100.0 AS base, CASE WHEN is_milestone THEN 'launch' END AS milestone_type FROM observation o JOIN sl ON o.observed_at <= until JOIN (SELECT slice, person_id FROM ppl) USING (slice, person_id)",
        "res": "SELECT slice, person_id, claim_id, posterior FROM (SELECT person_id % 400 AS person_id, claim_id, posterior FROM scored WHERE state IN ('verified', 'contradicted')) JOIN sl ON TIMESTAMP '2024-01-01' + (claim_id % 30) * INTERVAL 1 DAY <= until JOIN (SELECT slice, person_id FROM ppl) USING (slice, person_id)",
        "prof": "SELECT ppl.*, coalesce(primary_artifact, 'none') AS primary_artifact FROM ppl LEFT JOIN (SELECT slice, person_id, arg_min(artifact_type, (-c, f)) AS primary_artifact FROM (SELECT slice, person_id, artifact_type, count(*) AS c, min((observed_at, observation_id)) AS f FROM ob GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (slice, person_id)",
        "held": "SELECT DISTINCT slice, person_id, artifact_type FROM ob",
        "sizes": ladder("prof", P.RATE_LADDER, "count(*) AS n"),
        "parts": ladder("held JOIN prof USING (slice, person_id)", P.RATE_LADDER, "count(*) AS k", "slice, artifact_type"),
        "rates": "SELECT slice, level, cell, artifact_type, k, n, k / n AS p FROM parts JOIN sizes USING (slice, level, cell)",
        "mine": f"SELECT slice, person_id, min(level) AS level, arg_min(cell, level) AS cell FROM ({climb(P.RATE_LADDER, 'slice, person_id', 'prof')}) JOIN sizes USING (slice, level, cell) WHERE n >= 12 OR level = 4 GROUP BY 1, 2",
        "streams": f"""SELECT slice, person_id, 'credibility' AS component, source_class AS stream, {SIG.format('coalesce(weight, 0)')} AS y FROM (SELECT DISTINCT slice, person_id, source_class FROM ob WHERE (slice, person_id) NOT IN (SELECT (slice, person_id) FROM res)) LEFT JOIN reliability USING (source_class)
            UNION ALL SELECT slice, person_id, 'credibility', 'claim ' || claim_id, posterior FROM res
            UNION ALL SELECT slice, person_id, 'build', artifact_type || coalesce('/' || milestone_type, ''), least(greatest(base + 0.5 * (coalesce(w.p, 0) - coalesce(c.p, 0)), 0), 1) FROM (SELECT slice, person_id, artifact_type, milestone_type, arg_min(base, (observed_at, observation_id)) AS base FROM ob GROUP BY 1, 2, 3, 4)
                JOIN mine USING (slice, person_id) LEFT JOIN rates c USING (slice, level, cell, artifact_type) LEFT JOIN (SELECT slice, artifact_type, p FROM rates WHERE level = 4) w USING (slice, artifact_type)""",
        "grp": "SELECT slice, person_id, component, count(*) AS n, avg(y) AS mean, var_pop(y) * count(*) AS ss FROM streams GROUP BY 1, 2, 3",
        "cells": ladder("(SELECT slice, component, mean AS m, " + dims + " FROM grp JOIN prof USING (slice, person_id))", P.CLASS_LADDER, "count(*) AS n, avg(m) AS mean, var_pop(m) * count(*) AS ss", "slice, component"),
        "pool": pooled("grp"),
        "cellpool": pooled("(SELECT * FROM cells WHERE level = 0 AND n > 1)"),
        "constants": """SELECT slice, component, coalesce(n_groups, 0) AS n_groups, coalesce(n_multi, 0) AS n_multi, coalesce(sigma2, 0.04) AS sigma2, coalesce(k, 4) AS k, coalesce(grand_mean, 0.5) AS grand_mean, coalesce(identified, FALSE) AS identified, coalesce(k_cell, k, 4) AS k_cell FROM (SELECT slice, component FROM (SELECT DISTINCT slice FROM ppl) CROSS JOIN (VALUES ('credibility'), ('build')) AS v(component))
            LEFT JOIN (SELECT *, CASE WHEN identified THEN own_k ELSE coalesce(donor, own_k) END AS k FROM pool LEFT JOIN (SELECT slice, arg_max(own_k, (n_multi, component)) AS donor FROM pool WHERE identified GROUP BY 1) USING (slice)) USING (slice, component) LEFT JOIN (SELECT slice, component, own_k AS k_cell FROM cellpool) USING (slice, component)""",
        "rungs": f"SELECT slice, person_id, component, level, n, mean FROM ({climb(P.CLASS_LADDER, 'slice, person_id', 'prof')}) JOIN cells USING (slice, level, cell)",
        "taken": "SELECT slice, person_id, component, min(level) AS level, arg_min(n, level) AS n, arg_min(mean, level) AS mean FROM rungs WHERE n >= 12 OR level = 8 GROUP BY 1, 2, 3",
        "means": """SELECT slice, person_id, component, coalesce(t.level, 8) AS class_level, coalesce(t.n, 0) AS n_cell, CASE WHEN coalesce(t.n, 0) > 0 THEN (t.n * t.mean + k_cell * coalesce(parent, grand_mean)) / (t.n + k_cell) ELSE coalesce(parent, grand_mean) END AS m, sigma2, k FROM ppl JOIN constants USING (slice) LEFT JOIN taken t USING (slice, person_id, component)
            LEFT JOIN (SELECT slice, person_id, component, arg_min(r.mean, r.level) AS parent FROM rungs r JOIN (SELECT slice, person_id, component, level AS at_level FROM taken) USING (slice, person_id, component) WHERE r.level > at_level GROUP BY 1, 2, 3) USING (slice, person_id, component)""",
        "gone": "SELECT slice, person_id, artifact_type, p, p >= 0.25 AS expected FROM mine JOIN rates USING (slice, level, cell) WHERE p >= 0.15 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.slice = mine.slice AND h.person_id = mine.person_id AND h.artifact_type = rates.artifact_type)",
        "eb": """SELECT *, round(max(point) OVER w - min(point) OVER w, 1) >= 12 AS diverges FROM (SELECT slice, person_id, component, n, round(least(greatest(100 * th, 0), 100), 1) AS point, round(least(greatest(100 * (th - h), 0), 100), 1) AS low, round(least(greatest(100 * (th + h), 0), 100), 1) AS high, round(k / (n + k), 3) AS prior_weight, round(100 * m, 1) AS class_mean, class_level, n_cell
            FROM (SELECT *, (n * coalesce(yb, 0) + k * m) / (n + k) AS th, 1.959964 * sqrt(sigma2 / (n + k)) * sqrt(1 + coalesce(mass, 0) / (n + k)) AS h FROM (SELECT means.*, coalesce(gn, 0) AS n, yb, mass FROM means LEFT JOIN (SELECT slice, person_id, component, n AS gn, mean AS yb FROM grp) USING (slice, person_id, component) LEFT JOIN (SELECT slice, person_id, sum(p) AS mass FROM gone WHERE expected GROUP BY 1, 2) USING (slice, person_id))))
            WINDOW w AS (PARTITION BY slice, person_id)""",
    }


def fitted(v, slices: list[int] | None) -> P.Population:
    """The population at the slices, or at the end alone without a slice column."""
    at = lambda df: T.visible_slices(df, END, slices or [0]).drop("known_at", *([] if slices else ["slice"]))
    day = lambda n, of: F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col(n) % of).cast("int"))
    people = v.person().withColumn("observed_at", day("person_id", 12))
    obs = v.observation().withColumn("base", (F.col("k") % 100) / 100.0).withColumn("milestone_type", F.when(F.col("is_milestone"), "launch"))
    resolved = scored(v).filter("state IN ('verified', 'contradicted')").select((F.col("person_id") % 400).alias("person_id"), "claim_id", "posterior").withColumn("observed_at", day("claim_id", 30))
    return P.fit_population(at(people), at(obs), at(resolved), reliability(v.spark), ["slice"] if slices else [])


FIT, NOW = fit(SLICES), fit([0])


@query("h7_refit_scores", "SELECT * FROM eb", FIT)
def refit_scores(v):
    """Classes, rates, constants and scores fitted anew at each of four instants."""
    return P.score_population(fitted(v, SLICES))


@query("h7_refit_trend", "SELECT person_id, component, n_points, slope, half_width, CASE WHEN slope IS NULL THEN 'insufficient_data' WHEN slope - half_width > 0 THEN 'improving' WHEN slope + half_width < 0 THEN 'declining' ELSE 'stable' END AS trend FROM (SELECT person_id, component, n_points, CASE WHEN n_points >= 3 THEN round(b, 6) END AS slope, CASE WHEN n_points >= 3 THEN round(CASE n_points - 2 WHEN 1 THEN 12.706 ELSE 4.303 END * sqrt(greatest(0, syy - sxy * sxy / sxx) / (n_points - 2) / sxx), 6) END AS half_width FROM (SELECT person_id, component, count(*) AS n_points, regr_slope(point, -slice) AS b, regr_sxx(point, -slice) AS sxx, regr_syy(point, -slice) AS syy, regr_sxy(point, -slice) AS sxy FROM eb WHERE n > 0 GROUP BY 1, 2))", FIT)
def refit_trend(v):
    return P.score_trend(P.score_population(fitted(v, SLICES)), "person_id", "slice").withColumns({c: F.round(c, 6) + 0.0 for c in ("slope", "half_width")})


@query("f6_eb_score", "SELECT * EXCLUDE (slice) FROM eb", NOW)
def eb(v):
    return P.score_population(fitted(v, None))


@query("f7_eb_leave_one_out", "SELECT person_id, component, stream, round(least(greatest(100 * (s - y + k * m) / (n - 1 + k), 0), 100), 6) AS point_without FROM (SELECT *, count(*) OVER w AS n, sum(y) OVER w AS s FROM streams WINDOW w AS (PARTITION BY person_id, component)) JOIN means USING (slice, person_id, component)", NOW)
def eb_loo(v):
    return P.leave_one_out(fitted(v, None))


SHOWN = "level, array_to_string(cell, '|') AS cell"


@query("e2_class_ladder", f"SELECT component, {SHOWN}, n, round(mean, 9) AS mean FROM cells", NOW)
def class_ladder(v):
    return fitted(v, None).class_cells.select("component", "level", F.array_join("cell", "|").alias("cell"), "n", F.round("mean", 9).alias("mean"))


@query("e3_rate_ladder", f"SELECT {SHOWN}, artifact_type, k, n, round(p, 9) AS p FROM rates", NOW)
def rate_ladder(v):
    return fitted(v, None).rates.withColumns({"cell": F.array_join("cell", "|"), "p": F.round("p", 9)})


@query("e5_population_constants", "SELECT slice, component, n_groups, n_multi, round(sigma2, 6) AS sigma2, round(k, 6) AS k, round(grand_mean, 6) AS grand_mean, identified, round(k_cell, 6) AS k_cell FROM constants", FIT)
def constants(v):
    return fitted(v, SLICES).constants.withColumns({c: F.round(c, 6) for c in ("sigma2", "k", "grand_mean", "k_cell")})
