"""A population fitted as it stood at an instant, or at several in one job: reference classes, rates, pooling constants, scores.

Every frame may carry slice columns (`by`, see temporal.visible_slices); they are in each key, so a
slice comes out as if it were fitted alone. Cells are (level, array of the level's values); a null dimension reads as
unknown. All sums are algebraic: hot people, classes and slices are combined before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import clip, sigmoid
from palimpsest.operators.ranking import written

CREDIBILITY, BUILD = "credibility", "build"
#: The ladder of reference classes, most specific first, and that of the rates at which artifacts are held.
CLASS_LADDER = [
    ["primary_artifact", "sector", "solo_or_team", "resource_tier", "region"], ["primary_artifact", "sector", "solo_or_team", "resource_tier"], ["primary_artifact", "sector", "solo_or_team"], ["primary_artifact", "sector"],
    ["sector", "solo_or_team", "resource_tier"], ["sector", "solo_or_team"], ["primary_artifact"], ["sector"], [],
]
RATE_LADDER = [["sector", "solo_or_team", "resource_tier", "region"], ["sector", "solo_or_team", "resource_tier"], ["sector", "solo_or_team"], ["sector"], []]
#: Members of a cell that may speak, the 95 % point, what an absence must clear, groups that identify a variance, bounds of k, points by which the components diverge.
LEAST_CELL, Z, EXPECTED, PRICED, IDENTIFYING, K_LEAST, K_MOST, APART = 12, 1.959964, 0.25, 0.15, 20, 1.0, 50.0, 12


def rungs(ladder: list[list[str]]) -> Column:
    """A row's cells: an array of (level, cell), most specific first."""
    return F.array(*[F.struct(F.lit(i).alias("level"), F.array(*r).cast("array<string>").alias("cell")) for i, r in enumerate(ladder)])


def ladder_cells(df: DataFrame, ladder: list[list[str]], aggs: dict[str, Column], by: list[str]) -> DataFrame:
    """(by, level, cell, aggregates) of all rungs, from one GROUPING SETS pass; `by` is in every set."""
    dims = list(dict.fromkeys(d for r in ladder for d in r))
    out = df.groupingSets([[F.col(c) for c in [*by, *r]] for r in ladder], *[F.col(c) for c in [*by, *dims]]).agg(F.grouping_id().alias("_g"), *[c.alias(k) for k, c in aggs.items()])
    bits = [sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in r) for r in ladder]
    pick = lambda values: reduce(lambda a, x: a.when(F.col("_g") == x[0], x[1]), zip(bits[1:], values[1:]), F.when(F.col("_g") == bits[0], values[0]))
    return out.select(*by, pick([F.lit(i) for i in range(len(ladder))]).alias("level"), pick([F.array(*r).cast("array<string>") for r in ladder]).alias("cell"), *aggs)


def climbed(profiles: DataFrame, cells: DataFrame, ladder: list[list[str]], also: list[str], value: str, by: list[str], least: int = LEAST_CELL) -> DataFrame:
    """(by, the ladder's dimensions, also, taken, parent) for each distinct combination of dimensions.

    taken is the first cell of the ladder with `least` members, or that of the last rung, as (level, cell, n,
    value); parent the value of the next rung that exists. Both are null where there is none. The ladder is climbed
    by equality, once for each combination; at most a row a rung meets in a group.
    """
    dims = list(dict.fromkeys(d for r in ladder for d in r))
    combinations = profiles.select(*by, *dims).distinct().select(*by, *dims, F.explode(rungs(ladder)).alias("_r")).select(*by, *dims, "_r.*")
    found = combinations.join(cells, [*by, "level", "cell"]).groupBy(*by, *dims, *also).agg(F.array_sort(F.collect_list(F.struct("level", "cell", "n", F.col(value).alias("value")))).alias("_all"))
    taken = F.get(F.filter("_all", lambda e: (e["n"] >= least) | (e["level"] == len(ladder) - 1)), F.lit(0))
    parent = F.get(F.filter("_all", lambda e: e["level"] > F.col("taken.level")), F.lit(0))["value"]
    return found.withColumn("taken", taken).withColumn("parent", parent).drop("_all")


def pooling_constants(groups: DataFrame, component: str, by: list[str], least_groups: int = IDENTIFYING) -> DataFrame:
    """(by, component, n_groups, n_multi, sigma2, k, own_k, grand_mean, identified) by the method of moments.

    groups: a row for each group with its n, mean and ss, the sum of squares about the mean, of values of about
    the size of 1. sigma2 is pooled within groups of two or more, and k = sigma2 / tau2, where tau2 is the variance of the means less
    sigma2 · mean(1/n), sigma2/50 and 1e-9 at least. With fewer than least_groups such groups sigma2 is the variance
    of all values (0.04 for a single one), and k that of the slice's identified component with most of them; own_k is
    sigma2 over the larger of the means' variance and sigma2/50. All k are within [1, 50].
    """
    n, multi = F.col("n"), F.col("n") >= 2
    sums = {
        "n_groups": F.count(F.lit(1)), "n_multi": F.count_if(multi), "_n": F.sum(n), "_inner": F.sum("ss"), "_square": F.sum(n * F.col("mean") * F.col("mean")), "_sum": F.sum(n * F.col("mean")),
        "_ss": F.sum(F.when(multi, F.col("ss"))), "_df": F.sum(F.when(multi, n - 1)), "_between": F.var_pop("mean"), "_inverse": F.avg(1 / n),
    }
    g = groups.groupBy(*by, component).agg(*[c.alias(a) for a, c in sums.items()]).withColumn("grand_mean", F.col("_sum") / F.col("_n"))
    spread = F.when(F.col("_n") > 1, F.greatest(F.lit(0.0), (F.col("_inner") + F.col("_square")) / F.col("_n") - F.col("grand_mean") * F.col("grand_mean"))).otherwise(0.04)
    g = g.withColumn("identified", F.col("n_multi") >= least_groups).withColumn("sigma2", F.when(F.col("identified"), F.col("_ss") / F.col("_df")).otherwise(spread))
    tau2 = F.greatest(F.col("_between") - F.col("sigma2") * F.col("_inverse"), F.col("sigma2") / 50, F.lit(1e-9))
    bound = lambda k: clip(F.coalesce(k, F.lit(1.0)), K_LEAST, K_MOST)
    g = g.withColumn("own_k", bound(F.when(F.col("identified"), F.col("sigma2") / tau2).otherwise(F.try_divide(F.col("sigma2"), F.greatest("_between", F.col("sigma2") / 50)))))
    # a row for each slice and component: two or so to a slice
    donor = F.max_by(F.col("own_k"), F.when(F.col("identified"), F.struct("n_multi", component))).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    k = F.when(F.col("identified"), F.col("own_k")).otherwise(F.coalesce(donor, F.col("own_k")))
    return g.select(*by, component, "n_groups", "n_multi", "sigma2", k.alias("k"), "own_k", "grand_mean", "identified")


def row_kinds(obs: DataFrame, on: list[str]) -> DataFrame:
    """(on, artifact_type, milestone_type, source_class, n, first) of obs: the number of rows of a kind and its earliest row (observed_at, observation_id, base)."""
    first = F.min(F.struct("observed_at", "observation_id", "base"))
    return obs.filter(F.col(on[-1]).isNotNull()).groupBy(*on, "artifact_type", "milestone_type", "source_class").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))


def with_primary_artifact(people: DataFrame, kinds: DataFrame, by: list[str], key: str) -> DataFrame:
    """people, dimensions as text and null as unknown, with primary_artifact: the one with most rows, of equals the one seen first; none without any."""
    counted = kinds.filter(F.col("artifact_type").isNotNull()).groupBy(*by, key, "artifact_type").agg(F.sum("n").alias("_n"), F.min("first").alias("_first"))
    most = counted.groupBy(*by, key).agg(F.min_by("artifact_type", F.struct(-F.col("_n"), "_first")).alias("primary_artifact"))
    dims = [d for d in CLASS_LADDER[0] if d != "primary_artifact"]
    known = people.select(*by, key, *[F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(d) for d in dims])
    return known.join(most, [*by, key], "left").fillna("none", ["primary_artifact"])


@dataclass
class Population:
    """What was fitted: profiles (dimensions, the rate cell's level and cell), streams (component, stream, y), constants, the class mean `m` of each person and component, and absences."""

    by: list[str]
    key: str
    profiles: DataFrame
    rates: DataFrame
    streams: DataFrame
    constants: DataFrame
    class_cells: DataFrame
    means: DataFrame
    absences: DataFrame


def fit_population(people: DataFrame, obs: DataFrame, resolved: DataFrame, reliability: DataFrame, by: list[str] | None = None, key: str = "person_id", adjust: float = 0.5) -> Population:
    """Fits classes, rates, streams and constants to each slice.

    people: key, sector, solo_or_team, resource_tier, region; obs: key, artifact_type, milestone_type, source_class,
    base (what the row's artifact or milestone is worth), observed_at, observation_id; resolved: key, claim_id, posterior.

    Streams: a person's sources each count once, at the sigmoid of their reliability (unknown ones at 0), unless claims are resolved,
    which then stand alone; an artifact with a milestone counts once, at its first row's base plus `adjust` times what it is rarer in the
    person's class than in the population, within [0, 1]. A person of no rows has no stream and is scored by class alone; rows of nobody
    and of persons who aren't in people don't count. Rows by kind, resolved claims, profiles, rates and streams are written once to the shared folder, since all later steps read them.
    """
    by = by or []
    on = [*by, key]
    kinds, resolved = (written(df.join(people.select(*on), on, "left_semi")) for df in (row_kinds(obs, on), resolved.select(*on, "claim_id", "posterior")))
    profiles = written(with_primary_artifact(people, kinds, by, key))
    held = kinds.filter(F.col("artifact_type").isNotNull()).select(*on, "artifact_type").distinct()
    sizes = ladder_cells(profiles, RATE_LADDER, {"n": F.count(F.lit(1))}, by)
    rate_dims = RATE_LADDER[0]
    counted = held.join(profiles, on).groupBy(*by, *rate_dims, "artifact_type").agg(F.count(F.lit(1)).alias("_k"))
    parts = ladder_cells(counted, RATE_LADDER, {"k": F.sum("_k")}, [*by, "artifact_type"])
    rates = written(parts.join(sizes, [*by, "level", "cell"]).select(*by, "level", "cell", "artifact_type", "k", "n", (F.col("k") / F.col("n")).alias("p")))
    at = climbed(profiles, sizes.withColumn("_v", F.lit(0.0)), RATE_LADDER, [], "_v", by).select(*by, *rate_dims, "taken.level", "taken.cell")
    profiles = profiles.join(at, [*by, *rate_dims])

    unsettled = kinds.join(resolved.select(*on).distinct(), on, "left_anti")
    sources = unsettled.select(*on, F.coalesce("source_class", F.lit("unknown")).alias("source_class")).distinct().join(F.broadcast(reliability), "source_class", "left")
    cred = sources.select(*on, F.lit(CREDIBILITY).alias("component"), F.col("source_class").alias("stream"), sigmoid(F.coalesce("weight", F.lit(0.0))).alias("y"))
    settled = resolved.select(*on, F.lit(CREDIBILITY).alias("component"), F.concat(F.lit("claim "), F.col("claim_id").cast("string")).alias("stream"), F.col("posterior").alias("y"))
    artifact, milestone = F.coalesce("artifact_type", F.lit("none")).alias("artifact_type"), F.coalesce("milestone_type", F.lit("")).alias("milestone_type")
    made = kinds.select(*on, artifact, milestone, "first").groupBy(*on, "artifact_type", "milestone_type").agg(F.min("first")["base"].alias("base"))
    own = rates.select(*by, "level", "cell", "artifact_type", F.col("p").alias("_class"))
    whole = rates.filter(F.col("level") == len(RATE_LADDER) - 1).select(*by, "artifact_type", F.col("p").alias("_all"))
    priced = made.join(profiles.select(*on, "level", "cell"), on).join(own, [*by, "level", "cell", "artifact_type"], "left").join(whole, [*by, "artifact_type"], "left")
    y = clip(F.col("base") + adjust * (F.coalesce("_all", F.lit(0.0)) - F.coalesce("_class", F.lit(0.0))), 0.0, 1.0)
    build = priced.select(*on, F.lit(BUILD).alias("component"), F.concat_ws("/", "artifact_type", F.nullif("milestone_type", F.lit(""))).alias("stream"), y.alias("y"))
    streams = written(cred.unionByName(settled).unionByName(build))

    groups = streams.groupBy(*on, "component").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count(F.lit(1))).alias("ss"))
    fitted = pooling_constants(groups, "component", by)
    named = people.sparkSession.createDataFrame([(CREDIBILITY,), (BUILD,)], "component string")
    grid = (people.select(*by).distinct() if by else people.sparkSession.range(1).select()).crossJoin(named)  # a few slices and components
    placed = groups.select(*on, "component", F.col("mean").alias("m")).join(profiles, on)
    cells = ladder_cells(placed, CLASS_LADDER, {"n": F.count(F.lit(1)), "mean": F.avg("m"), "ss": F.var_pop("m") * F.count(F.lit(1))}, [*by, "component"])
    full = pooling_constants(cells.filter("level = 0 AND n > 1"), "component", by).select(*by, "component", F.col("own_k").alias("k_cell"))
    constants = grid.join(fitted, [*by, "component"], "left").fillna({"sigma2": 0.04, "k": 4.0, "grand_mean": 0.5, "n_groups": 0, "n_multi": 0, "identified": False}).join(full, [*by, "component"], "left")
    constants = constants.select(*by, "component", "n_groups", "n_multi", "sigma2", "k", "grand_mean", "identified", F.coalesce("k_cell", "k").alias("k_cell"))

    # the class mean, shrunk to the next rung that exists; the grand mean stands above the ladder
    rung = climbed(profiles, cells, CLASS_LADDER, ["component"], "mean", by)
    asked = profiles.select(*on, *CLASS_LADDER[0]).crossJoin(F.broadcast(named)).join(rung, [*by, *CLASS_LADDER[0], "component"], "left").join(F.broadcast(constants), [*by, "component"])
    n_cell, parent = F.coalesce("taken.n", F.lit(0)), F.coalesce("parent", "grand_mean")
    m = F.when(n_cell > 0, (n_cell * F.col("taken.value") + F.col("k_cell") * parent) / (n_cell + F.col("k_cell"))).otherwise(parent)
    means = asked.select(*on, "component", F.coalesce("taken.level", F.lit(len(CLASS_LADDER) - 1)).alias("class_level"), n_cell.alias("n_cell"), m.alias("m"))
    often = rates.filter(F.col("p") >= PRICED).select(*by, "level", "cell", "artifact_type", "p")
    absences = profiles.select(*on, "level", "cell").join(often, [*by, "level", "cell"]).join(held, [*on, "artifact_type"], "left_anti").select(*on, "artifact_type", "p", (F.col("p") >= EXPECTED).alias("expected"))
    return Population(by, key, profiles, rates, streams, constants, cells, means, absences)


def score_population(pop: Population) -> DataFrame:
    """(by, key, component, n, point, low, high, prior_weight, class_mean, class_level, n_cell, diverges), 0 to 100, for every person and component.

    θ = (n·ȳ + k·m)/(n + k), its half width Z·√(σ²/(n+k))·√(1 + mass/(n+k)), mass the rates of expected artifacts that are absent. Points
    and bounds have one decimal; diverges tells that the two components' points are 12 apart or more.
    """
    on = [*pop.by, pop.key]
    own = pop.streams.groupBy(*on, "component").agg(F.count(F.lit(1)).alias("_n"), F.avg("y").alias("_y"))
    mass = pop.absences.filter("expected").groupBy(*on).agg(F.sum("p").alias("_mass"))
    out = pop.means.join(F.broadcast(pop.constants.select(*pop.by, "component", "sigma2", "k")), [*pop.by, "component"]).join(own, [*on, "component"], "left").join(mass, on, "left")
    n = F.coalesce("_n", F.lit(0)).cast("long")
    weight = n + F.col("k")
    theta = (n * F.coalesce("_y", F.lit(0.0)) + F.col("k") * F.col("m")) / weight
    half = Z * F.sqrt(F.col("sigma2") / weight) * F.sqrt(1 + F.coalesce("_mass", F.lit(0.0)) / weight)
    points = lambda x: F.round(clip(100 * x, 0.0, 100.0), 1)
    scored = out.select(*on, "component", n.alias("n"), points(theta).alias("point"), points(theta - half).alias("low"), points(theta + half).alias("high"), F.round(F.col("k") / weight, 3).alias("prior_weight"), F.round(100 * F.col("m"), 1).alias("class_mean"), "class_level", "n_cell")
    both = Window.partitionBy(*on)
    return scored.withColumn("diverges", F.round(F.max("point").over(both) - F.min("point").over(both), 1) >= APART)


def leave_one_out(pop: Population) -> DataFrame:
    """(by, key, component, stream, point_without): the point without each stream, from the sums alone; a single stream leaves the class mean."""
    on = [*pop.by, pop.key, "component"]
    own = Window.partitionBy(*on)
    rows = pop.streams.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_s", F.sum("y").over(own)).join(pop.means.select(*on, "m"), on).join(F.broadcast(pop.constants.select(*pop.by, "component", "k")), [*pop.by, "component"])
    without = (F.col("_s") - F.col("y") + F.col("k") * F.col("m")) / (F.col("_n") - 1 + F.col("k"))
    return rows.select(*on, "stream", F.round(clip(100 * without, 0.0, 100.0), 6).alias("point_without"))


def score_trend(scores: DataFrame, key: str, days: str, otherwise: float = 2.0) -> DataFrame:
    """(key, component, n_points, slope, half_width, trend) of each person's points over the slices in which there was evidence; x is minus the slice's days."""
    from palimpsest.operators.temporal import ols_trend

    points = scores.filter("n > 0").select(key, "component", (-F.col(days)).cast("double").alias("x"), F.col("point").alias("y"))
    return ols_trend(points, [key, "component"], "x", "y", otherwise=otherwise, t_known=4)
