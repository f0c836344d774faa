"""Versions, durations and trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import days_between, minutes_between
from palimpsest.operators.ranking import medians


def rank_shift(df: DataFrame, key: str, raw: str, adjusted: str) -> DataFrame:
    """(key, raw_rank, adjusted_rank, shift): places by two scores, falling, nulls last, ties by key."""
    from palimpsest.operators.ranking import global_rank

    one = global_rank(df.select(key, raw), [F.desc_nulls_last(raw), F.asc(key)], "raw_rank").select(key, "raw_rank")
    two = global_rank(df.select(key, adjusted), [F.desc_nulls_last(adjusted), F.asc(key)], "adjusted_rank").select(key, "adjusted_rank")
    return one.join(two, key).select(key, "raw_rank", "adjusted_rank", (F.col("raw_rank") - F.col("adjusted_rank")).alias("shift"))


def next_versions(new: DataFrame, held: DataFrame, key: list[str], order: list[str], version: str = "version_number") -> DataFrame:
    """new with version numbers that go on from the highest held one of each key."""
    most = held.groupBy(*key).agg(F.max(version).alias("_most"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return new.join(most, key, "left").withColumn(version, (F.coalesce("_most", F.lit(0)) + nth).cast("long")).drop("_most")


def step_function(versions: DataFrame, key: list[str], order: list[str], point: str, low: str) -> DataFrame:
    """Versions that have a point or a lower end, in order, with `changed`: the point differs from the one before (the first always does)."""
    kept = versions.filter(F.col(point).isNotNull() | F.col(low).isNotNull())
    before = F.lag(point).over(Window.partitionBy(*key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1
    return kept.withColumn("changed", first | ~F.col(point).eqNullSafe(before))


def stage_durations(stages: DataFrame, entity: str = "opportunity_id") -> DataFrame:
    """Each stage with its end (its own exit, else the next entry), minutes (one decimal) and whether it is open."""
    end = F.coalesce("exited_at", F.lead("entered_at").over(Window.partitionBy(entity).orderBy("entered_at", "stage")))
    return stages.withColumn("ended_at", end).withColumn("minutes", F.round(minutes_between("ended_at", "entered_at"), 1)).withColumn("is_open", F.col("ended_at").isNull())


def asof_slices(df: DataFrame, anchor: str, offsets: list[int], clock: str = "observed_at") -> DataFrame:
    """(days_before, n_visible, n_total) at the anchor less each offset, in one pass."""
    at = lambda d: F.lit(anchor).cast("timestamp_ntz") - F.expr(f"INTERVAL {d} DAYS")
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(clock) <= at(d)).alias(f"d{d}") for d in offsets])
    return wide.select("n", F.explode(F.array(*[F.struct(F.lit(d).cast("long").alias("days_before"), F.col(f"d{d}").alias("n_visible")) for d in offsets])).alias("s")).select("s.*", F.col("n").alias("n_total"))


def opportunity_timing(stages: DataFrame, opps: DataFrame, obs: DataFrame, at: str, decided: list[str]) -> DataFrame:
    """Per opportunity: first_signal_at (its own, else the person's earliest observation, else the first stage), decided_at, state, elapsed minutes, minutes of human wait, and discovery lag in days."""
    d = stage_durations(stages)
    last = F.max_by(F.struct("stage", "is_open", "exited_reason"), F.struct("entered_at", "stage"))
    own = d.groupBy("opportunity_id").agg(
        F.min("entered_at").alias("first_stage_at"), F.min(F.when(F.col("stage").isin(decided), F.col("entered_at"))).alias("decided_at"), last.alias("_last"),
        F.sum(F.when(F.col("wait_is_human"), F.col("minutes"))).alias("human_minutes"), F.max("ended_at").alias("_until"),
    )
    seen = obs.filter("person_id IS NOT NULL").groupBy("person_id").agg(F.min("observed_at").alias("_seen"))
    out = opps.select("opportunity_id", "person_id", "first_signal_at", "opened_at").join(own, "opportunity_id", "left").join(seen, "person_id", "left")
    signal = F.coalesce("first_signal_at", "_seen", "first_stage_at")
    state = F.when(F.col("first_stage_at").isNull(), "not_entered").when(F.col("decided_at").isNotNull(), "decided").when(F.col("_last.exited_reason") == "screened_out", "closed").otherwise("stalled")
    until = F.coalesce("decided_at", F.lit(at).cast("timestamp_ntz"))
    return out.select(
        "opportunity_id", signal.alias("first_signal_at"), "decided_at", state.alias("state"), F.when(state.isin("stalled", "closed"), F.col("_last.stage")).alias("stalled_in"),
        F.round(minutes_between(until, F.col("first_stage_at")), 1).alias("elapsed_minutes"), F.round(F.coalesce("human_minutes", F.lit(0.0)), 1).alias("human_minutes"), F.round(days_between(F.col("opened_at"), signal), 1).alias("discovery_lag_days"),
    )


def cohort_timing(timing: DataFrame) -> DataFrame:
    """One row over the opportunities that entered a stage: counts by state, shares in per cent, medians of the decided ones' elapsed time with and without human wait and of that wait, median discovery lag of all."""
    entered = timing.filter("state <> 'not_entered'")
    state = lambda *s: F.count_if(F.col("state").isin(*s))
    decided = lambda c: F.when(F.col("state") == "decided", c)
    elapsed, human = F.col("elapsed_minutes"), F.col("human_minutes")
    middle = medians(entered.withColumn("_all", F.lit(0)), ["_all"], {"median_minutes": decided(elapsed), "median_machine_minutes": decided(elapsed - human), "median_human_minutes": decided(human), "median_lag_days": F.col("discovery_lag_days")})
    share = lambda n: F.round(100 * n / F.nullif(F.count(F.lit(1)), F.lit(0)), 1)
    counts = entered.agg(
        F.lit(0).alias("_all"),
        F.count(F.lit(1)).alias("n"), state("decided").alias("n_decided"), state("stalled").alias("n_stalled"), state("closed").alias("n_closed"), share(state("decided")).alias("decided_pct"), share(state("stalled", "closed")).alias("stalled_pct"),
    )
    return counts.join(middle, "_all", "left").drop("_all")


def stall_breakdown(timing: DataFrame) -> DataFrame:
    """(stage, n_stalled, n_closed, n): where opportunities without a decision stand, or stood when they were closed."""
    count = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    return timing.filter("state IN ('stalled', 'closed')").groupBy(F.coalesce("stalled_in", F.lit("unknown")).alias("stage")).agg(count("stalled"), count("closed"), F.count(F.lit(1)).alias("n"))


#: 97.5 % points of Student's t by degrees of freedom, from 1.
T_POINTS = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447]


def ols_trend(points: DataFrame, key: list[str], x: str, y: str, per: float = 1.0, otherwise: float = 1.96, digits: int | None = None, t_known: int = len(T_POINTS)) -> DataFrame:
    """(key, n_points, slope, half_width, trend) of a straight line through each key's points.

    The slope is per `per` units of x, with a 95 % band; fewer than 3 points or no spread are
    insufficient_data; of Student's t the first `t_known` points are used, then `otherwise`; the trend is improving or declining only if the band, rounded to `digits` if given, leaves out 0.
    """
    g = points.filter(F.col(y).isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("n_points"), F.regr_slope(y, x).alias("_b"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"))
    enough = (F.col("n_points") >= 3) & (F.col("_sxx") > 0)
    t = reduce(lambda c, i: c.when(F.col("n_points") - 2 == i + 1, T_POINTS[i]), range(1, t_known), F.when(F.col("n_points") - 2 == 1, T_POINTS[0])).otherwise(otherwise)
    s2 = F.greatest(F.lit(0.0), F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx")) / (F.col("n_points") - 2)
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    slope, half = F.when(enough, cut(F.col("_b") * per)), F.when(enough, cut(t * F.sqrt(s2 / F.col("_sxx")) * per))
    out = g.select(*key, "n_points", slope.alias("slope"), half.alias("half_width"))
    trend = F.when(F.col("slope").isNull(), "insufficient_data").when(F.col("slope") - F.col("half_width") > 0, "improving").when(F.col("slope") + F.col("half_width") < 0, "declining").otherwise("stable")
    return out.withColumn("trend", trend)


def visible_slices(df: DataFrame, anchor: str, offsets: list[int], clock: str = "observed_at") -> DataFrame:
    """df with a row for each slice (days before the anchor) in which it is visible: later operators take `slice` into their keys and fit all instants in one job."""
    ends = F.array(*[F.struct(F.lit(d).cast("long").alias("days"), (F.lit(anchor).cast("timestamp_ntz") - F.expr(f"INTERVAL {d} DAYS")).alias("at")) for d in offsets])
    return df.withColumn("slice", F.explode(F.transform(F.filter(ends, lambda e: F.col(clock) <= e["at"]), lambda e: e["days"])))


def collapse_versions(df: DataFrame, name: str, order: list[str], at: str, clock: str) -> DataFrame:
    """The latest visible version of each base name (the part before #v)."""
    base = F.split_part(F.col(name), F.lit("#v"), F.lit(1))
    seen = df.filter(F.col(clock) <= F.lit(at).cast("timestamp_ntz")).withColumn("base", base)
    return seen.withColumn("_nth", F.row_number().over(Window.partitionBy("base").orderBy(*[F.desc(o) for o in order]))).filter("_nth = 1").drop("_nth")


def changed_versions(new: DataFrame, current: DataFrame, key: str, measures: list[str], tolerance: float = 1e-6) -> DataFrame:
    """New rows of which any measure differs from the current version beyond the tolerance, or is null on one side, or that have no version yet."""
    old = current.select(key, *[F.col(m).alias(f"_{m}") for m in measures], F.lit(True).alias("_held"))
    differ = [F.when(F.col(m).isNull() | F.col(f"_{m}").isNull(), ~F.col(m).eqNullSafe(F.col(f"_{m}"))).otherwise(F.abs(F.col(m).cast("double") - F.col(f"_{m}").cast("double")) > tolerance) for m in measures]
    changed: Column = reduce(lambda a, b: a | b, differ)
    return new.join(old, key, "left").filter(F.col("_held").isNull() | changed).select(*new.columns)


def account_footprint(df: DataFrame, key: str, clock: str, at: str, young_days: int = 90, few: int = 60) -> DataFrame:
    """Per account: first and last item, count, age in days, and whether it is young or has left little."""
    g = df.groupBy(key).agg(F.min(clock).alias("first_at"), F.max(clock).alias("last_at"), F.count(F.lit(1)).alias("n_items"))
    age = F.round(days_between(F.lit(at).cast("timestamp_ntz"), "first_at"), 1)
    return g.withColumn("age_days", age).withColumn("is_young", F.col("age_days") <= young_days).withColumn("low_footprint", F.col("n_items") <= few)


def sla_state(decided: Column, due: Column, at: str, margin_days: int) -> Column:
    now = F.lit(at).cast("timestamp_ntz")
    return F.when(decided, "closed").when(due < now, "breached").when(due < now + F.expr(f"INTERVAL {margin_days} DAYS"), "at_risk").otherwise("on_track")
