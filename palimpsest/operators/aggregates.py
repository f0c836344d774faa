"""Profiles, priors, pooling constants, channel statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import days_between
from palimpsest.operators.ranking import nth_smallest, order_statistics, written


def entity_profile(obs: DataFrame, reliability: DataFrame, key: str = "person_id") -> DataFrame:
    """One row an entity: rows, first and last seen, rows by two kinds of source, sum of log-odds (3 decimals), channels and artifacts held."""
    rows = obs.filter(F.col(key).isNotNull()).join(F.broadcast(reliability), "source_class", "left")
    kind = lambda *xs: F.count_if(F.col("source_class").isin(*xs))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), kind("registry_filing", "third_party_observable").alias("n_outside"), kind("self_report").alias("n_self"),
        F.round(F.sum("weight"), 3).alias("log_odds"), F.array_sort(F.collect_set("channel_id")).alias("channels"), F.array_sort(F.collect_set("artifact_type")).alias("artifacts"),
    )


def rates_by_cell(members: DataFrame, held: DataFrame, ladder: list[list[str]], dims: list[str], key: str = "person_id", artifact: str = "artifact_type") -> DataFrame:
    """(level, cell, artifact, k, n, p) of every rung, cell and artifact type of the population, zero rates included. n counts all members, those without artifacts too."""
    from palimpsest.operators.joins import grouping_cells

    sizes = grouping_cells(members, ladder, dims, {"n": F.count(F.lit(1))})
    kinds = held.select(artifact).distinct()
    with_one = members.join(held.select(key, artifact).distinct(), key)
    counted = with_one.groupBy(*dims, artifact).agg(F.count(F.lit(1)).alias("_k"))
    parts = grouping_cells(counted, ladder, dims, {"k": F.sum("_k")}, [artifact])
    return sizes.crossJoin(kinds).join(parts, ["level", "cell", artifact], "left").select("level", "cell", artifact, F.coalesce("k", F.lit(0)).cast("long").alias("k"), "n", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("p"))


def mom_shrinkage(values: DataFrame, component: str, group: str, y: str, least_groups: int = 20, empty_k: float = 4.0) -> DataFrame:
    """(component, n_groups, n_multi, sigma2, tau2, k, identified): variance within and between groups by the method of moments.

    sigma2 is pooled within groups of two or more; tau2 = var(means) − sigma2 · mean(1/n), floored at the larger of
    sigma2/50 and 1e-9; k = sigma2/tau2 within [1, 50]. With fewer than least_groups such groups sigma2 is the variance of all
    values and k is that of the identified component with most of them, else sigma2 over the larger of var(means) and sigma2/50.
    """
    groups = values.filter(F.col(y).isNotNull()).groupBy(component, group).agg(F.count(F.lit(1)).alias("_n"), F.avg(y).alias("_mean"), (F.var_pop(y) * F.count(F.lit(1))).alias("_ss"))
    multi = F.col("_n") >= 2
    level = groups.groupBy(component).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(multi).alias("n_multi"), (F.sum(F.when(multi, F.col("_ss"))) / F.nullif(F.sum(F.when(multi, F.col("_n") - 1)), F.lit(0))).alias("_within"), F.var_pop("_mean").alias("_between"), F.avg(1 / F.col("_n")).alias("_inv"))
    spread = values.groupBy(component).agg(F.var_pop(y).alias("_all"))
    out = level.join(spread, component).withColumn("identified", F.col("n_multi") >= least_groups).withColumn("sigma2", F.when(F.col("identified"), F.col("_within")).otherwise(F.col("_all")))
    out = out.withColumn("tau2", F.when(F.col("identified"), F.greatest(F.col("_between") - F.col("sigma2") * F.col("_inv"), F.col("sigma2") / 50, F.lit(1e-9))))
    out = out.withColumn("_k", F.when(F.col("identified"), F.least(F.greatest(F.col("sigma2") / F.col("tau2"), F.lit(1.0)), F.lit(50.0))))
    donor = out.agg(F.max_by("_k", F.when(F.col("identified"), F.col("n_multi"))).alias("_donor"))
    own = F.least(F.greatest(F.try_divide(F.col("sigma2"), F.greatest("_between", F.col("sigma2") / 50)), F.lit(1.0)), F.lit(50.0))
    return out.crossJoin(F.broadcast(donor)).select(component, "n_groups", "n_multi", "sigma2", "tau2", F.coalesce("_k", "_donor", own, F.lit(empty_k)).alias("k"), "identified")


def momentum(obs: DataFrame, sector: str, at: str, days: int = 90, least: int = 8, up: float = 1.25) -> DataFrame:
    """(sector, n_now, n_before, label): rows of the last `days` against those before. Both windows hold their first instant."""
    now = F.lit(at).cast("timestamp_ntz")
    ago = lambda d: now - F.expr(f"INTERVAL {d} DAYS")
    t = F.col("observed_at")
    g = obs.groupBy(sector).agg(F.count_if((t >= ago(days)) & (t <= now)).alias("n_now"), F.count_if((t >= ago(2 * days)) & (t < ago(days))).alias("n_before"))
    label = F.when(F.col("n_now") + F.col("n_before") < least, "neutral").when(F.col("n_now") > up * F.col("n_before"), "bullish").when(F.col("n_now") * up < F.col("n_before"), "bear").otherwise("neutral")
    return g.withColumn("label", label)


def reference_class_means(profiles: DataFrame, cell: list[str], log_odds: str = "log_odds", strength: int = 20) -> DataFrame:
    """Per cell: mean of 100·σ(log_odds/6), and that mean shrunk to the population's by n/(n+strength)."""
    y = 100 / (1 + F.exp(-F.col(log_odds) / 6))
    cells = profiles.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"))
    total = profiles.agg(F.avg(y).alias("_all"))
    w = F.col("n") / (F.col("n") + strength)
    return cells.crossJoin(F.broadcast(total)).select(*cell, "n", "mean", (w * F.col("mean") + (1 - w) * F.col("_all")).alias("shrunk"), (F.col("n") < strength).alias("thin"))


def state_distribution(df: DataFrame, state: str, states: list[str], absent: str) -> DataFrame:
    """(state, n, extracted) for every state, those without rows too; extracted is all rows less the absent ones."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(state) == s).alias(s) for s in states])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("n"), (F.col("_n") - F.col(absent)).alias("extracted")) for s in states])).alias("r")).select("r.*")


def firsts(obs: DataFrame, consensus: Column, at: str, window_days: int = 30, key: str = "person_id", channel: str = "channel_id") -> DataFrame:
    """(channel, person, first_signal, first_here, n_rows, n_window) of the rows visible at an instant, in one pass: first_here is the first consensus row, n_window counts the rows of the last days (the first instant excluded). Versions of a channel (#v) are one; null channels and people stay."""
    now, t = F.lit(at).cast("timestamp_ntz"), F.col("observed_at")
    rows = obs.filter(t <= now).withColumn(channel, F.split_part(channel, F.lit("#v"), F.lit(1)))
    return rows.groupBy(channel, key).agg(F.min(t).alias("first_signal"), F.min(F.when(consensus, t)).alias("first_here"), F.count(F.lit(1)).alias("n_rows"), F.count_if(t > now - F.expr(f"INTERVAL {window_days} DAYS")).alias("n_window"))


def _with_lags(first: DataFrame, at: str, key: str) -> DataFrame:
    known = first.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("first_here").alias("first_consensus"))
    days = lambda to: F.round(days_between(to, "first_signal"), 1)
    return first.join(known, key, "left").withColumn("lag_days", days("first_consensus")).withColumn("followed_days", days(F.lit(at).cast("timestamp_ntz")))


def lags(obs: DataFrame, consensus: Column, at: str, key: str = "person_id", channel: str = "channel_id") -> DataFrame:
    """(channel, person, first_signal, first_consensus, lag_days, followed_days): days from a channel's first row of a person, consensus or not, to the person's first consensus row in any channel; null where there is none yet, with the days followed so far. Negative lags stay; rows without a channel make nobody a signal."""
    rows = _with_lags(firsts(obs, consensus, at, key=key, channel=channel), at, key).filter(F.col(channel).isNotNull() & F.col(key).isNotNull())
    return rows.select(channel, key, "first_signal", "first_consensus", "lag_days", "followed_days")


def days_of_edge(obs: DataFrame, consensus: Column, channels: DataFrame, at: str, by_construction: list[str], window_days: int = 30, thin: int = 12, key: str = "person_id", channel: str = "channel_id") -> DataFrame:
    """(channel, registered, kind, native, active, n_lags, n_censored, n_late, median_days_edge, censored_followed, volume, volume_denominator, n_rows, n_unkeyed, basis, thin).

    channels: channel, kind, native, active of the registered ones; others that have people, or rows in the window, are told as unregistered.
    basis: not_applicable for a confirmation channel, which has no edge; by_construction for those whose edge is 0 by definition; measured with
    any lag; fully_censored where nobody surfaced is visible to the market yet (censored_followed, the median of the days followed, is a
    floor); else insufficient. volume_denominator counts the window's rows of all channels.

    Lags have one decimal, so a channel has as many distinct ones as there are tenths of a day: these are counted first, and medians are read off
    the counts. One pass over the rows.
    """
    first = firsts(obs, consensus, at, window_days, key, channel)
    rows = _with_lags(first, at, key).filter(F.col(channel).isNotNull())
    which = F.when(F.col(key).isNull(), "nobody").when(F.col("lag_days").isNotNull(), "lag").otherwise("censored")
    x = F.when(which == "lag", F.col("lag_days")).when(which == "censored", F.col("followed_days"))
    counted = rows.groupBy(channel, which.alias("_which"), x.alias("_x")).agg(F.count(F.lit(1)).alias("_n"), F.sum("n_rows").alias("_rows"), F.sum("n_window").alias("_window"))
    own = Window.partitionBy(channel, "_which")
    placed = counted.withColumn("_upto", F.sum("_n").over(own.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_of", F.sum("_n").over(own))
    at_place = lambda name, i: F.max(F.when((F.col("_which") == name) & (F.col("_upto") - F.col("_n") < i) & (i <= F.col("_upto")), F.col("_x")))
    median = lambda name: (at_place(name, F.ceil(F.col("_of") / 2)) + at_place(name, F.floor(F.col("_of") / 2) + 1)) / 2
    total = lambda what, c: F.sum(F.when(c, F.col(what)).otherwise(0))
    lag = F.col("_which") == "lag"
    g = placed.groupBy(channel).agg(
        total("_n", lag).alias("n_lags"), total("_n", F.col("_which") == "censored").alias("n_censored"), total("_n", lag & (F.col("_x") < 0)).alias("n_late"), median("lag").alias("_median"), median("censored").alias("censored_followed"),
        F.sum("_window").alias("volume"), F.sum("_rows").alias("n_rows"), total("_rows", F.col("_which") == "nobody").alias("n_unkeyed"),
    )
    out = g.join(channels.select(channel, "kind", "native", "active", F.lit(True).alias("registered")), channel, "full_outer")
    counts = ["n_lags", "n_censored", "n_late", "volume", "n_rows", "n_unkeyed"]
    out = out.fillna(0, counts).fillna({"kind": "unregistered", "native": False, "active": True, "registered": False}).filter("registered OR n_lags + n_censored + volume > 0")
    out = out.withColumn("volume_denominator", F.sum("volume").over(Window.partitionBy(F.lit(0))))  # a row a channel
    built = F.col(channel).isin(by_construction)
    basis = F.when(F.col("kind") == "confirmation", "not_applicable").when(built, "by_construction").when(F.col("n_lags") > 0, "measured").when(F.col("n_censored") > 0, "fully_censored").otherwise("insufficient")
    edge = F.when(basis == "by_construction", 0.0).when(basis == "measured", F.col("_median"))
    return out.select(channel, "registered", "kind", "native", "active", *[F.col(c).cast("long").alias(c) for c in counts[:3]], edge.alias("median_days_edge"), "censored_followed", "volume", "volume_denominator", "n_rows", "n_unkeyed", basis.alias("basis"), ((basis == "measured") & (F.col("n_lags") < thin)).alias("thin"))


def order_index(n: int, tail: float = 0.025) -> int:
    """The largest l with P(Bin(n, ½) < l) at most tail. Starts from the normal approximation; terms are in logarithms, so that no n overflows, and some 10·√n of them tell."""

    def p(i: int) -> float:
        return math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2))

    l = max(0, int(n / 2 - math.sqrt(n)))
    total, term, i = 0.0, p(l - 1) if l else 0.0, l - 1
    while i >= 0 and term > total * 1e-18:
        total += term
        term *= i / (n - i + 1)
        i -= 1
    while l > 0 and total > tail:
        l -= 1
        total -= p(l)
    while l < n and total + p(l) <= tail:
        total += p(l)
        l += 1
    return l


def median_interval(df: DataFrame, key: str, x: str, least: int = 6) -> DataFrame:
    """(key, n, ci_low, ci_high, ci_kind): an interval for the median from order statistics, free of distribution.

    The index depends on n alone; its few distinct values are worked out by a small function over them. Rows are placed
    by ranges, so a channel with a large share of them is still many tasks.
    """
    lookup = F.pandas_udf(lambda n: pd.Series([order_index(int(i)) for i in n]), "long")
    placed = written(order_statistics(df.select(key, x), [key], x))
    index = placed.select("of").distinct().withColumn("_l", lookup("of"))
    ends = placed.join(index, "of").groupBy(key, "of", "_l").agg(F.min(x).alias("_least"), F.max(x).alias("_most"), nth_smallest(F.col("_l") + 1, x).alias("_lo"), nth_smallest(F.col("of") - F.col("_l"), x).alias("_hi"))
    pick = ends.withColumnRenamed("of", "n")
    kind = F.when(F.col("n") == 1, "single").when((F.col("_l") >= 1) & (F.col("n") >= least), "order_statistic_95").otherwise("observed_range")
    found = pick.withColumn("ci_kind", kind).select(key, "n", F.when(kind == "order_statistic_95", F.col("_lo")).otherwise(F.col("_least")).alias("ci_low"), F.when(kind == "order_statistic_95", F.col("_hi")).otherwise(F.col("_most")).alias("ci_high"), "ci_kind")
    return df.select(key).distinct().join(found, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "ci_low", "ci_high", F.coalesce("ci_kind", F.lit("insufficient")).alias("ci_kind"))


def coverage_gap(channels: DataFrame, edge: str = "median_days_edge", volume: str = "volume", edge_days: float = 14.0, few: int = 10) -> DataFrame:
    """channels with `coverage_gap`: with three measured channels of positive edge or more, an edge at or over their median at a volume at or under theirs; else an edge of edge_days at a volume under few. Only active, cold-start-native channels."""
    good = (F.col("basis") == "measured") & (F.col(edge) > 0)
    mid = channels.agg(F.count_if(good).alias("_m"), F.median(F.when(good, F.col(edge))).alias("_e"), F.median(F.when(good, F.col(volume))).alias("_v"))
    gap = F.when(F.col("_m") >= 3, (F.col(edge) >= F.col("_e")) & (F.col(volume) <= F.col("_v"))).otherwise((F.col(edge) >= edge_days) & (F.col(volume) < few))
    return channels.crossJoin(F.broadcast(mid)).withColumn("coverage_gap", F.coalesce(good & gap & F.col("active") & F.col("native"), F.lit(False))).drop("_m", "_e", "_v")


def revealing_rate(obs: DataFrame, classes: list[str], low: float = 0.02, high: float = 0.9) -> DataFrame:
    share = F.count_if(F.col("source_class").isin(classes)) / F.count(F.lit(1))
    return obs.agg(F.greatest(F.least(share, F.lit(high)), F.lit(low)).alias("rate"))


def prior_shift(shifts: DataFrame, at: str, own: DataFrame | None = None) -> DataFrame:
    """(sector, axis, shift, n) over rows visible at `at` that weren't written by an opportunity in `own`; 3 decimals."""
    seen = shifts.filter(F.col("observed_at") <= F.lit(at).cast("timestamp_ntz"))
    kept = seen if own is None else seen.join(own.select(F.col("opportunity_id").alias("written_by")), "written_by", "left_anti")
    return kept.groupBy("sector", "axis").agg(F.round(F.sum("shift"), 3).alias("shift"), F.count(F.lit(1)).alias("n"))


def narrowing(versions: DataFrame, key: str, order: str, width: str) -> DataFrame:
    """(key, first_width, last_width) where the interval is narrower now than at first."""
    g = versions.groupBy(key).agg(F.min_by(width, order).alias("first_width"), F.max_by(width, order).alias("last_width"))
    return g.filter(F.col("last_width") < F.col("first_width"))


def manifest_summary(rows: DataFrame, key: str) -> DataFrame:
    missing = ~F.col("found")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("found").alias("n_found"), F.count_if(missing & F.col("expected")).alias("n_missing"), F.count_if(missing & ~F.col("expected")).alias("n_harmless"), F.count_if("penalised").alias("n_penalised"), F.round(F.sum("widen"), 6).alias("widen"))


def claim_rollup(claims: DataFrame, key: str, state: str) -> DataFrame:
    return claims.groupBy(key).agg(F.count_if(F.col(state) == "verified").alias("n_verified"), F.count_if(F.col(state) == "contradicted").alias("n_contradicted"), F.count_if(~F.col(state).isin("verified", "contradicted")).alias("n_open"))
