"""Scores: log-odds of claims, pooled entity scores, absences, axes, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import clip, log_ratio_absent, log_ratio_found, sigmoid
from palimpsest.operators.ranking import sums_before

VERIFIED, CONTRADICTED, UNVERIFIED, ABSENT = "verified", "contradicted", "unverified", "absent_but_expected"


def evidence_delta(weight: str = "weight") -> Column:
    """What an evidence row adds: its stored delta, unless null or 0; for an absence the log likelihood ratio where it was expected and is penalised; else the source's weight, signed by the kind (a self report keeps its own sign)."""
    absent = F.when(~F.col("found") & F.col("expected") & F.col("penalised") & F.col("findability_prior").isNotNull(), log_ratio_absent("findability_prior", 0.1)).otherwise(0.0)
    signed = F.when(F.col("source_class") == "self_report", F.col(weight)).when(F.col("kind") == "contradicting", -F.abs(weight)).otherwise(F.abs(weight))
    return F.when(F.coalesce("log_odds_delta", F.lit(0.0)) != 0, F.col("log_odds_delta")).when(F.col("kind") == "expected_absent", absent).otherwise(F.coalesce(signed, F.lit(0.0)))


def with_delta(evidence: DataFrame, reliability: DataFrame) -> DataFrame:
    return evidence.join(F.broadcast(reliability), "source_class", "left").withColumn("delta", evidence_delta())


def claim_state(total: Column, absent: Column) -> Column:
    return F.when(absent, ABSENT).when(total >= 2, VERIFIED).when(total <= -2, CONTRADICTED).otherwise(UNVERIFIED)


def claim_log_odds(claims: DataFrame, evidence: DataFrame, reliability: DataFrame) -> DataFrame:
    """(claim_id, n_evidence, log_odds, widen, state, posterior). A claim predicted by the manifest, or with absences alone, is absent_but_expected whatever its sum; a claim without rows is unverified at 0."""
    g = with_delta(evidence, reliability).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.round(F.sum("delta"), 2).alias("log_odds"), F.bool_and(F.col("kind") == "expected_absent").alias("_all_absent"), F.round(F.sum("interval_widen"), 6).alias("widen"))
    out = claims.join(g, "claim_id", "left")
    total = F.coalesce("log_odds", F.lit(0.0))
    state = claim_state(total, F.col("is_manifest_predicted") | F.coalesce("_all_absent", F.lit(False)))
    return out.select("claim_id", "person_id", F.coalesce("n_evidence", F.lit(0)).cast("long").alias("n_evidence"), total.alias("log_odds"), F.coalesce("widen", F.lit(0.0)).alias("widen"), state.alias("state"), F.when(state != ABSENT, F.round(sigmoid(total), 6)).alias("posterior"))


def claim_waterfall(deltas: DataFrame) -> DataFrame:
    """Each term with the running total of its claim, by ordinal (null: 99) and id."""
    order = Window.partitionBy("claim_id").orderBy(F.coalesce("ordinal", F.lit(99)), "evidence_id").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("claim_id", "evidence_id", "ordinal", (F.round("delta", 6) + 0.0).alias("delta"), (F.round(F.sum("delta").over(order), 6) + 0.0).alias("running"))


def claim_leave_one_out(deltas: DataFrame, states: DataFrame) -> DataFrame:
    """For claims of two terms or more: log-odds and state without each term, and whether the state flips. The total less the term, no new score."""
    own = Window.partitionBy("claim_id")
    rows = deltas.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_s", F.sum("delta").over(own)).filter("_n >= 2")
    without = F.round(F.col("_s") - F.col("delta"), 2)
    out = rows.join(states.select("claim_id", "state"), "claim_id").withColumn("log_odds_without", without).withColumn("state_without", claim_state(without, F.lit(False)))
    return out.select("claim_id", "evidence_id", "log_odds_without", F.round(sigmoid("log_odds_without"), 6).alias("posterior_without"), "state_without", (F.col("state_without") != F.col("state")).alias("flips_state"))


def evidence_streams(obs: DataFrame, reliability: DataFrame, rates: DataFrame, resolved: DataFrame) -> DataFrame:
    """(person_id, component, stream, y): one value for each independent stream.

    credibility: a stream for each class of source, its sigmoid; resolved claims, where a person has any, stand in their place.
    build: a stream for each artifact and milestone flag, its first row's confidence plus half of what the artifact is rarer in the population, within [0, 1].
    rates: artifact_type, p_pop, p_class.
    """
    rows = obs.filter("person_id IS NOT NULL")
    proxy = rows.join(resolved.select("person_id").distinct(), "person_id", "left_anti").select("person_id", "source_class").distinct().join(F.broadcast(reliability), "source_class")
    cred = proxy.select("person_id", F.lit("credibility").alias("component"), F.col("source_class").alias("stream"), sigmoid("weight").alias("y"))
    settled = resolved.select("person_id", F.lit("credibility").alias("component"), F.concat(F.lit("claim "), F.col("claim_id").cast("string")).alias("stream"), F.col("posterior").alias("y"))
    base = rows.groupBy("person_id", "artifact_type", "is_milestone").agg(F.min_by("confidence", F.struct("observed_at", "observation_id")).alias("base"))
    build = base.join(rates, "artifact_type", "left").select("person_id", F.lit("build").alias("component"), F.concat_ws("/", "artifact_type", F.col("is_milestone").cast("string")).alias("stream"), clip(F.col("base") + 0.5 * (F.coalesce("p_pop", F.lit(0.0)) - F.coalesce("p_class", F.lit(0.0))), 0.0, 1.0).alias("y"))
    return cred.unionByName(settled).unionByName(build)


def absences(people: DataFrame, cells: DataFrame, held: DataFrame, cell: str, least: float = 0.15, expected: float = 0.25) -> DataFrame:
    """(person_id, artifact_type, p, expected): artifacts that the person's cell has at a rate of `least` or more and the person lacks."""
    return people.join(cells.filter(F.col("p") >= least), cell).join(held, ["person_id", "artifact_type"], "left_anti").select("person_id", "artifact_type", "p", (F.col("p") >= expected).alias("expected"))


def ranking_estimate(profiles: DataFrame, missing: DataFrame, class_means: DataFrame, cell: list[str]) -> DataFrame:
    """(person_id, n, point, low, high): 100·σ(log_odds/6) shrunk to the class mean by n/(n+5); half width 24·√(5/(n+5)) plus 6 for each missing prior of 0.4 or more, times it, at most 45."""
    widen = missing.filter("p >= 0.4").groupBy("person_id").agg(F.sum(6 * F.col("p")).alias("_more"))
    same = [profiles[c].eqNullSafe(class_means[c]) for c in cell]
    out = profiles.join(class_means, same, "left").select(profiles["*"], F.col("shrunk")).join(widen, "person_id", "left")
    w = F.col("n") / (F.col("n") + 5)
    point = w * 100 * sigmoid(F.col("log_odds") / 6) + (1 - w) * F.col("shrunk")
    half = F.least(24 * F.sqrt(5 / (F.col("n") + 5)) + F.coalesce("_more", F.lit(0.0)), F.lit(45.0))
    r = lambda c: F.round(c, 6)
    return out.select("person_id", "n", r(point).alias("point"), r(clip(point - half, 0.0, 100.0)).alias("low"), r(clip(point + half, 0.0, 100.0)).alias("high"))


def axis_founder(claims: DataFrame, observations: DataFrame, context: DataFrame, key: str, findability: str) -> DataFrame:
    """(key, n, point, low, high): n and the mean reliability are those of the observations; verified and contradicted claims and findable absences move the point, other absences only widen.

    direct = clip(50 + 9·mean reliability) + 4·verified − 9·contradicted − 6·penalised; with a memory (context) it is 0.55 of that and 0.45 of
    the memory; clipped, it is mixed with the prior clip(50 + 8·shift) (context) by n/(n+6). half = min(45, 8 + 22·(1−w) + 2.5·widening absences).
    A source without a reliability counts as 0.
    """
    absent = F.col("state") == ABSENT
    heavy = absent & (F.coalesce(findability, F.lit(0.0)) >= 0.5)
    told = claims.groupBy(key).agg(F.count_if(F.col("state") == VERIFIED).alias("_v"), F.count_if(F.col("state") == CONTRADICTED).alias("_c"), F.count_if(heavy).alias("_p"), F.count_if(absent).alias("_a"))
    seen = observations.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("reliability", F.lit(0.0))).alias("_rel"))
    g = seen.join(told, key, "full").fillna(0, ["n", "_v", "_c", "_p", "_a"]).join(context.select(key, F.col("memory").alias("_memory"), F.col("shift").alias("_shift")), key, "left")
    w = F.col("n") / (F.col("n") + 6)
    direct = clip(50 + 9 * F.coalesce("_rel", F.lit(0.0)), 0.0, 100.0) + 4 * F.col("_v") - 9 * F.col("_c") - 6 * F.col("_p")
    direct = clip(F.when(F.col("_memory").isNotNull(), 0.55 * direct + 0.45 * F.col("_memory")).otherwise(direct), 0.0, 100.0)
    point = w * direct + (1 - w) * clip(50 + 8 * F.coalesce("_shift", F.lit(0.0)), 0.0, 100.0)
    half = F.least(F.lit(45.0), 8 + 22 * (1 - w) + 2.5 * (F.col("_a") - F.col("_p")))
    r = lambda c: F.round(c, 6)
    return g.select(key, "n", r(point).alias("point"), r(clip(point - half, 0.0, 100.0)).alias("low"), r(clip(point + half, 0.0, 100.0)).alias("high"))


def axis_market(terms: DataFrame, key: str, shift: DataFrame) -> DataFrame:
    """(key, n, index, label) from itemised terms (kind, value, at) and a prior shift.

    A claim adds 0.3 if verified (value over 0), −0.8 if contradicted (under 0); comparables −0.4 each, two at most; two reviews or more,
    the first over 0, their change of direction times min(1, last/50)·0.6; wind-downs −0.6, press +0.2. n counts the rows that made a term.
    The index has three decimals, on which the label is decided: bear at −0.35 or less, bullish at 0.35 or more. A key with a shift and
    no term of its own stays: its index is the shift, its n 0.
    """
    is_ = lambda k: F.col("kind") == k
    reviews = lambda f: f(F.when(is_("review"), F.col("value")), F.when(is_("review"), F.col("at")))
    g = terms.groupBy(key).agg(
        F.count_if(~is_("review")).alias("_n"), F.count_if(is_("claim") & (F.col("value") > 0)).alias("_good"), F.count_if(is_("claim") & (F.col("value") < 0)).alias("_bad"), F.count_if(is_("comparable")).alias("_comp"),
        F.count_if(is_("review")).alias("_reviews"), reviews(F.min_by).alias("_first"), reviews(F.max_by).alias("_last"), F.count_if(is_("wind_down")).alias("_wind"), F.count_if(is_("press")).alias("_press"),
    )
    counted = F.coalesce((F.col("_reviews") >= 2) & (F.col("_first") > 0), F.lit(False))
    review = F.when(counted, F.signum(F.col("_last") - F.col("_first")) * F.least(F.lit(1.0), F.col("_last") / 50) * 0.6).otherwise(0.0)
    index = 0.3 * F.col("_good") - 0.8 * F.col("_bad") - 0.4 * F.least("_comp", F.lit(2)) + review - F.when(F.col("_wind") > 0, 0.6).otherwise(0.0) + F.when(F.col("_press") > 0, 0.2).otherwise(0.0)
    g = g.join(shift, key, "full_outer").fillna(0, ["_n", "_good", "_bad", "_comp", "_reviews", "_wind", "_press"])
    out = g.withColumn("index", F.round(index + F.coalesce("shift", F.lit(0.0)), 3) + 0.0).withColumn("n", F.col("_n") + F.when(counted, F.col("_reviews")).otherwise(0))
    return out.select(key, "n", "index", F.when(F.col("index") <= -0.35, "bear").when(F.col("index") >= 0.35, "bullish").otherwise("neutral").alias("label"))


#: Points of the latest domain state; any other state has none.
STATE_POINTS = {"transacting": 12.0, "pricing_page": 6.0, "changelog": 4.0, "calendly": 0.0, "waitlist": -4.0, "parked": -10.0, "unreachable": -10.0}


def axis_fit(terms: DataFrame, context: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, n, point, low, high, survives, carries) from itemised terms (kind, state, value, at) and a context (label, market_n, shift, widening, build_low).

    direct = clip(50 + points of the latest domain state + 8·clip((last − first)/first, ±1) of two cadences or more, the first over 0,
    + 5·verified − 8·contradicted − 6·comparables, two at most, ± 6 for a bullish or bear market), mixed with clip(50 + 8·shift) by n/(n+5);
    n counts all rows that made a term, the market's too. half = min(45, 7 + 20·(1−w) + 2.5·widening). It survives at 50 or more; if not,
    carries tells whether the lower bound of the capacity to build reaches the threshold (null without one). Point and bounds have one decimal, on
    which both are decided. A key with a context and no term of its own stays, at n of the market alone.
    """
    is_ = lambda k: F.col("kind") == k
    points = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATE_POINTS.items() for x in kv]), F.col("state")), F.lit(0.0))
    cadence = lambda f: f(F.when(is_("cadence"), F.col("value")), F.when(is_("cadence"), F.col("at")))
    g = terms.groupBy(key).agg(
        F.count_if(~is_("cadence")).alias("_n"), F.max_by(F.when(is_("domain"), points), F.when(is_("domain"), F.col("at"))).alias("_state"), F.count_if(is_("cadence")).alias("_cadences"), cadence(F.min_by).alias("_first"), cadence(F.max_by).alias("_last"),
        F.count_if(is_("verified")).alias("_good"), F.count_if(is_("contradicted")).alias("_bad"), F.count_if(is_("comparable")).alias("_comp"),
    ).join(context, key, "full_outer").fillna(0, ["_n", "_cadences", "_good", "_bad", "_comp"])
    counted = F.coalesce((F.col("_cadences") >= 2) & (F.col("_first") > 0), F.lit(False))
    ratio = F.when(counted, clip((F.col("_last") - F.col("_first")) / F.col("_first"), -1.0, 1.0)).otherwise(0.0)
    market = F.when(F.col("label") == "bullish", 6.0).when(F.col("label") == "bear", -6.0).otherwise(0.0)
    direct = clip(50 + F.coalesce("_state", F.lit(0.0)) + 8 * ratio + 5 * F.col("_good") - 8 * F.col("_bad") - 6 * F.least("_comp", F.lit(2)) + market, 0.0, 100.0)
    n = F.col("_n") + F.when(counted, F.col("_cadences")).otherwise(0) + F.coalesce("market_n", F.lit(0))
    w = F.col("n") / (F.col("n") + 5)
    r = lambda c: F.round(c, 1)
    out = g.withColumn("n", n).withColumn("point", r(w * direct + (1 - w) * clip(50 + 8 * F.coalesce("shift", F.lit(0.0)), 0.0, 100.0)))
    half = F.least(F.lit(45.0), 7 + 20 * (1 - w) + 2.5 * F.coalesce("widening", F.lit(0)))
    survives = F.col("point") >= 50
    carries = F.when(~survives, r(F.col("build_low")) >= threshold)
    return out.select(key, "n", "point", r(clip(F.col("point") - half, 0.0, 100.0)).alias("low"), r(clip(F.col("point") + half, 0.0, 100.0)).alias("high"), survives.alias("survives"), carries.alias("carries"))


def stance(score: Column, label: Column, threshold: float) -> Column:
    """The label of a categorical axis; a number is bear under threshold − 10, bullish over threshold + 10, else neutral; unknown without either."""
    return F.coalesce(label, F.when(score < threshold - 10, "bear").when(score > threshold + 10, "bullish").when(score.isNotNull(), "neutral"), F.lit("unknown"))


def axis_disagreement(axes: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, disagree, binding, dissent) over rows of (axis, score, label): the binding axis has the least (rank of the stance, name), the dissent the greatest of those with another stance. Bear ranks 0, neutral and unknown 1, bullish 2."""
    said = stance(F.col("score"), F.col("label"), threshold)
    rank = F.when(F.col("_said") == "bear", 0).when(F.col("_said") == "bullish", 2).otherwise(1)
    g = axes.withColumn("_said", said).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "axis", F.col("_said").alias("stance")))).alias("_s"))
    bind = F.array_min("_s")
    others = F.filter("_s", lambda x: x["stance"] != bind["stance"])
    return g.select(key, (F.size(others) > 0).alias("disagree"), bind["axis"].alias("binding"), F.array_max(others)["axis"].alias("dissent"))


def sector_writeback(own: DataFrame, sector: str, order: list[str], index: str, n: str) -> DataFrame:
    """own with `prior`: the sum of 0.5·index (3 decimals each) of the earlier opportunities of the sector that had terms. The recurrence has a closed form, so no loop is needed; it is summed over ranges, so a sector is not one task."""
    shifted = own.withColumn("written", F.when(F.col(n) > 0, F.round(0.5 * F.col(index), 3)))
    return sums_before(shifted, [sector], order, "written", "prior").drop("prior_all").withColumn("prior", F.round("prior", 3))


#: The widest interval to decide on, by appetite.
WIDTHS = {"low": 20.0, "medium": 30.0, "high": 42.0}


def gate(low: Column, point: Column, width: Column, threshold: Column, widest: Column) -> Column:
    return F.when((low >= threshold) & (width <= widest), "decide_now").when((low >= threshold) | (point >= threshold), "probe_further").otherwise("pass")


def appetite_sweep(board: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, low, medium, high, differs): the verdict at each appetite; three columns, one pass."""
    verdicts = {a: gate(F.col("low"), F.col("point"), F.col("high") - F.col("low"), F.lit(threshold), F.lit(w)) for a, w in WIDTHS.items()}
    out = board.select(key, *[v.alias(f"verdict_{a}") for a, v in verdicts.items()])
    return out.withColumn("differs", ~((F.col("verdict_low") == F.col("verdict_medium")) & (F.col("verdict_medium") == F.col("verdict_high"))))


def p_absent(prior: Column, rate: Column, m: Column, hits: Column) -> Column:
    """Probability that a thing isn't there after m rows that would have shown it at the rate; 0 with a hit."""
    unseen = prior * F.pow(1 - rate, m)
    return F.when(hits > 0, 0.0).otherwise((1 - prior) / ((1 - prior) + unseen))


def p_present(prior: Column, rate: Column, m: Column, hits: Column) -> Column:
    unseen = prior * F.pow(1 - rate, m)
    return F.when(hits > 0, 1 - F.pow(F.lit(0.5), hits)).otherwise(unseen / (unseen + (1 - prior)))


def idea_fit(in_sector: Column, words: Column, outside: Column, has_text: Column) -> Column:
    return F.when(has_text, F.when(in_sector, 70.0).otherwise(40.0) + F.least(F.lit(15.0), 3.0 * words) + F.least(F.lit(10.0), 2.0 * outside))


def claim_routing(state: Column, n_evidence: Column) -> Column:
    return F.when(state == ABSENT, "gap_row").when(state == CONTRADICTED, "bear_case").when(n_evidence == 0, "blocked_gap").otherwise("body")


def receipt_pairs(evidence: DataFrame) -> DataFrame:
    """(claim_id, said, checked): a claim's first self report beside each of its other rows that has an address or a status."""
    first = evidence.filter("source_class = 'self_report'").groupBy("claim_id").agg(F.min_by("evidence_id", F.struct("ordinal", "evidence_id")).alias("said"))
    checked = evidence.filter("source_class <> 'self_report' AND (source_url IS NOT NULL OR http_status IS NOT NULL)").select("claim_id", F.col("evidence_id").alias("checked"))
    return first.join(checked, "claim_id")


def portfolio_conflict(opps: DataFrame, positions: DataFrame, sector: str) -> DataFrame:
    """opps with conflict and the number of positions checked."""
    held = positions.select(sector).dropna().distinct().withColumn("_held", F.lit(True))
    return opps.join(F.broadcast(held), sector, "left").crossJoin(F.broadcast(positions.agg(F.count(F.lit(1)).alias("n_checked")))).withColumn("conflict", F.coalesce("_held", F.lit(False))).drop("_held")
