"""The population fit: slices against separate runs, the ladder by hand, refusals of priors, recomputed leave-one-out."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import population as P
from palimpsest.operators import priors as R
from palimpsest.plans import population as plans
from palimpsest.sources.views import Views

PEOPLE = "person_id long, sector string, solo_or_team string, resource_tier string, region string"
OBS = "person_id long, artifact_type string, milestone_type string, source_class string, base double, observed_at timestamp_ntz, observation_id long"


def test_slices_are_separate_runs(spark, sf):
    v = Views(spark, sf)
    together = P.score_population(plans.fitted(v, plans.SLICES))
    want = defaultdict(set)
    for r in together.collect():
        d = r.asDict()
        want[d.pop("slice")].add(tuple(sorted(d.items())))
    for days in plans.SLICES:
        alone = {tuple(sorted(x for x in r.asDict().items() if x[0] != "slice")) for r in P.score_population(plans.fitted(v, [days])).collect()}
        assert alone == want[days] and alone
        assert all(x is not None for row in alone for _, x in row), "no point is null"


def slow_fit(people, obs, resolved, weight, ladder, rate_ladder):
    """The scores in plain loops over dictionaries."""
    known = {p[0]: dict(zip(("sector", "solo_or_team", "resource_tier", "region"), (x or "unknown" for x in p[1:]))) for p in people}
    rows = [o for o in sorted(obs, key=lambda o: (o[5], o[6])) if o[0] in known]
    held = {p: [o[1] for o in rows if o[0] == p and o[1]] for p in known}
    for p, arts in held.items():
        known[p]["primary_artifact"] = max(dict.fromkeys(arts), key=lambda a: (arts.count(a), -arts.index(a))) if arts else "none"
    cell = lambda p, dims: tuple(known[p][d] for d in dims)
    members = defaultdict(list)
    for p in known:
        for i, dims in enumerate(rate_ladder):
            members[i, cell(p, dims)].append(p)
    rate = lambda key, a: sum(a in held[m] for m in members[key]) / len(members[key])
    items, streams = {}, {}
    for p in known:
        key = next((i, cell(p, d)) for i, d in enumerate(rate_ladder) if len(members[i, cell(p, d)]) >= 12 or not d)
        mine = [o for o in rows if o[0] == p]
        told = [y for q, _, y in resolved if q == p]
        cred = told or [1 / (1 + math.exp(-weight.get(c, 0.0))) for c in {o[3] or "unknown" for o in mine}]
        first = {}
        for o in mine:
            first.setdefault((o[1] or "none", o[2] or ""), o[4])
        top = (len(rate_ladder) - 1, ())
        build = [max(0, min(1, b + 0.5 * ((rate(top, a) if a != "none" else 0) - (rate(key, a) if a != "none" else 0)))) for (a, _), b in first.items()]
        streams[p] = {"credibility": cred, "build": build}
        items[p] = sum(rate(key, a) for a in {x for xs in held.values() for x in xs} if a not in held[p] and rate(key, a) >= 0.25)
    mean = lambda xs: sum(xs) / len(xs)
    var = lambda xs: mean([(x - mean(xs)) ** 2 for x in xs]) if len(xs) > 1 else 0.0

    def constants(groups, borrow=None):
        groups = [g for g in groups if g]
        if not groups:
            return {"sigma2": 0.04, "k": 4.0, "grand": 0.5, "multi": 0, "ok": False}
        values, multi = [x for g in groups for x in g], [g for g in groups if len(g) > 1]
        between = var([mean(g) for g in groups])
        if len(multi) >= 20:
            s2 = sum(sum((x - mean(g)) ** 2 for x in g) for g in multi) / sum(len(g) - 1 for g in multi)
            raw = s2 / max(between - s2 * mean([1 / len(g) for g in groups]), s2 / 50, 1e-9)
        else:
            s2 = var(values) if len(values) > 1 else 0.04
            raw = borrow or (s2 / max(between, s2 / 50) if s2 else 1.0)
        return {"sigma2": s2, "k": min(max(raw, 1), 50), "grand": mean(values), "multi": len(multi), "ok": len(multi) >= 20}

    out = {}
    parts = ("credibility", "build")
    first = {c: constants([streams[p][c] for p in known]) for c in parts}
    donors = [c for c in parts if first[c]["ok"]]
    for c in parts:
        fit = first[c] if first[c]["ok"] or not donors else constants([streams[p][c] for p in known], first[max(donors, key=lambda d: first[d]["multi"])]["k"])
        cells = defaultdict(list)
        for p in known:
            if streams[p][c]:
                for i, dims in enumerate(ladder):
                    cells[i, cell(p, dims)].append(mean(streams[p][c]))
        full = [xs for (i, _), xs in cells.items() if i == 0 and len(xs) > 1]
        k_cell = constants(full)["k"] if full else fit["k"]
        for p in known:
            found = [(i, cells[i, cell(p, d)]) for i, d in enumerate(ladder) if (i, cell(p, d)) in cells]
            taken = next(((i, xs) for i, xs in found if len(xs) >= 12 or i == len(ladder) - 1), None)
            parent = next((mean(xs) for i, xs in found if taken and i > taken[0]), fit["grand"])
            m = (len(taken[1]) * mean(taken[1]) + k_cell * parent) / (len(taken[1]) + k_cell) if taken else parent
            ys, k = streams[p][c], fit["k"]
            theta = (sum(ys) + k * m) / (len(ys) + k)
            half = 1.959964 * math.sqrt(fit["sigma2"] / (len(ys) + k)) * math.sqrt(1 + items[p] / (len(ys) + k))
            out[p, c] = (len(ys), *(max(0, min(100, 100 * x)) for x in (theta, theta - half, theta + half)))
    return out


@pytest.mark.parametrize("n", [3, 60, 400])
def test_fit_by_hand(spark, n):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(n)
    people = [(p, rng.choice(["a", "b|c", None]), rng.choice(["solo", "team", None]), rng.choice(["x", "y"]), rng.choice(["r", None])) for p in range(n)]
    obs = [(rng.choice([*range(n), None, 10_000]), rng.choice(["blog", "code", "shop", None]), rng.choice([None, "launch"]), rng.choice(["press", "self_report", "nowhere", None]), rng.random(), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(99)), i) for i in range(3 * n)]
    resolved = [(p, p, rng.random()) for p in range(0, n, 7)]
    weight = {"press": 0.2, "self_report": -1.2}
    frames = spark.createDataFrame(people, PEOPLE), spark.createDataFrame(obs, OBS), spark.createDataFrame(resolved, "person_id long, claim_id long, posterior double")
    pop = P.fit_population(*frames, spark.createDataFrame(list(weight.items()), "source_class string, weight double"))
    got = {(r.person_id, r.component): r for r in P.score_population(pop).collect()}
    want = slow_fit(people, obs, resolved, weight, P.CLASS_LADDER, P.RATE_LADDER)
    assert got.keys() == want.keys()
    for key, (streams, *points) in want.items():
        assert got[key].n == streams
        assert [got[key].point, got[key].low, got[key].high] == pytest.approx(points, abs=0.0501)
    for p in range(n):
        a, b = got[p, "credibility"].point, got[p, "build"].point
        assert got[p, "build"].diverges == got[p, "credibility"].diverges == (round(abs(a - b), 1) >= 12)


def test_nobody(spark):
    people, obs = spark.createDataFrame([], PEOPLE), spark.createDataFrame([], OBS)
    resolved, weight = spark.createDataFrame([], "person_id long, claim_id long, posterior double"), spark.createDataFrame([], "source_class string, weight double")
    assert P.score_population(P.fit_population(people, obs, resolved, weight)).collect() == []
    one = P.fit_population(spark.createDataFrame([(1, None, None, None, None)], PEOPLE), obs, resolved, weight)
    assert {(r.component, r.n, r.point, r.class_mean) for r in P.score_population(one).collect()} == {("credibility", 0, 50.0, 50.0), ("build", 0, 50.0, 50.0)}


FAMILIES = {"post": ["post"], "shop": ["shop"], "rare": ["rare"]}
DEFINES, RUNGS = {"has_shop": ["shop"]}, [["has_shop"], []]


def seen(spark, rows):
    return R.typed_population(spark.createDataFrame(rows, "person_id long, artifact_type string"), FAMILIES, DEFINES)


def test_priors_refuse(spark):
    people = seen(spark, [(p, "post") for p in range(0, 40, 2)] + [(p, "shop") for p in range(36, 40)] + [(p, None) for p in range(40)] + [(p, "shop") for p in range(20, 30)] + [(3, "rare")])
    rows = R.family_priors(people, list(FAMILIES), RUNGS, DEFINES).collect()
    states = {r.family: r.state for r in rows}
    assert states == {"post": "published", "shop": "tautological", "rare": "coverage_gap"}
    assert all(r.p is None and r.level == 1 for r in rows if r.family != "post")
    cell = next(r for r in rows if r.family == "post" and list(r.cell) == ["true"])
    assert (cell.k, cell.n, cell.n_complement) == (7, 14, 26)
    assert cell.p == round((7 + 8 * 0.5) / 22, 4) and cell.p_complement == round((13 + 8 * 0.5) / 34, 4)


def test_manifest_backs_off_and_charges(spark):
    people = seen(spark, [(p, "post") for p in range(30)] + [(p, "other") for p in range(33)] + [(0, "shop"), (1, "shop")])
    priors = R.family_priors(people, list(FAMILIES), RUNGS, DEFINES)
    said = "person_id long, family string, was_found boolean, was_expected boolean, was_penalised boolean, charge double, width double, ordinal int, evidence_id string"
    searched = spark.createDataFrame([(5, "cap_table", False, True, True, -0.5, 2.0, 1, "a"), (5, "cap_table", True, True, False, 0.5, 0.0, 2, "b"), (6, "post", False, False, False, 0.0, 1.0, 1, "c"), (99, "post", True, True, False, 1.0, 0.0, 1, "d")], said)
    rows = {(r.person_id, r.family): r for r in R.manifest_rows(people, priors, RUNGS, searched).collect()}
    assert len(rows) == 33 * 3 + 1 and (99, "post") not in rows
    assert rows[0, "post"].level == 1, "a cell of two people doesn't speak"
    assert rows[0, "shop"].refused == "coverage_gap" and rows[0, "shop"].delta == 0.0
    assert rows[5, "cap_table"].delta == -0.5 and rows[5, "cap_table"].source == "searched" and not rows[6, "post"].found
    assert all(r.delta == 0.0 for r in rows.values() if not r.found and not r.expected)
    bad = spark.createDataFrame([(1, "post", False, False, False, -1.0, 0.0, 1, "x")], said)
    with pytest.raises(Exception, match="not expected"):
        R.manifest_rows(people, priors, RUNGS, bad).collect()


def test_leave_one_out_is_a_new_score(spark, sf):
    """The point without a stream is what a score over the others gives, with constants and classes as they were."""
    pop = plans.fitted(Views(spark, sf), None)
    out = P.leave_one_out(pop).orderBy("person_id", "component", "stream").limit(40).collect()
    for r in out[::8]:
        others = pop.streams.filter((F.col("person_id") == r.person_id) & (F.col("component") == r.component) & (F.col("stream") != r.stream)).agg(F.count("*").alias("n"), F.sum("y").alias("s")).first()
        m = pop.means.filter((F.col("person_id") == r.person_id) & (F.col("component") == r.component)).first().m
        k = pop.constants.filter(F.col("component") == r.component).first().k
        assert r.point_without == pytest.approx(100 * ((others.s or 0) + k * m) / (others.n + k), abs=1e-5)
