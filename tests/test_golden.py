"""Hand-made cases, equivalences and plans."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import aggregates as A
from palimpsest.operators import ledger as L
from palimpsest.operators import predicates as P
from palimpsest.operators import ranking as R
from palimpsest.operators import scoring as S
from palimpsest.operators import temporal as T
from palimpsest.operators.resolve import domain_key, handle_key, name_key
from palimpsest.plans import QUERIES
from palimpsest.sources.views import Views, reliability

EVIDENCE = "claim_id long, evidence_id string, ordinal int, kind string, found boolean, expected boolean, penalised boolean, source_class string, log_odds_delta double, findability_prior double, interval_widen double"


def claims(spark, deltas):
    rows = [(c, f"e{c}-{i}", i, kind, True, True, False, "press", d, None, 0.0) for c, kind, ds in deltas for i, d in enumerate(ds)]
    ids = spark.createDataFrame([(c, 1, False) for c, _, _ in deltas], "claim_id long, person_id long, is_manifest_predicted boolean")
    return ids, spark.createDataFrame(rows, EVIDENCE)


def test_claim_states(spark):
    ids, ev = claims(spark, [(1, "corroborating", [-1.2, 0.6, -2.8, -1.3]), (2, "corroborating", [-1.2, -2.2]), (3, "corroborating", []), (4, "expected_absent", [None])])
    out = {r.claim_id: r for r in S.claim_log_odds(ids, ev, reliability(spark)).collect()}
    assert (out[1].log_odds, out[1].state, round(out[1].posterior, 3)) == (-4.7, "contradicted", 0.009)
    assert (out[2].log_odds, out[2].state) == (-3.4, "contradicted")
    assert (out[3].log_odds, out[3].state, out[3].n_evidence) == (0.0, "unverified", 0)
    assert (out[4].state, out[4].posterior) == ("absent_but_expected", None)


def test_absence_not_expected_is_free(spark):
    ids = spark.createDataFrame([(1, 1, False)], "claim_id long, person_id long, is_manifest_predicted boolean")
    ev = spark.createDataFrame([(1, "e", 1, "expected_absent", False, False, True, "press", None, 0.9, 1.0)], EVIDENCE)
    assert S.claim_log_odds(ids, ev, reliability(spark)).first().log_odds == 0


def test_presence(spark):
    row = spark.range(1).select(S.p_absent(F.lit(0.18), F.lit(0.1), F.lit(0), F.lit(0)).alias("a"), S.p_present(F.lit(0.18), F.lit(0.1), F.lit(0), F.lit(2)).alias("b")).first()
    assert (round(row.a, 6), row.b) == (0.82, 0.75)


def test_median_interval_kinds(spark):
    df = spark.createDataFrame([("n0", None), ("n1", 3.0), *[("n5", float(i)) for i in range(5)], *[("n6", float(i)) for i in range(6)]], "k string, x double")
    assert {r.k: (r.n, r.ci_kind) for r in A.median_interval(df, "k", "x").collect()} == {"n0": (0, "insufficient"), "n1": (1, "single"), "n5": (5, "observed_range"), "n6": (6, "order_statistic_95")}
    assert A.order_index(5000) > 2000  # no overflow


def test_trend(spark):
    pts = spark.createDataFrame([("up", float(i), 2.0 * i) for i in range(4)] + [("two", 0.0, 1.0), ("two", 1.0, 2.0)], "k string, x double, y double")
    out = {r.k: r for r in T.ols_trend(pts, ["k"], "x", "y").collect()}
    assert (out["up"].slope, out["up"].half_width, out["up"].trend) == (2.0, 0.0, "improving")
    assert out["two"].trend == "insufficient_data"


def test_null_keys_never_collide(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, "u", "a"), (4, "u", "a")], "id long, url string, v string")
    assert sorted(r.id for r in L.new_rows(rows, rows.limit(0), ["url", "v"], ["id"]).collect()) == [1, 2, 3]


def test_unresolved_is_kept(spark):
    df = P.apply_constraints(spark.createDataFrame([(1, None), (2, "EU"), (3, "US")], "id int, region string"), {"s": P.three_valued("region", F.col("region") == "EU")})
    assert {r.id: (r.s, r.passes) for r in df.collect()} == {1: ("unresolved", True), 2: ("match", True), 3: ("mismatch", False)}


def test_gate(spark):
    low = spark.createDataFrame([(1, 56.0, 70.0, 84.0)], "id int, low double, point double, high double")
    row = S.appetite_sweep(low, "id", 55.0).first()
    assert (row.verdict_low, row.verdict_medium, row.differs) == ("probe_further", "decide_now", True)


def test_keys(spark):
    row = spark.createDataFrame([("  José  D'Ångelo ", "https://www.Ex.com/a?b", "@Jo")], "n string, d string, h string").select(name_key(F.col("n")).alias("n"), domain_key(F.col("d")).alias("d"), handle_key(F.col("h")).alias("h")).first()
    assert tuple(row) == ("jose d angelo", "ex.com", "jo")


def test_unknown_filter_is_an_error(spark, sf):
    with pytest.raises(ValueError):
        L.ledger_scan(Views(spark, sf).observation(), "2024-01-20", {"nope": 1})


def test_priors_of_a_small_population_are_refused(spark):
    df = spark.createDataFrame([("a", 10)], "k string, n long")
    with pytest.raises(Exception, match="fewer than"):
        L.large_enough(df, df.limit(0), "k", "n").collect()


def test_leave_one_out_is_a_new_score(spark):
    ids, ev = claims(spark, [(1, "corroborating", [1.0, 2.5, -4.0])])
    rel = reliability(spark)
    for r in S.claim_leave_one_out(S.with_delta(ev, rel), S.claim_log_odds(ids, ev, rel)).collect():
        again = S.claim_log_odds(ids, ev.filter(F.col("evidence_id") != r.evidence_id), rel).first()
        assert (r.log_odds_without, r.state_without) == (again.log_odds, again.state)


def test_slices_are_scans(spark, sf):
    obs = Views(spark, sf).observation()
    joint = {r.slice: r["count"] for r in T.visible_slices(obs, "2024-01-31 00:00:00", [16, 0]).groupBy("slice").count().collect()}
    assert joint == {0: L.asof(obs, "2024-01-31 00:00:00").count(), 16: L.asof(obs, "2024-01-15 00:00:00").count()}


def test_append_twice_changes_nothing(spark, sf, tmp_path):
    rows = L.with_digest(Views(spark, sf).observation(), "value_text").filter("source_url IS NOT NULL")
    key, path = ["source_url", "claim_type", "value_hash"], str(tmp_path / "ledger")
    L.append_ledger(rows, path, key, ["observation_id"])
    n = spark.read.parquet(path).count()
    L.append_ledger(rows, path, key, ["observation_id"])
    assert spark.read.parquet(path).count() == n == rows.select(*key).distinct().count()


def test_state_stream_agrees_with_its_twin(spark, sf):
    both = [{(r.person_id, r.total) for r in QUERIES[q](spark, sf).collect()} for q in ("k3_stream_trigger_state", "k3_stream_trigger")]
    assert both[0] and both[0] <= both[1]


def test_global_rank(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 7919 % 100)
    got = [(r.x, r.id) for r in R.global_rank(df, ["x", "id"], "n").orderBy("n").collect()]
    assert got == sorted(got) and len(got) == 1000


@pytest.mark.parametrize("name", ["f1_claim_log_odds", "c2_backoff_join", "c11_asof_join", "a2_ledger_scan_for_opportunity", "e10_days_of_edge", "h5_opportunity_timing"])
def test_no_loop_joins(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_is_pushed_down(spark, sf):
    plan = QUERIES["b4_staged_funnel"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_shipdate" not in plan.split("ReadSchema")[1]


def test_scalar_helpers(spark):
    from palimpsest.functions import confidence_band, first_mode, leading_number, written_sum

    df = spark.createDataFrame([([-1.2, 0.6], -0.6, ["b", "a", None, "a", "b"], "11_entries_90d")], "t array<double>, s double, m array<string>, v string")
    row = df.select(written_sum("t", "s").alias("line"), first_mode("m").alias("m"), leading_number("v").alias("v"), confidence_band(F.lit(-2.5)).alias("c")).first()
    assert tuple(row) == ("-1.2 + 0.6 = -0.6", "b", 11.0, "high")


def test_fronts_peel_and_finish_alike(spark, sf):
    from palimpsest.plans.ranking import vectors

    v = vectors(Views(spark, sf))
    one, two = (sorted(map(tuple, R.pareto_fronts(v, "a", "level", "b", small=n).collect())) for n in (10**6, 120))
    assert one == two and max(r[3] for r in one) > 3


def test_fronts_are_told_to_the_last(spark):
    """A chain of more than a thousand fronts among others, in one task and over ranges, against a pass over all pairs."""
    import random

    rng = random.Random(3)
    vectors = list({*((i, i * 3 // 1600, i) for i in range(1600)), *((rng.randrange(1600), rng.randrange(3), rng.randrange(1600)) for _ in range(400))})
    want: dict[tuple, int] = {}
    for x in sorted(vectors, key=lambda v: (-v[0], -v[2], -v[1])):
        want[x] = 1 + max((f for y, f in want.items() if all(p >= q for p, q in zip(y, x))), default=-1)
    assert max(want.values()) > 1500
    df = spark.createDataFrame(vectors + vectors[:50], "a long, level long, b long")
    for small in (10**6, 700):
        got = {(r.a, r.level, r.b): r.front for r in R.pareto_fronts(df, "a", "level", "b", small=small).collect()}
        assert got == want


def test_facts_and_their_spellings(spark):
    """Facts of an excerpt, the spellings of a number, and verdicts by them."""
    from palimpsest.operators import texts as T

    df = spark.createDataFrame([(1, "on 2024-05-06 23 % of $41K, v1.2.3, serial 98/441,207 and 3 people, 007")], "k int, t string")
    found = {(r.kind, r.raw, r.hard) for r in T.extract_atoms(df, "k", "t").collect()}
    assert found == {("date", "2024-05-06", True), ("percent", "23 %", True), ("money", "$41K", True), ("version", "v1.2.3", True), ("serial", "98/441,207", True), ("count", "3", False), ("count", "007", False)}
    raws = spark.createDataFrame([(x,) for x in ("98/441,207", "41K", "$1.5m", "007", "0.4.1")], "r string")
    forms = {r.r: set(r.f) for r in raws.select("r", T.digit_forms(F.col("r")).alias("f")).collect()}
    assert forms["98/441,207"] == {"98441207", "98", "441", "207"} and {"41", "41000"} <= forms["41K"] and "1500000" in forms["$1.5m"] and forms["007"] == {"007", "7"} and "0.4.1" in forms["0.4.1"]
    rows = [
        (1, "raised $41K", "they raised 41,000 dollars", 200), (2, "serial 98441207", "No. 98/441,207 filed", 200), (3, "raised $41K", "they raised nothing", 200), (4, "plain words", "other text", 200),
        (5, "It’s  “here”", 'well it\'s "here" now', 200), (6, "uses v1.2", "since 1.2 it runs", 200),
    ]
    checks = spark.createDataFrame([(*r, False, False, "http://a.example.com/") for r in rows], "check_id int, excerpt string, page_text string, http_status int, expected_absent boolean, claimed_found boolean, url string")
    got = {r.check_id: r.verdict for r in T.verify_excerpts(checks).collect()}
    assert got == {1: "PASS", 2: "PASS", 3: "MISMATCH", 4: "SOFT-OK", 5: "PASS", 6: "PASS"}


def test_short_excerpts_are_found(spark):
    from palimpsest.operators import texts as T

    said = ["two words", "x", "glued", "a much longer excerpt of words", "nowhere at all"]
    pages = ["here are two words indeed", "unglued text", "it is a much longer excerpt of words here", ""]
    got = T.passages_in_texts(spark.createDataFrame(list(enumerate(said)), "e int, s string"), spark.createDataFrame(list(enumerate(pages)), "p int, t string"), "e", "s", "p", "t")
    assert {(r.e, r.p) for r in got.collect()} == {(i, j) for i, x in enumerate(said) for j, y in enumerate(pages) if x in y}


def test_order_index_is_the_binomial_tail():
    for n in [*range(0, 120), 399, 1000, 5001]:
        total, l = 0.0, 0
        while l < n and total + math.comb(n, l) / 2**n <= 0.025:
            total += math.comb(n, l) / 2**n
            l += 1
        assert A.order_index(n) == l
    assert 499_000_000 < A.order_index(10**9) < 500_000_000


def test_medians_and_sums_by_ranges(spark):
    from palimpsest.operators.ranking import medians, sums_before

    rows = [("a", i, float(i * 7 % 101)) for i in range(300)] + [("b", 1, 4.0), ("b", 2, None), ("b", 3, 5.0), (None, 1, 2.0), ("c", 1, None)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    got = {r.k: r.m for r in medians(df, ["k"], {"m": F.col("x")}).collect()}
    assert got == {"a": statistics.median(r[2] for r in rows[:300]), "b": 4.5, None: 2.0}
    sums = {(r.k, r.i): (r.s, r.s_all) for r in sums_before(df, ["k"], ["i"], "x", "s").collect()}
    for k in ("a", "b", None, "c"):
        own, before = [r for r in rows if r[0] == k], 0.0
        for _, i, x in own:
            assert sums[k, i] == (before, sum(r[2] or 0.0 for r in own))
            before += x or 0.0
    empty = df.limit(0)
    assert medians(empty, ["k"], {"m": F.col("x")}).count() == 0 and sums_before(empty, ["k"], ["i"], "x", "s").count() == 0


def test_backoff_keeps_every_row(spark):
    from palimpsest.operators import joins as J

    ladder = [["a", "b"], ["a"], []]
    people = spark.createDataFrame([(1, "x", "y"), (1, "x", "y"), (2, "x", None), (3, "z", "y")], "id int, a string, b string")
    cells = spark.createDataFrame([(0, "a=x|b=y", 3, 1.0), (1, "a=x", 9, 2.0), (2, "", 1, 3.0)], "level int, cell string, n int, mean double")
    of = lambda c: sorted((r.id, r.level, r.mean) for r in J.backoff_join(people, c, ladder, ["a", "b"], ["mean"], least=5).collect())
    assert of(cells) == [(1, 1, 2.0), (1, 1, 2.0), (2, 1, 2.0), (3, 2, 3.0)]
    none = J.backoff_join(people, cells.filter("level = 0"), ladder, ["a", "b"], ["mean"], least=5)
    assert [r.level for r in none.collect()] == [None] * 4


def test_id_drift_by_beginnings(spark):
    from palimpsest.operators import joins as J

    ids = ["ch_abc", "ch_ab", "ch_", "ch_q", "a", "ab", "abcd", "abx", "", "b", None]
    got = {tuple(r) for r in J.id_drift_pairs(spark.createDataFrame([(i,) for i in ids], "id string"), "id").collect()}
    assert got == {(d, o) for d in ids[:4] for o in ids[4:10] if o and d[3:] and (d[3:].startswith(o) or o.startswith(d[3:]))}


def test_volumes_close_and_late_rows_are_told(spark, tmp_path):
    from datetime import datetime, timedelta

    from palimpsest.streaming import jobs

    day = lambda n, h=1: datetime(2024, 1, 1) + timedelta(days=n, hours=h)
    read = lambda: spark.readStream.schema("c string, at timestamp").parquet(str(tmp_path / "in"))
    late = 0
    for rows in ([("a", day(0)), ("a", day(0, 2)), ("b", day(1)), ("a", day(5))], [("a", day(0, 3)), ("b", day(9))]):
        spark.createDataFrame(rows, "c string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = jobs.stream_volume(read(), str(tmp_path / "out"), str(tmp_path / "state"), "c", "at", "1 day")
        run.awaitTermination()
        late += jobs.late_groups(run)
    got = sorted((r.c, r.start, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", day(0, 0), 2), ("a", day(5, 0), 1), ("b", day(1, 0), 1)]
    assert late == 1
