"""Chains of keys, hot keys, edges without a register, keys without a term, blank excerpts, gated patterns."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import aggregates as A
from palimpsest.operators import joins as J
from palimpsest.operators import resolve as R
from palimpsest.operators import scoring as S
from palimpsest.operators import texts as T
from palimpsest.operators.graphs import connected_components

rng = random.Random(5)
KEYED = "row_id long, given_id string, name_key string, domain_key string, handle_key string"
SPINE = "person_id string, name_key string, domain_key string, handle_key string"


def roots(pairs):
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return {x: root(x) for x in top}


def test_components(spark):
    edges = [(f"c{i}", f"c{i + 1}") for i in range(300)] + [("hub", f"x{i}") for i in range(500)] + [(f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(60)] + [("a", "a"), (None, "b"), ("z", None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges * 2, "a string, b string"), "a", "b").collect()}
    assert got == {x: y for x, y in roots([(a, b) for a, b in edges if a and b and a != b]).items()}
    assert connected_components(spark.createDataFrame([("a", "a")], "a string, b string"), "a", "b").collect() == []


def resolved(spark, rows, spine=()):
    aliases = spark.createDataFrame([], "name_key string, person_id string")
    return {r.row_id: (r.person_id, r.matched_on) for r in R.resolve_entities(spark.createDataFrame(rows, KEYED), spark.createDataFrame(list(spine), SPINE), aliases).collect()}


def test_shared_name_and_domain_bind_handles(spark):
    got = resolved(spark, [(1, None, "ann", "d.com", "h1"), (2, None, "ann", "d.com", "h2"), (3, None, "bob", None, "h2")])
    assert {p for p, _ in got.values()} == {"new:@h1"}


def test_chains_and_a_hot_handle(spark):
    """Ten people in a chain of handle, name and domain; a handle on a third of all rows; against union-find."""
    rows = [(i, None, f"n{(i + 1) // 2}", "d.com", f"h{i // 2}") for i in range(20)]
    rows += [(100 + i, None, f"m{rng.randrange(40)}", rng.choice([None, "e.com", "f.com"]), rng.choice([None, f"k{rng.randrange(30)}"])) for i in range(200)]
    rows += [(1000 + i, None, f"q{i}", rng.choice([None, "g.com"]), "hot") for i in range(150)]
    got = resolved(spark, rows)
    keys = lambda r: [k for k in (r[4] and f"@{r[4]}", r[3] and f"|{r[2]}|{r[3]}") if k]
    group = roots([(k[0], k[-1]) for k in map(keys, rows) if k])
    by_name = defaultdict(set)
    for r in rows:
        if keys(r):
            by_name[r[2]].add(group[keys(r)[0]])
    for r in rows:
        own = group[keys(r)[0]] if keys(r) else next(iter(by_name[r[2]])) if len(by_name[r[2]]) == 1 else f"|{r[2]}"
        assert got[r[0]] == (f"new:{own}", "new"), r
    assert len({got[i] for i in range(20)}) == 1


def test_a_name_alone_needs_one_compatible_person(spark):
    spine = [("p1", "ann", "d.com", "h1"), ("p2", "ann", None, None), ("p3", "bo", None, "h3"), ("p4", "cy", "x.com", None), ("p5", "cy", "y.com", None)]
    rows = [(1, None, "ann", "other.com", "h9"), (2, None, "ann", None, None), (3, None, "bo", "z.com", None), (4, None, "bo", None, "h8"), (5, None, "cy", "z.com", None), (6, None, "", None, None), (7, None, "", None, None)]
    got = resolved(spark, rows, spine)
    assert got[1] == ("p2", "name") and got[2][1] == "new", "two people of the name are compatible with a bare row"
    assert got[3] == ("p3", "name") and got[4] == ("new:@h8", "new") and got[5] == ("new:|cy|z.com", "new")
    assert got[6] == ("new:#6", "new") and got[7] == ("new:#7", "new")


@pytest.mark.parametrize("most", [10, 10_000])
def test_asof_join_with_a_hot_key(spark, most):
    t0 = datetime(2024, 1, 1)
    at = lambda: t0 + timedelta(minutes=rng.randrange(500))
    left = [(i, rng.choice(["hot"] * 9 + ["a", "b", "only left", None]), at()) for i in range(400)]
    right = [(i, rng.choice(["hot"] * 9 + ["a", "b", "only right", None]), at()) for i in range(300)]
    got = J.asof_join(spark.createDataFrame(left, "id long, k string, t timestamp_ntz"), spark.createDataFrame(right, "r long, k string, u timestamp_ntz"), "k", "t", "u", ["r", "u"], "r", most=most)
    rows = {x.id: (x.k, x.t, x.r, x.u) for x in got.collect()}
    assert len(rows) == len(left)
    for i, k, t in left:
        best = max(((u, r) for r, key, u in right if k is not None and key == k and u <= t), default=(None, None))
        assert rows[i] == (k, t, best[1], best[0])


def test_asof_join_carries_over_ranges_without_values(spark):
    """One value at the start of a key of many ranges reaches its last row."""
    t0 = datetime(2024, 1, 1)
    left = spark.createDataFrame([(i, "hot", t0 + timedelta(minutes=i)) for i in range(2000)], "id long, k string, t timestamp_ntz").repartition(8)
    right = spark.createDataFrame([(7, "hot", t0)], "r long, k string, u timestamp_ntz")
    assert {x.r for x in J.asof_join(left, right, "k", "t", "u", ["r"], "r", most=5).collect()} == {7}


def test_edges_of_every_channel(spark):
    day = lambda d: datetime(2024, 3, 1) - timedelta(days=d)
    rows = [("a", 1, 50, "s"), ("a", 1, 40, "press"), ("a", 2, 20, "s"), ("wild#v2", 1, 45, "s"), ("wild", 3, 5, "s"), ("conf", 1, 60, "s"), ("zero", 4, 3, "s"), ("late", 1, 10, "s"), ("old", None, 90, "s"), (None, 2, 1, "s"), ("a", None, 2, "s"), ("a", 5, 33, "press"), ("future", 9, -3, "s")]
    obs = spark.createDataFrame([(c, p, s, day(d)) for c, p, d, s in rows], "channel_id string, person_id long, source_class string, observed_at timestamp_ntz")
    known = spark.createDataFrame([("a", "discovery", True, True), ("conf", "confirmation", True, True), ("zero", "discovery", False, True), ("none", "discovery", True, True)], "channel_id string, kind string, native boolean, active boolean")
    got = {r.channel_id: r for r in A.days_of_edge(obs, F.col("source_class") == "press", known, "2024-03-01 00:00:00", ["zero"]).collect()}
    assert set(got) == {"a", "conf", "zero", "none", "wild", "late"}, "unregistered channels stay, rows of nobody long ago and of later don't make one"
    a = got["a"]
    assert (a.n_lags, a.n_censored, a.median_days_edge, a.censored_followed, a.volume, a.n_unkeyed, a.thin) == (2, 1, 5.0, 20.0, 2, 1, True), "a person seen in a consensus row alone has a lag of 0"
    assert (got["wild"].kind, got["wild"].registered, got["wild"].n_lags, got["wild"].n_censored, got["wild"].basis) == ("unregistered", False, 1, 1, "measured")
    assert (got["late"].n_late, got["late"].median_days_edge) == (1, -30.0)
    assert got["conf"].basis == "not_applicable" and got["conf"].median_days_edge is None
    assert got["zero"].basis == "by_construction" and got["zero"].median_days_edge == 0.0 and got["none"].basis == "insufficient"
    assert {r.volume_denominator for r in got.values()} == {5}


def test_keys_without_a_term_stay(spark):
    terms = spark.createDataFrame([(1, "press", 0.0, datetime(2024, 1, 1))], "k long, kind string, value double, at timestamp_ntz")
    shifts = spark.createDataFrame([(1, 0.1), (2, -0.4)], "k long, shift double")
    got = {r.k: tuple(r)[1:] for r in S.axis_market(terms, "k", shifts).collect()}
    assert got == {1: (1, 0.3, "neutral"), 2: (0, -0.4, "bear")}
    context = spark.createDataFrame([(1, "bear", 2, 0.0, 1, 60.04), (3, "bear", 1, -0.5, 0, 59.96)], "k long, label string, market_n long, shift double, widening int, build_low double")
    fit = {r.k: r for r in S.axis_fit(terms.withColumn("state", F.lit(None).cast("string")), context, "k", 60.0).collect()}
    assert fit[3].n == 1 and fit[3].point == 45.7 and fit[3].carries is True, "59.96 is 60.0 on one decimal"


def test_blank_excerpts_pass(spark):
    rows = [(1, None, "page", 200), (2, "  ", "page", 200), (3, None, "page", 404), (4, "about 1,234 things here", "1234 items listed", 200), (5, "about 1,239 things", "1234", 200), (6, "good words only", None, 200), (7, "there were three", "there were three", 200)]
    checks = spark.createDataFrame([(*r, False, True, None) for r in rows], "check_id long, excerpt string, page_text string, http_status int, expected_absent boolean, claimed_found boolean, url string")
    got = {r.check_id: (r.verdict, round(r.overlap, 3)) for r in T.verify_excerpts(checks).collect()}
    assert got == {1: ("PASS", 0.0), 2: ("PASS", 0.0), 3: ("ABSENT-BAD", 0.0), 4: ("PASS", 0.0), 5: ("MISMATCH", 0.0), 6: ("SOFT-OK", 0.0), 7: ("PASS", 0.0)}


def test_gates_lose_no_pattern(spark):
    """Whatever a pattern of lived experience matches holds one of its words."""
    said = ["We ran it", "WE ended up", "I built x", "in  production", "In Production", "on-call", "oncall", "postmortem", "Post-Mortem", "an outage", "downtime!", "at my previous startup", "when I was at", "While I worked at", "I've been", "i have shipped", "Our stack", "we realised", "the hard way", "my cofounder", "my co-founder", "we were paying", "used to run", "currently work", "I do this for", "i did this at", "from experience", "we invoice"]
    texts = [" ".join(rng.choice(said) for _ in range(rng.randrange(1, 4))) for _ in range(300)] + said + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    both = [(F.col("t").rlike("(?i)" + p), F.lower("t").rlike("|".join(need))) for p, need in zip(T.LIVED, T.NEEDED)]
    assert len(T.LIVED) == len(T.NEEDED)
    wrong = df.select(*[F.count_if(a & ~b).alias(f"w{i}") for i, (a, b) in enumerate(both)], *[F.count_if(a).alias(f"m{i}") for i, (a, _) in enumerate(both)]).first().asDict()
    assert not any(v for k, v in wrong.items() if k[0] == "w") and all(v for k, v in wrong.items() if k[0] == "m")
    scored = T.with_signal_score(df, "t", ["ran"], ["stack"]).collect()
    assert len(scored) == len(texts) and [r.score for r in scored if r.t is None] == [None] and all(0 <= r.score <= 1 for r in scored if r.t is not None)


def ledger_of(spark, path):
    from palimpsest.operators.keyed import KeyedLedger

    return KeyedLedger(spark, path, ["url", "kind"], ["id"], "at", buckets=8)


def ledger_rows(spark, ids, kind="a"):
    return spark.createDataFrame([(i, None if i % 10 == 9 else f"u{i % 50}", kind, datetime(2024, 1 + i % 3, 1)) for i in ids], "id long, url string, kind string, at timestamp_ntz")


def told(ledger):
    return sorted((r.id, r.url) for r in ledger.rows().collect())


def test_keyed_ledger(spark, tmp_path):
    """First rows of keys held nowhere come in; null keys always; joined key parts don't blur."""
    ledger = ledger_of(spark, str(tmp_path / "ledger"))
    ledger.append(ledger_rows(spark, range(60)))
    assert told(ledger) == sorted((i, None if i % 10 == 9 else f"u{i}") for i in range(60) if i < 50 or i % 10 == 9)
    before = told(ledger)
    ledger.append(ledger_rows(spark, [i for i in range(60) if i % 10 != 9]))
    assert told(ledger) == before
    ledger.append(ledger_rows(spark, [1, 101], "b"))
    assert told(ledger) == sorted([*before, (1, "u1")])
    odd = spark.createDataFrame([(1, "x", "yz", datetime(2024, 1, 1)), (2, "xy", "z", datetime(2024, 1, 1))], "id long, url string, kind string, at timestamp_ntz")
    other = ledger_of(spark, str(tmp_path / "other"))
    other.append(odd)
    assert len(told(other)) == 2


def test_keyed_ledger_reads_its_buckets_alone(spark, tmp_path):
    ledger = ledger_of(spark, str(tmp_path / "ledger"))
    ledger.append(ledger_rows(spark, range(50)))
    plan = ledger.new_rows(ledger_rows(spark, [3]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("dies", ["before the folder is whole", "before the ledger", "within the ledger", "before the index", "before the folder goes"])
def test_keyed_ledger_outlives_its_writer(spark, tmp_path, monkeypatch, dies):
    from palimpsest.operators import keyed

    path = str(tmp_path / "ledger")
    ledger = ledger_of(spark, path)
    ledger.append(ledger_rows(spark, range(20)))
    batch = ledger_rows(spark, range(10, 45))
    name = ledger._stage(batch)
    if dies == "before the folder is whole":
        keyed.Folder(spark, f"{path}-pending/{name}/_SUCCESS").delete()
    if dies in ("before the index", "before the folder goes"):
        ledger._to_ledger(spark.read.parquet(f"{path}-pending/{name}"), name, begun=False)
    if dies == "within the ledger":
        ledger._to_ledger(spark.read.parquet(f"{path}-pending/{name}").filter("id % 2 = 0"), name, begun=False)
    if dies == "before the folder goes":
        keys = spark.read.parquet(f"{path}-pending/{name}").filter("_digest IS NOT NULL").select("_digest", "_bucket")
        keys.write.mode("append").partitionBy("_bucket").parquet(ledger.index)
    again = ledger_of(spark, path)
    again.append(ledger_rows(spark, [i for i in range(10, 45) if i % 10 != 9]))
    bare = 1 if dies == "before the folder is whole" else 2  # rows of null keys come with the batch that brought them
    want = [(i, None if i % 10 == 9 else f"u{i}") for i in range(45) if i % 10 != 9 or i < 20 or bare == 2]
    want += [(19, None)] if bare == 2 else []
    assert told(again) == sorted(want) and keyed.Folder(spark, again.pending).names() == []


def test_constraints_are_rows(spark):
    from palimpsest.operators import compound as C

    people = spark.createDataFrame([(1, "law", 5.0, 0, 3, 50.0), (2, None, 1.0, 2, 9, 40.0), (3, "tax", None, 0, 0, 60.0), (4, "law", 9.0, 1, 2, 50.0), (5, "law", 9.0, 1, 2, 50.0)], "id long, sector string, size double, hits long, n long, point double")
    known = C.attributes(["sector"], ["size"], ["hits"])

    def run(*rows):
        out = C.evaluate(people, spark.createDataFrame(list(rows), C.CONSTRAINT), known, "n")
        return out, [r.id for r in C.ranked(out, "point", "n", "id").collect()]

    hard = (1, "sector", "in", ["law"], None, None, None, True, False)
    out, ids = run(hard)
    assert ids == [1, 4, 5, 2], "an unresolved field stays; by point, then n, then id"
    assert run((1, "sector", "in", ["law"], None, None, None, True, True))[1] == [3, 2]
    assert run((1, "sector", "contains", ["AW", "q"], None, None, None, True, False))[1] == [1, 4, 5, 2]
    assert run((1, "size", "at_least", None, 5.0, None, None, True, False), (2, "size", "at_most", None, 8.0, None, None, True, False))[1] == [3, 1]
    out, ids = run(hard, (7, "hits", "evidence", None, None, 0.18, 0.1, False, True), (9, "elsewhere", "in", ["x"], None, None, None, False, False))
    rows = {r.id: r for r in out.collect()}
    p = round(0.82 / (0.82 + 0.18 * 0.9**3), 4)
    assert rows[1].p_all == pytest.approx(p * 0.5) and rows[4].p_all == 0.0 and ids == [1, 2, 4, 5] or ids == [1, 4, 5, 2]
    chips = {r.constraint_id: tuple(r)[1:] for r in C.constraint_chips(out).collect()}
    assert chips[1] == (3, 1, 1, 0, None) and chips[9] == (0, 0, 0, 4, 0.5)
    s = C.cold_start_survival(out, "n", "hits").first()
    assert (s.n_total, s.n_kept, s.n_without_evidence, s.n_thin, s.kept_unresolved, s.applies) == (5, 4, 1, 2, 1, True)
    none, ids = run()
    assert len(ids) == 5 and {r.p_all for r in none.collect()} == {1.0} and not C.cold_start_survival(none, "n", "hits").first().applies


def test_trigger_goes_on_from_its_checkpoint(spark, tmp_path):
    """What waits at the end of one input fires after the next; nothing fires twice, rows in any order."""
    from palimpsest.streaming import jobs

    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    day = lambda d, h=0: datetime(2024, 1, d, h)
    schema = "person_id long, observed_at timestamp, observation_id long, weight double"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_trigger(spark.readStream.schema(schema).parquet(source), out, state, 3.0).awaitTermination()
        return sorted((r.person_id, r.triggered_at, r.total) for r in spark.read.schema(jobs.TRIGGERS).parquet(out).collect())

    first = feed([(1, day(3), 3, 2.0), (1, day(1), 1, 1.0), (1, day(2), 2, 1.0), (2, day(4), 4, 5.0), (None, day(1), 5, 9.0), (3, day(1), 6, 1.0), (4, day(5), 7, 0.1)])
    assert first == [(1, day(3), 4.0), (2, day(4), 5.0)], "the watermark is a day before the latest row"
    second = feed([(1, day(6), 8, 9.0), (3, day(6), 9, 2.0), (3, day(1), 10, 9.0), (4, day(20), 11, 0.1)])
    assert second == [*first, (3, day(6), 3.0)], "a late row is dropped, a key fires once"
    assert feed([(2, day(25), 12, 9.0), (4, day(28), 13, 9.0), (4, day(30), 14, 0.0)]) == [*second, (4, day(28), 9.2)]


FEED = """<?xml version="1.0"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://x.example.org/schemas"><title>all</title>
<entry><id>http://x.example.org/abs/1.1</id><title>One
  two</title><summary> An  abstract </summary><published>2024-01-02T03:04:05Z</published><author><name>Ann  B</name><arxiv:affiliation>Lab</arxiv:affiliation></author><author><name> </name></author><author><name>Bo</name></author><category term="cs.LG"/><category term=""/><category term="cs.AI"/><arxiv:primary_category term="cs.LG"/></entry>
<entry><id>http://x.example.org/abs/2</id><title>No date</title><published>soon</published><author><name>Cy</name></author></entry>
<entry><title>No id</title><published>2024-01-02T00:00:00Z</published><author><name>Cy</name></author></entry>
<entry><id>3</id><published>2024-01-02T00:00:00Z</published></entry>
<entry><id>4</id><published>2024-01-02T00:00:00Z</published><author><name>Di</name></author></entry>
</feed>"""


def test_nested_feed(spark, tmp_path):
    from palimpsest.operators.ledger import feed_rows
    from palimpsest.sources.feeds import first_entries, read_feed

    for name, text in (("a", FEED), ("b", FEED.replace("Ann  B", "Other").replace("<id>4</id>", "<id>5</id>")), ("c", "<feed><entry><id>6</id><broken></entry></feed>")):
        (tmp_path / f"{name}.xml").write_text(text)
    feed = read_feed(spark, str(tmp_path))
    got = {r.entry: r for r in first_entries(feed).collect()}
    assert sorted(got) == ["1.1", "4", "5"]
    one = got["1.1"]
    assert (one.title, one.abstract, one.published, one.category, one.categories) == ("One two", "An abstract", datetime(2024, 1, 2, 3, 4, 5), "cs.LG", ["cs.LG", "cs.AI"])
    assert [tuple(x) for x in one.authors] == [("Ann B", "Lab"), ("Bo", None)], "the first file wins"
    rows = {tuple(r) for r in feed_rows(first_entries(feed), "entry", "authors", "abstract").filter("entry = '1.1'").collect()}
    assert rows == {("1.1", "authorship", "Ann B", "Ann B", "team"), ("1.1", "authorship", "Bo", "Bo", "team"), ("1.1", "affiliation", "Ann B", "Lab", "team"), ("1.1", "abstract", "Ann B", "An abstract", "team")}
    assert first_entries(read_feed(spark, str(tmp_path / "c.xml"))).collect() == []
