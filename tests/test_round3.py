"""Cases of the third round's findings."""

from pyspark.sql import functions as F

from palimpsest.operators import texts as T


def test_only_closed_entities_are_decoded(spark):
    pages = ["<p>and&amp To&amp;&amp;&amp</p>", "&lt;b&gt; &#39;&#x41; &copy &copy;&eacute;", "&amp;lt; &nosuch; &notit; &;", None]
    got = [r.t for r in spark.createDataFrame(list(enumerate(pages)), "i int, h string").orderBy("i").select(T.clean_markup(F.col("h")).alias("t")).collect()]
    assert got == ["and&amp To&&&amp", "<b> 'A &copy ©é", "&lt; &nosuch; &notit; &;", None]


def test_terms_of_many_documents_are_weighed_together():
    import math
    from collections import Counter

    import numpy as np

    from palimpsest.llm import packing

    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 40, n).astype("<u2") for n in (1, 50, 3, 3, 200, 17)] + [np.array([60], "<u2"), np.zeros(0, "<u2")]
    df = np.bincount([t for x in docs for t in set(x.tolist())], minlength=70)
    w = packing.Weights(df, len(docs), 40.0)
    want = {(i, t): math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(x) / 40)) for i, x in enumerate(docs) for t, n in Counter(x.tolist()).items()}
    doc, term, weight = w.of(docs)
    assert list(zip(doc.tolist(), term.tolist())) == sorted(want) and np.allclose(weight, [want[k] for k in sorted(want)])
    for x, lead in zip(docs, w.leading(docs, 3).tolist()):
        i = next(k for k, y in enumerate(docs) if y is x)
        best = sorted((-round(v, 12), t) for (d, t), v in want.items() if d == i and df[t] > 1)[:3]
        assert lead == [t for _, t in best] + [-1] * (3 - len(best))
    assert sum(map(len, packing.in_groups(docs, 60))) == len(docs)


def test_texts_are_cut_into_runs_once(spark):
    pages = spark.createDataFrame([(1, "it is a much longer excerpt of words here"), (1, "it is a much longer excerpt of words here"), (2, "a much longer excerpt of other words"), (3, None)], "p int, t string")
    said = spark.createDataFrame([(7, "a much longer excerpt of words"), (8, "longer excerpt of none of it")], "e int, s string")
    found = T.passages_in_texts(said, pages, "e", "s", "p", "t")
    assert sorted(map(tuple, found.collect())) == [(7, 1), (7, 1)]
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_timer_of_an_earlier_batch_forgets_nothing(spark, tmp_path):
    from datetime import datetime

    from palimpsest.streaming import jobs

    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    day = lambda d, h=0: datetime(2024, 1, d, h)
    schema = "person_id long, observed_at timestamp, observation_id long, weight double"
    # two timers of one key wait: the second batch's is the earlier and fires, the first batch's expires after it
    for rows in ([(1, day(5), 1, 1.0)], [(1, day(4, 12), 2, 3.0)], [(2, day(20), 3, 0.1)], [(1, day(21), 4, 9.0), (2, day(25), 5, 0.1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_trigger(spark.readStream.schema(schema).parquet(source), out, state, 3.0).awaitTermination()
    assert [tuple(r) for r in spark.read.schema(jobs.TRIGGERS).parquet(out).collect()] == [(1, day(4, 12), 3.0)]


def test_observations_and_claims_are_read_once(spark):
    from palimpsest.operators import population as P

    reads = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(df, reads):
        def once(batches):
            for x in batches:
                reads.add(len(x))
                yield x

        return df.mapInPandas(once, df.schema)

    people = spark.createDataFrame([(i, "s", "solo", "t", "r") for i in range(4)], "person_id long, sector string, solo_or_team string, resource_tier string, region string")
    obs = spark.createDataFrame([(0, "a", None, "press", 0.5, "2024-01-02", 1), (0, "a", None, "press", 0.1, "2024-01-01", 2), (1, None, "launch", None, 0.3, "2024-01-01", 3), (None, "a", None, "press", 0.9, "2024-01-01", 4), (9, "a", None, "press", 0.9, "2024-01-01", 5)], "person_id long, artifact_type string, milestone_type string, source_class string, base double, observed_at string, observation_id long")
    resolved = spark.createDataFrame([(2, 7, 0.8)], "person_id long, claim_id long, posterior double")
    weight = spark.createDataFrame([("press", 0.2)], "source_class string, weight double")
    pop = P.fit_population(people, counted(obs, reads[0]), counted(resolved, reads[1]), weight)
    rows = {(r.person_id, r.component, r.stream): round(r.y, 3) for r in pop.streams.collect()}
    assert rows == {(0, "credibility", "press"): 0.55, (1, "credibility", "unknown"): 0.5, (2, "credibility", "claim 7"): 0.8, (0, "build", "a"): 0.1, (1, "build", "none/launch"): 0.3}
    assert len(pop.constants.collect()) == 2 and len(P.score_population(pop).collect()) == 8
    assert [x.value for x in reads] == [5, 1]
