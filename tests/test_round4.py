"""Cases of the fourth round's findings."""

import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import fingerprints, near_text, suffix_dedup


def test_votes_of_a_long_text_of_one_term(spark):
    word = "characteristically"
    got = fingerprints.add_votes(spark.createDataFrame([(1, f"{word} " * 9000 + word), (2, f"{word} {word}")], "k int, text string"), ["k"]).collect()
    assert len({(r.hi, r.lo) for r in got}) == 1
    term = spark.createDataFrame([(f"{word} {word}",)], "t string").select(fingerprints.term_hashes(F.col("t"))[0].alias("h")).first().h
    assert got[0].hi % 2**64 == xxhash.xxh64_intdigest(term.to_bytes(8, "little", signed=True), 42)


def test_keys_of_many_queries_are_not_sent_to_every_task(spark, monkeypatch):
    rows = spark.range(300).select(F.xxhash64("id").alias("hi"), F.xxhash64("id", F.lit(1)).alias("lo"))
    few = fingerprints.search(rows, rows)
    monkeypatch.setattr(fingerprints, "SENT", 300 * 28 - 1, raising=False)
    many = fingerprints.search(rows, rows)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(few) and "Broadcast" not in plan(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and many.count() == 300


def test_a_filter_reaches_the_driver_as_bits_alone(spark, monkeypatch):
    sent = []
    for name in ("toPandas", "toArrow"):
        kind = type(spark.range(0))

        def counted(self, *a, real=getattr(kind, name), **b):
            got = real(self, *a, **b)
            sent.append(sum(x.memory_usage(deep=True) for _, x in got.items()) if hasattr(got, "memory_usage") else got.nbytes)
            return got

        monkeypatch.setattr(kind, name, counted)
    keys = spark.range(400_000).select(F.xxhash64("id").alias("h"))
    marks = suffix_dedup._filter(keys, "h")
    monkeypatch.undo()
    h = np.array([r.h for r in keys.collect()], np.int64)
    assert marks[0] == 24 and suffix_dedup._passes(marks, h).all()
    want = np.zeros(1 << 24, bool)
    for b in suffix_dedup._bits(h, 24):
        want[b] = True
    assert (np.packbits(want, bitorder="little").view("<u4") == marks[1]).all()
    assert sum(sent) < 1.3 * 2**24 / 8


def test_a_forest_goes_on_to_the_next_group():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**63, (5, 4)).astype(np.uint64)
    fp[2], fp[4] = fp[1] ^ np.uint64(1), fp[3] ^ np.uint64(6)
    links, beyond = near_text.nearest_forest(fp, None, near_text.RADIUS)
    assert sorted(map(sorted, links)) == [[1, 2], [3, 4]] and not beyond.any()


def test_no_candidate_that_could_join_two_groups_is_left_out(spark):
    """Texts of one family about the threshold: the groups are those of all pairs that meet in the index, each compared."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(90)]
        for _ in range(14):
            own = list(base)
            for k in rng.sample(range(90), rng.randint(1, 2)):
                own[k] = word()
            texts.append(" ".join(own))
    fp = near_text.votes(*near_text.shingles(texts, 5), len(texts))
    sets = [np.unique((near_text.shingles([t], 5)[0] >> np.uint64(32)).astype(np.uint32)) for t in texts]
    group, triples = list(range(len(texts))), np.array(near_text.triples())
    for i, j in itertools.combinations(range(len(texts)), 2):
        x = fp[i] ^ fp[j]
        same = x.byteswap().view(np.uint8) == 0
        if np.bitwise_count(x).sum() <= near_text.RADIUS and same[triples].all(axis=1).any() and near_text.alike(sets[i], sets[j]) >= 0.8:
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    got = near_text.near_duplicate_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("kept")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(group)) and 6 < len(set(group)) < len(texts) - 6
