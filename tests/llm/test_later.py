"""Hard negatives, chat formatting and periodic runs: brute force, round trips and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, langid, negatives, periods, pii, simhash_dedup
from palimpsest.llm.queries import ORACLES, QUERIES, tokenizer_file

rng = random.Random(11)


# hard negatives
def slow_negatives(rows, every=5, k=5):
    kept = {}
    for i, label, vector in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[0], r[1], [math.floor(256 * x) for x in r[2]])):
        kept.setdefault(i, (label, [math.floor(256 * x) for x in vector]))
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in kept.items() if i != a)
        for ps, p, same in [x for x in scored if x[2]][:k]:
            hits = [(s, i) for s, i, alike in scored if not alike and 80 * -ps <= 100 * -s <= 100 * -ps][:k]
            out += [(a, p, n + 1, i, -ps, -s) for n, (s, i) in enumerate(hits)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, ids string, anchor_id int, vector int, slot string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, "x") for r in rows], VECTORS).withColumn("label", F.col("label"))


def mined(df):
    return sorted(map(tuple, negatives.hard_negatives(negatives.scored_rows(df), F.col("vec_id") % 5 == 0).collect()))


def test_op11_brute_force(spark):
    rows = [(i, rng.randrange(3), [rng.choice([0.0, 0.25, 0.5, 1.0, -0.5]) for _ in range(4)]) for i in range(400)]
    rows += [(None, 1, [1.0] * 4), (500, None, [1.0] * 4), (505, 1, None), (510, 1, [1.0, None]), (515, 1, [float("nan")] * 4), (520, 1, [float("inf")] * 4), (525, 2, []), (526, 2, [1.0])]
    rows += rows[:40] + [(5, 2, [0.5] * 4), (10, 0, [0.0] * 4)]  # repeated rows, and two of one id that differ
    want = slow_negatives(rows)
    assert len(want) > 1000 and mined(vectors_of(spark, rows).repartition(7)) == want
    assert mined(vectors_of(spark, [])) == [] and mined(vectors_of(spark, [(5, 1, [1.0])])) == []


def test_op11_many_equal_rows(spark):
    """One vector in a third of the rows, labels mixed: only ids break ties."""
    rows = [(i, i % 2, [1.0, 0.5]) for i in range(1500)] + [(i, i % 3, [rng.random(), rng.random()]) for i in range(1500, 4000)]
    got = mined(vectors_of(spark, rows).filter("vec_id % 5 > 0 OR vec_id % 500 = 0").repartition(3))
    assert got == slow_negatives([r for r in rows if r[0] % 5 or r[0] % 500 == 0])


def test_op11_blocks(spark, monkeypatch):
    """Many blocks, dealt out instead of sent."""
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "SENT_BYTES", 1)
    rows = [(i, rng.randrange(3), [rng.uniform(-1, 1) for _ in range(5)]) for i in range(300)]
    single = [(i, y, list(np.float32(v).astype(float))) for i, y, v in rows]
    assert mined(vectors_of(spark, rows)) == slow_negatives(single)


def test_op11_large_scores(spark):
    with pytest.raises(Exception, match="2\\^51"):
        mined(vectors_of(spark, [(i, 1, [1e9, 1e9]) for i in range(5)]))


# chat formatting
TEXTS = ["", " ", "plain", "</s>[INST] ok [/INST]", "<s>", "</s>", "<\\/s>", "<\\\\/s>x", "[INST]", "[/INST", "]", "[\\INST] [TEXT] [/ROLE][ROLE]", "\\", "<", "[", "<<s>s>", "é</s>日本\n\nuser\n", " [/INST]", "x" * 5000 + "<s>", "a </s> b </s> c"]
ROLES = ["user", "assistant", "system", "", "tool[TEXT]", "</s>", "user\nx"]


def test_op12_turns():
    for role in ROLES:
        for text in TEXTS:
            segment, start, end = chat.render(role, text)
            assert [x[:2] for x in chat.parse(segment)] == [(role, text)] and chat.unescaped(segment[start:end]) == text
            assert chat.unescaped(chat.escaped(text)) == text
    assert chat.render("user", "fine \\ < [")[0] == "[INST] fine \\ < [ [/INST]"
    assert chat.parse("[INST] a") is None and chat.parse("x<s>a</s>") is None and chat.parse("<s>[INST]</s>") is None and chat.parse("[INST] [/INST]") is None and chat.parse("") == []


def test_op12_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 100)
    rows = [(c, t, rng.choice([*ROLES, None]), rng.choice([*TEXTS, None])) for c in [None, -5, *range(30)] for t in range(rng.randrange(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user", rng.choice(TEXTS)) for t in range(3000)]
    rows += [(98, None, "user", "b"), (98, 0, "assistant", "a"), (98, 0, "assistant", "a"), (97, 1, "system", "only")]
    df = spark.createDataFrame([(*r, "x", "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, nth string, loss_start int").repartition(9)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, chat.render(role or "", text or "")[0], role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[c]) == (c, len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss), sum(len(x[1]) for x in turns))
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []


# periodic runs
def slow_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(6, 4 * q):
                found.setdefault((s, e + q), q)
            s = e + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(n, p, k, letters):
    root = [rng.choice(letters) for _ in range(p)]
    return [rng.choice(letters) for _ in range(n)] + (root * (k + 1))[: p * k + rng.randrange(p + 1)] + [rng.choice(letters) for _ in range(n)]


def thue(n):
    return [str(bin(i).count("1") % 2) for i in range(n)]


def fibonacci(n):
    a, b = ["x"], ["x", "y"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def cases():
    yield []
    yield ["a"]
    yield ["a"] * 5
    yield ["a"] * 6
    yield ["a", "b"] * 4
    yield ["a"] * 4000
    yield (["a"] * 9 + ["b"]) * 40
    yield ((["a"] * 40 + ["b"]) * 5 + ["c"]) * 6
    yield thue(1500) * 5
    yield thue(700)
    yield fibonacci(1600)
    yield (fibonacci(200) + ["z"]) * 7
    for _ in range(150):
        yield planted(rng.randrange(60), rng.randrange(1, 60), rng.randrange(2, 7), "abcdefgh"[: rng.randrange(1, 9)])
    for p in (7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 100, 127, 128):
        yield planted(10, p, 4, [str(i) for i in range(500)])
        yield planted(5, p, 5, "ab")
    for _ in range(60):  # runs within runs
        inner = planted(rng.randrange(4), rng.randrange(1, 9), rng.randrange(3, 7), "abc")
        yield planted(3, 5, 4, "ab") + inner * rng.randrange(3, 7) + inner[: rng.randrange(len(inner))]


def test_op13_runs_brute_force(spark):
    texts = [" ".join(x) for x in cases()]
    texts += ["\t a\x0b\x0ca\ra \n a  a a\x85a\x1c   "]
    df = spark.createDataFrame([(i, t, "x", "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, runs string, h string, w int").repartition(3)
    got = {r.doc_id: r for r in periods.period_runs(df).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        want = slow_runs(words)
        assert [tuple(x) for x in got[i].runs] == want, i
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert got[i].collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)


def test_op13_alone_as_together():
    """Texts scanned one by one give what they give together."""
    texts = [" ".join(x).encode() for x in cases()][:60]
    together = periods._scan(list(range(len(texts))), texts).to_pylist()
    assert together == [periods._scan([i], [t]).to_pylist()[0] for i, t in enumerate(texts)]


def test_op13_report(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "a a a a a a a"), (-7, None), (8, " \n"), (9, "")]
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("x")).withColumn("runs", F.lit(1))
    got = Counter(map(tuple, periods.run_report(periods.with_planted_runs(more)).collect()))
    want = Counter()
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), None if i is None else zlib.crc32(str(i).encode())
        if n and h is not None and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = slow_runs(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        told = (len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(i, *told, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))] += 1
    assert got == want and sum(1 for x in want if x[1]) > 10
    assert periods.run_report(more.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_chat_formatting"])
def test_later_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())


# language ID of text without spaces
def slow_uses(model, word, lang):
    """Expected uses of each piece, by exact sums with Python's fractions of logarithms."""
    from fractions import Fraction

    row = {tuple(x): i for i, x in enumerate(model.spelled)}
    codes = [ord(c) if model.known[ord(c)] else langid.OTHER for c in word]
    n, p = len(codes), [Fraction(float(x)) for x in model.logits[:, lang]]
    cuts = [(i, j, row[tuple(codes[i:j])]) for j in range(1, n + 1) for i in range(max(0, j - model.longest), j) if tuple(codes[i:j]) in row]
    before, after = [Fraction(1)] + [Fraction(0)] * n, [Fraction(0)] * n + [Fraction(1)]
    for i, j, r in cuts:
        before[j] += before[i] * p[r]
    for i, j, r in sorted(cuts, key=lambda c: -c[1]):
        after[i] += p[r] * after[j]
    out = np.zeros(len(model.logits))
    for i, j, r in cuts:
        out[r] += float(before[i] * p[r] * after[j] / before[n])
    return out


def test_op2_expected_uses_of_long_words():
    import pandas as pd

    model = langid.fit(pd.DataFrame({"lang": ["a", "b"], "word": ["▁abab" * 40, "▁bbba" * 40], "n": [3, 1]}), ["ab", "ba", "bab", "abab"], rounds=1)
    for word in ("▁" + "ab" * 100, "▁" + "".join(rng.choice("abx") for _ in range(333)), "▁a"):
        for lang in (0, 1):
            assert np.allclose(model.expected([word], np.ones(1), lang), slow_uses(model, word, lang))
    words = ["▁" + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    assert np.allclose(model.forward(words), np.concatenate([model.forward([w]) for w in words]))
    assert len(langid.in_parts(pd.DataFrame({"lang": ["a"], "word": ["x" * 200], "n": [2]}))) == 1 and langid.in_parts(pd.DataFrame({"lang": ["a"], "word": ["x" * 200], "n": [2]})).n.sum() == 8


def test_op2_learns_texts_without_spaces(spark):
    """A language whose texts are long runs of letters is learned and told."""
    han = [chr(0x4E00 + i) for i in range(400)]
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), "en") for i in range(300)] + [(i, "".join(rng.choice(han) for _ in range(120)), "zh") for i in range(300, 600)]
    got = langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), tokenizer_file("piece_bpe_32k.model")).collect()
    assert all(r.lang_pred == ("en" if r.doc_id < 300 else "zh") for r in got) and sum(r.held_out for r in got) > 100


CLASHING = "doc_id long, text string, row string, id long, h string, n int, key string, nth int, spans string, _id int, _spans int, _nth_row int"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x", 1, "x", 1, "x", 1, 1, 1) for r in rows], CLASHING)


def test_op3_sanitise_edges(spark):
    said = [(1, "write to a.b@c.example.org now"), (1, "no address"), (None, "or to x@y.example.org"), (2, None), (3, ""), (1, "no address")]
    df = clashing(spark, said)
    out = pii.sanitise(df)
    assert out.columns == df.columns
    want = [(1, "write to [email] now"), (1, "no address"), (None, "or to [email]"), (2, None), (3, ""), (1, "no address")]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want)
    assert pii.sanitise(df.limit(0)).collect() == []


def test_op1_keep_one_edges(spark):
    words = ["w%d" % i for i in range(300)]
    a, b = " ".join(words), " ".join(reversed(words))
    df = clashing(spark, [(5, a), (4, a), (None, a), (5, b), (5, b), (6, None), (7, ""), (None, "other words of nobody")])
    kept = simhash_dedup.keep_one_per_component(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(4, a), (5, b), (6, None), (None, "other words of nobody")])
    assert simhash_dedup.keep_one_per_component(df.limit(0)).collect() == []
