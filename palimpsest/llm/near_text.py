"""Near-duplicate texts: SimHash candidates from a byte-position inverted index, verified on their word shingles.

Texts alike in a share s of their five-word shingles have fingerprints that differ in a share of
about acos(2s / (1 + s)) / pi of their bits: 15 % at s = 0.8. A fingerprint has 32 positional
bytes, of which such texts share nine on average. The index is keyed by the bytes at three positions
together, over TRIPLES triples spread evenly over the positions: a posting of N texts over 2^24
values stays short. The shared positional bytes of texts that meet in a posting are tallied; pairs
with at least MINIMUM and at most `radius` differing bits are candidates, and candidates are verified on
their shingles: first the nearest ones that connect each posting (a spanning forest by distance), then
every other one whose texts the verified links do not connect yet. No candidate is left out that could
join two groups; pairs inside a group are not written.

A text can only be alike to another if most of its shingles stand elsewhere too: all shingles of a
short text, a sample of a longer one's, chosen by their hash, are counted over all texts, and texts
of which these are mostly their own aren't indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import batches_of, cut, held, meet, plain_text, remove, sent, wrapped
from palimpsest.llm.components import connected_components
from palimpsest.llm.rolling import mix, prefix, spans

WORDS = ["w0", "w1", "w2", "w3"]
POSITIONS, TRIPLES, MINIMUM = 32, 500, 3
#: Bits of 256 that candidates differ in at most: five standard deviations above the mean at similarity 0.8, as many below that of strangers.
RADIUS = 68
#: (shingles of a text, one in how many is counted): all of short texts, a sample of longer ones; and the least sample that decides.
SAMPLES, ENOUGH = [(48, 1), (192, 4), (math.inf, 16)], 8
#: Partners differ in length by a quarter at most: a text's shingles are told at the rate of texts shorter by more than that.
LONGER = 1.5
#: Candidate pairs that a task gathers before it hands them on.
ROWS = 100_000
#: A posting of more texts than this is dealt out as pairs of blocks.
POSTING = 1024
LANES = np.uint64(0x0001000100010001)
CHUNK = 1 << 15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
KEY = ["k1", "k2"]


def triples(count: int = TRIPLES) -> list[tuple[int, int, int]]:
    """`count` of the triples of positions, each pair of positions in about as many of them as any other."""
    used: dict[tuple[int, int], int] = {}
    left, out = list(combinations(range(POSITIONS), 3)), []
    for _ in range(count):
        best = min(left, key=lambda t: (sum(used.get(p, 0) ** 2 for p in combinations(t, 2)), (t[0] * 7 + t[1] * 5 + t[2] * 3) % 31, t))
        left.remove(best)
        out.append(best)
        for p in combinations(best, 2):
            used[p] = used.get(p, 0) + 1
    return out


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every shingle of `words` words, repeats included, by text; a text of fewer words has one shingle of all of them, a text without words none."""
    parts = [x.encode("utf-8", "surrogatepass").lower() + b" " for x in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[False, ~SPACE[data], False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    whose = np.searchsorted(np.cumsum([len(x) for x in parts]), start, side="right")
    h = spans(prefix(data), start, end)
    count = np.bincount(whose, minlength=len(texts))
    first = np.cumsum(count) - count
    gram = np.zeros(len(h), np.uint64)
    left = count[whose] - (np.arange(len(h)) - first[whose])  # words from here to the text's end
    for k in range(words):
        more = np.flatnonzero(left > k)
        gram[more] = mix(gram[more] * np.uint64(3) + h[more + k])
    keep = (left >= words) | ((count[whose] < words) & (left == count[whose]))
    return gram[keep], whose[keep]


def votes(gram: np.ndarray, whose: np.ndarray, n: int) -> np.ndarray:
    """The 256-bit fingerprint of each of n texts, as four columns: bits set in over half of a text's shingles. Bits are counted four to a number, in stretches that can't overflow."""
    out = np.zeros((n, 4), np.uint64)
    total = np.bincount(whose, minlength=n)
    for part_of in range(4):
        x = mix(gram + np.uint64(0x9E3779B97F4A7C15 * (part_of + 1) % 2**64))
        count = np.zeros((n, 64), np.int64)
        for a in range(0, len(x), CHUNK):
            part, doc = x[a : a + CHUNK], whose[a : a + CHUNK]
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            for b in range(16):
                lanes = np.add.reduceat((part >> np.uint64(b)) & LANES, starts)
                for lane in range(4):
                    count[doc[starts], b + 16 * lane] += ((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64)
        out[:, part_of] = ((2 * count > total[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def in_groups(texts: list[str], size: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` characters together."""
    a = n = 0
    for i, x in enumerate(texts):
        n += len(x)
        if n > size or i + 1 == len(texts):
            yield a, i + 1
            a, n = i + 1, 0


def fingerprints(rows: DataFrame, words: int) -> DataFrame:
    """rows (with a column text) with w0 to w3 in its place, n, the number of its distinct shingles, and sample: those of them that are told."""
    names = [c for c in rows.columns if c != "text"]

    @F.pandas_udf("w0 long, w1 long, w2 long, w3 long, n int, sample array<long>")
    def fp(texts: pd.Series) -> pd.DataFrame:
        every, found, sizes, told = texts.tolist(), [np.zeros((0, 4), np.uint64)], [], []
        for a, b in in_groups(every):
            gram, whose = shingles(every[a:b], words)
            found.append(votes(gram, whose, b - a))
            at = np.searchsorted(whose, np.arange(b - a + 1))
            for i in range(b - a):
                own = np.unique(gram[at[i] : at[i + 1]])
                rate = next(r for most, r in SAMPLES if len(own) < LONGER * most)
                sizes.append(len(own))
                told.append(own[own % np.uint64(rate) == 0].view(np.int64))
        both = np.concatenate(found).view(np.int64)
        return pd.DataFrame({w: both[:, i].copy() for i, w in enumerate(WORDS)} | {"n": sizes, "sample": told})

    return rows.select(*names, fp("text").alias("fp")).select(*names, *[f"fp.{w}" for w in WORDS], "fp.n", "fp.sample")


def with_company(nodes: DataFrame) -> DataFrame:
    """(k1, w0 to w3) of the distinct texts that may have a partner: those of which at least half of the counted shingles stand in another text, those of too small a sample, and those without words."""
    rate = F.when(F.col("n") < SAMPLES[0][0], SAMPLES[0][1]).when(F.col("n") < SAMPLES[1][0], SAMPLES[1][1]).otherwise(SAMPLES[2][1])
    asked = nodes.withColumn("asked", F.filter("sample", lambda h: h.bitwiseAND((rate - 1).cast("long")) == 0))
    open_ = (F.col("n") == 0) | ((F.col("n") >= SAMPLES[0][0]) & (F.size("asked") < ENOUGH))
    said = asked.filter(~open_).select("k1", F.size("asked").alias("size"), F.explode("asked").alias("h"))
    often = cut(nodes.select(F.explode("sample").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1"), "shared-shingles")
    shared = meet(said, often.select("h"), ["h"], F.xxhash64("k1", F.lit(3)), often).groupBy("k1").agg(F.count(F.lit(1)).alias("shared"), F.first("size").alias("size")).filter("2 * shared >= size").select("k1")
    return asked.filter(open_).select("k1", *WORDS).unionByName(asked.filter(~open_).join(shared, "k1", "left_semi").select("k1", *WORDS))


def _tally(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(differing bits, shared positional bytes) of rows of four XORed words."""
    return np.bitwise_count(x).sum(axis=1, dtype=np.int32), (x.view(np.uint8).reshape(len(x), POSITIONS) == 0).sum(axis=1)


def _near(fp: np.ndarray, side: np.ndarray | None, radius: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(differing bits, candidate or not) of text i and each text of one posting (side None) or of one pair of blocks (side: which of the two)."""
    differ, shared = _tally(fp ^ fp[i])
    ok = (differ <= radius) & (shared >= MINIMUM)
    if side is not None:
        ok &= side != side[i]
    ok[i] = False
    return differ, ok


def nearest_forest(fp: np.ndarray, side: np.ndarray | None, radius: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of a spanning forest of the candidates by distance, of all their groups; and which texts have candidates beyond these links."""
    n = len(fp)
    big = np.iinfo(np.int32).max
    near, at = np.full(n, big, np.int64), np.zeros(n, np.int64)
    done, out, beyond, i = np.zeros(n, bool), [], np.zeros(n, np.int64), 0
    for _ in range(n):
        done[i] = True
        differ, ok = _near(fp, side, radius, i)
        beyond[i] += ok.sum()
        closer = ok & ~done & (differ < near)
        near[closer], at[closer] = differ[closer], i
        i = int(np.where(done, big + 1, near).argmin())  # a text out of reach begins the next group
        if not done[i] and near[i] < big:
            out.append((int(at[i]), i))
            beyond[[at[i], i]] -= 1
    return out, beyond > 0


def apart(fp: np.ndarray, side: np.ndarray | None, group: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each text and its candidates behind it that are of another group."""
    if (group == group[0]).all():
        return
    for i in range(len(fp) - 1):
        ok = _near(fp, side, radius, i)[1] & (group != group[i])
        if ok[i + 1 :].any():
            yield i, i + 1 + np.flatnonzero(ok[i + 1 :])


def _candidates(radius: int, grouped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []

        def rows(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
            x, y = np.concatenate(a), np.concatenate(b)
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        def solve(cell, side, k1, group, *parts) -> Iterator[pa.RecordBatch]:
            fp = np.ascontiguousarray(np.stack(parts, axis=1))
            ends = np.flatnonzero(np.r_[cell[1:] != cell[:-1], True]) + 1
            starts = np.r_[0, ends[:-1]]
            size = ends - starts
            two = starts[size == 2]
            differ, shared = _tally(fp[two] ^ fp[two + 1])
            ok = (shared >= MINIMUM) & (differ <= radius) & ((side[two] < 0) | (side[two] != side[two + 1]))
            if grouped:
                ok &= group[two] != group[two + 1]
            a, b, made = [k1[two[ok]]], [k1[two[ok] + 1]], 0
            for s, e in zip(starts[size > 2], ends[size > 2]):
                of = None if side[s] < 0 else side[s:e]
                if grouped:
                    for i, others in apart(fp[s:e], of, group[s:e], radius):
                        a.append(np.full(len(others), k1[s + i]))
                        b.append(k1[s + others])
                        made += len(others)
                        if made > ROWS:
                            yield rows(a, b)
                            made = 0
                else:
                    links, beyond = nearest_forest(fp[s:e], of, radius)
                    links = np.array(links, np.int64).reshape(-1, 2)
                    a += [k1[s + links[:, 0]], k1[s:e][beyond]]
                    b += [k1[s + links[:, 1]], k1[s:e][beyond]]
            if a:
                yield rows(a, b)

        for batch in batches:
            new = tuple(batch[c].to_numpy() for c in ("cell", "side", "k1", "group" if grouped else "k1")) + tuple(batch[c].to_numpy().view(np.uint64) for c in WORDS)
            kept.append(new)
            if len(new[0]) == 0 or kept[0][0][0] == new[0][-1]:
                continue  # one cell so far; it is bounded
            all_of = tuple(np.concatenate(x) for x in zip(*kept))
            last = int(np.searchsorted(all_of[0], all_of[0][-1]))
            yield from solve(*(x[:last] for x in all_of))
            kept = [tuple(x[last:] for x in all_of)]
        if kept and sum(len(x[0]) for x in kept):
            yield from solve(*(np.concatenate(x) for x in zip(*kept)))

    return run


def met(prints: DataFrame, radius: int = RADIUS, posting: int = POSTING) -> DataFrame:
    """Of the distinct texts k1 with fingerprints w0 to w3: candidate pairs (a, b), a < b, that connect the candidates of each posting, and (k1, k1) for each text with candidates beyond these; where prints has a column group, all candidate pairs of different groups instead."""
    grouped = "group" in prints.columns
    names = ["k1", *(["group"] if grouped else []), *WORDS]
    # each triple as one number: its place, then its three positions
    chosen = F.array(*[F.lit(i << 24 | a << 16 | b << 8 | c).cast("long") for i, (a, b, c) in enumerate(triples())])
    word = lambda n: f"case (triple >> {n} & 255) div 8 when 0 then w0 when 1 then w1 when 2 then w2 else w3 end"
    byte = lambda n: F.expr(f"shiftrightunsigned({word(n)}, cast(56 - 8 * (triple >> {n} & 7) as int)) & 255")
    key = F.expr("triple >> 24 << 24") + byte(16) * 65536 + byte(8) * 256 + byte(0)
    index = prints.select(*names, F.explode(chosen).alias("triple")).select(*names, key.alias("key"))
    # only hot postings meet their sizes; each holds over `posting` of the index's rows
    hot = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > posting).select("key", F.ceil(F.col("n") / posting).alias("blocks"))
    sized = index.join(sent(cut(hot, "hot-postings")), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = sized.select(*names, "key", "blocks", F.pmod(F.xxhash64("k1", F.lit(7)), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    pair = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") > F.col("other")).cast("int"))
    cell = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", pair))
    cells = own.select(cell.alias("cell"), side.alias("side"), *names).repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(_candidates(radius, grouped), "a long, b long").distinct()


def candidates(prints: DataFrame, radius: int = RADIUS, posting: int = POSTING) -> DataFrame:
    """(a, b), a < b: candidate pairs that connect the distinct texts k1 with fingerprints w0 to w3."""
    return met(prints, radius, posting).filter("a < b")


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles, given as sorted distinct hashes; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def shingle_sets(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(k1, set): the distinct shingles of the texts (k1, text) that stand in pairs (a, b)."""
    asked = cut(pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct(), "asked")
    mine = texts.join(sent(asked), "k1", "left_semi").dropDuplicates(["k1"])

    @F.pandas_udf("binary")
    def sets(batch: pd.Series) -> pd.Series:
        out, held_texts = [], batch.tolist()
        for a, b in in_groups(held_texts):
            gram, whose = shingles(held_texts[a:b], words)
            at = np.searchsorted(whose, np.arange(b - a + 1))
            # 32 bits tell the shingles of two texts apart but for one in a million
            out += [np.unique((gram[at[i] : at[i + 1]] >> np.uint64(32)).astype(np.uint32)).tobytes() for i in range(b - a)]
        return pd.Series(out)

    return mine.select("k1", sets("text").alias("set"))


def verified(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingles (k1, set) have `similarity` or more. known holds a row for each k1 of pairs; both are read from files."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([alike(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)) >= similarity for p, q in zip(x, y)], dtype=bool)

    # the middle of a star of candidates has a pair for each of them
    left = meet(pairs, known.select(F.col("k1").alias("a"), F.col("set").alias("x")), ["a"])
    return meet(left, known.select(F.col("k1").alias("b"), F.col("set").alias("y")), ["b"], F.xxhash64("a", F.lit(3))).filter(near("x", "y")).select("a", "b")


def near_duplicate_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, k1, k2, rows, kept): the distinct rows (id and text) of docs, how often each stands there, and whether it is kept.

    One row of each group is kept: that of the least id (null ids last, ties by the text's hash). A
    group is what chains of texts of `similarity` or more connect. k1 and k2 stand for the text, null as empty.
    """
    text = plain_text(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), text.alias("text"))
    spark = docs.sparkSession
    with batches_of(spark, 1000):
        prints, prints_at = held(fingerprints(rows, words), "fingerprints")
    nodes, nodes_at = held(with_company(prints.select("k1", *WORDS, "n", "sample").dropDuplicates(["k1"])), "nodes")
    first, first_at = held(met(nodes), "candidates")
    tested, beyond = first.filter("a < b"), first.filter("a = b").select(F.col("a").alias("k1"))
    with batches_of(spark, 250):
        known, known_at = held(shingle_sets(tested, rows.select("k1", "text"), words), "sets")
        links = cut(verified(tested, known, similarity), "links")
    parts = connected_components(links, "a", "b")
    if not beyond.isEmpty():
        # every text with a candidate beyond the forests has a link in one, so its set is known
        group = parts.select(F.col("node").alias("k1"), F.col("component").alias("group"))
        again, again_at = held(nodes.join(sent(beyond), "k1", "left_semi").join(group, "k1", "left").withColumn("group", F.coalesce("group", "k1")), "ungrouped")
        rest, rest_at = held(met(again).join(tested, ["a", "b"], "left_anti"), "candidates")
        with batches_of(spark, 250):
            more = cut(verified(rest, known, similarity), "links")
        if not more.isEmpty():
            parts = connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")
        remove(spark, again_at, rest_at)
    small = prints.groupBy("doc_id", *KEY).agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)
    # the best row of each text first, so that a text of many rows meets its group once
    texts = small.groupBy("k1").agg(F.min(order).alias("best"))
    named = texts.join(parts.withColumnRenamed("node", "k1"), "k1", "left").withColumn("group", F.coalesce("component", "k1"))
    best = named.groupBy("group").agg(F.min("best").alias("best")).select("best.*")
    told = small.join(best.select("doc_id", *KEY, F.lit(True).alias("kept")).withColumnsRenamed({c: f"b_{c}" for c in ("doc_id", *KEY)}), (F.col("k1") == F.col("b_k1")) & (F.col("k2") == F.col("b_k2")) & F.col("doc_id").eqNullSafe(F.col("b_doc_id")), "left")
    out = cut(told.select("doc_id", *KEY, "rows", F.coalesce("kept", F.lit(False)).alias("kept")), "kept-rows")
    remove(spark, prints_at, nodes_at, first_at, known_at)
    return out


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicate texts, as near_duplicate_rows tells; all columns as they were.

    Rows are told apart by id and text: rows that share an id but not a text are judged each by its
    own text, rows with a null id like any other. Null and empty texts are one group. An empty table
    gives an empty result; no name of the caller's columns clashes.
    """
    told = near_duplicate_rows(docs, words, similarity).withColumnsRenamed({c: f"t_{c}" for c in ("doc_id", *KEY)})
    text = plain_text(docs)
    rows = wrapped(docs, id=docs["doc_id"].cast("long"), k1=F.xxhash64(text), k2=F.xxhash64(text, F.lit(1)))
    same = (F.col("k1") == F.col("t_k1")) & (F.col("k2") == F.col("t_k2")) & F.col("id").eqNullSafe(F.col("t_doc_id"))
    single = rows.join(sent(told.filter("NOT kept OR rows > 1")), same, "left_anti").select("row")
    again = told.filter("kept AND rows > 1")
    if again.isEmpty():
        return single.select("row.*")
    first = rows.join(sent(again), same, "left_semi").dropDuplicates(["id", *KEY]).select("row")
    return single.unionByName(first).select("row.*")
