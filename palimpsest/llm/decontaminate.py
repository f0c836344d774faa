"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Word n-grams of the test items are seeds. One pass over the documents tests every n-gram against a
filter of fixed size made of the seeds, and keeps the neighbourhoods of hits. Every seed joins the
distinct neighbourhoods to items, however many have it: the rarest seed that a pair shares may be a
frequent one, where an edited passage is itself copied often. Each such pair is aligned once, word
by word, unless the words it shares are too few for the threshold; the share of the item's words
that the best local alignment earns is the score, and goes back to all documents with that text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SENT, cut, documents, plain_text, wrapped
from palimpsest.llm.rolling import mix, prefix, spans

#: log2 of the filter's bits: 2 MB, whatever the benchmark's size; false hits fall out in the join.
FILTER_BITS = 24
#: A text of more documents than this is joined back in blocks.
COPIES = 2048
#: Bytes of words: letters, digits and all of other scripts.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_in(text: str) -> list[bytes]:
    return WORDS.findall(text.lower().encode("utf-8", "surrogatepass"))


def _grams(texts: list[str], sizes: list[int]):
    """Of the texts, one after the other: their bytes, the words' starts and ends, each word's text, and (first word, hash, size) of each n-gram of these sizes, by first word."""
    parts = [x.lower().encode("utf-8", "surrogatepass") + b"\n" for x in texts]
    raw = b"".join(parts)
    data = np.frombuffer(raw, np.uint8)
    word = WORD[data]
    edge = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    whose = np.searchsorted(np.cumsum([len(x) for x in parts]), start, side="right")
    h = spans(prefix(data), start, end)
    firsts, grams, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n in sizes:
        if len(h) < n:
            continue
        gram = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            gram = mix(gram * np.uint64(3) + h[k : len(h) - n + 1 + k])
        inside = np.flatnonzero(whose[: len(gram)] == whose[n - 1 :])
        firsts.append(inside)
        grams.append(gram[inside])
        lengths.append(np.full(len(inside), n))
    first, gram, length = (np.concatenate(x) for x in (firsts, grams, lengths))
    if len(sizes) > 1:
        order = np.argsort(first, kind="stable")
        first, gram, length = first[order], gram[order], length[order]
    return raw, start, end, whose, first, gram, length


def seeds(items: DataFrame, n: int) -> DataFrame:
    """(item_id, seed, size) of every n-gram of every item; the seed of an item of fewer words is its whole sequence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            _, _, _, whose, first, gram, length = _grams(pdf["text"].tolist(), list(range(1, n + 1)))
            own = length == np.minimum(n, np.bincount(whose, minlength=len(pdf)))[whose[first]]
            yield pd.DataFrame({"item_id": pdf["item_id"].to_numpy()[whose[first[own]]] if own.any() else np.zeros(0, np.int64), "seed": gram[own].view(np.int64), "size": length[own]})

    return items.mapInPandas(run, "item_id long, seed long, size long").distinct()


def _bits(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << FILTER_BITS) - 1)
    return seed & low, (seed >> np.uint64(32)) & low


def seed_filter(found: DataFrame) -> np.ndarray:
    """A filter of fixed size: each task marks the bits of its seeds; the driver ORs these marks, never seeds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.zeros(1 << FILTER_BITS, bool)
        for pdf in batches:
            for b in _bits(pdf["seed"].to_numpy().view(np.uint64)):
                marks[b] = True
        yield pd.DataFrame({"word": np.flatnonzero(marks) >> 5, "bit": np.int64(1) << (np.flatnonzero(marks) & 31)})

    words = found.select("seed").mapInPandas(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[words["word"]] = words["bits"]
    return out.view(np.uint8)


def neighbourhoods(docs: DataFrame, filters: list[tuple[int, np.ndarray]], sizes: list[int]) -> DataFrame:
    """(doc_id, text, seeds): stretches of a document around n-grams that pass a filter, to both sides as many words as stand beside it; stretches that meet are one."""
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = [(reach, np.unpackbits(x, bitorder="little").astype(bool)) for reach, x in held.value]

        def scan(ids: list, texts: list[str]) -> pd.DataFrame:
            raw, start, end, whose, first, gram, length = _grams(texts, sizes)
            one, two = _bits(gram)
            reach = np.full(len(gram), -1)
            for words, marks in filters:  # the widest last
                reach[marks[one] & marks[two]] = words
            hit = reach >= 0
            first, gram, length, reach = first[hit], gram[hit], length[hit], reach[hit]
            rows = []
            if len(first):
                doc = whose[first]
                lo, hi = np.searchsorted(whose, np.arange(len(texts))), np.searchsorted(whose, np.arange(len(texts)), side="right")
                s, e = np.maximum(first - reach, lo[doc]), np.minimum(first + length + reach, hi[doc])
                order = np.argsort(s, kind="stable")
                s, e, gram, doc = s[order], np.maximum.accumulate(e[order]), gram[order], doc[order]
                apart = np.flatnonzero((s[1:] > e[:-1]) | (doc[1:] != doc[:-1])) + 1
                for a, b in zip(np.r_[0, apart], np.r_[apart, len(s)]):
                    rows.append((ids[doc[a]], raw[start[s[a]] : end[e[b - 1] - 1]].decode("utf-8", "surrogatepass"), np.unique(gram[a:b]).view(np.int64)))
            out = pd.DataFrame(rows, columns=["doc_id", "text", "seeds"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            return out

        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            a, size = 0, 0
            for i, x in enumerate(texts):
                size += len(x)
                if size > 1_000_000 or i + 1 == len(texts):
                    yield scan(ids[a : i + 1], texts[a : i + 1])
                    a, size = i + 1, 0

    return docs.mapInPandas(run, "doc_id long, text string, seeds array<long>")


def align(item: np.ndarray, text: np.ndarray, gap: int = 1) -> tuple[int, int, int]:
    """Smith-Waterman over words (1 a match, -1 a mismatch or gap): the best score and where in the text it ends and begins."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        steps = np.arange(len(b) + 1) * gap
        row, top = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
        for i, w in enumerate(a):
            now = np.zeros(len(b) + 1, np.int64)
            now[1:] = np.maximum(row[:-1] + np.where(b == w, 1, -1), row[1:] - gap)
            row = np.maximum(np.maximum.accumulate(np.maximum(now, 0) + steps) - steps, 0)
            j = int(row.argmax())
            if row[j] > top[0]:
                top = (int(row[j]), i + 1, j)
        return top

    score, i, j = best(item, text)
    if not score:
        return 0, 0, 0
    _, _, back = best(item[:i][::-1], text[:j][::-1])
    return score, j - back, j


def _aligned(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, item, text, passage in zip(pdf["key"], pdf["item_id"], pdf["text"], pdf["item_text"]):
                a, b = words_in(passage), words_in(text)
                code: dict[bytes, int] = {}
                x, y = (np.array([code.setdefault(w, len(code)) for w in ws], np.int64) for ws in (a, b))
                if not a or np.minimum(*(np.bincount(z, minlength=len(code)) for z in (x, y))).sum() < threshold * len(a):
                    continue  # no alignment scores more than the words shared
                score, s, e = align(x, y)
                if score / len(a) >= threshold:
                    rows.append((key, item, score / len(a), b" ".join(b[s:e]).decode("utf-8", "surrogatepass")))
            out = pd.DataFrame(rows, columns=["key", "item_id", "score", "passage"])
            out["item_id"] = out["item_id"].astype("Int64")
            yield out

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, threshold: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, passage): documents that hold an item, whole or edited, with the aligned words.

    score is the alignment's score over the item's number of words, from `threshold` to 1. Every passage
    that shares `n` words in a row with an item is aligned with it; an item under n words is found where its whole
    sequence stands. Null texts and items count as empty and are never found. Repeated documents
    and items each give their pairs (once for a repeated pair of ids, with the best score). Empty tables
    give an empty result; other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = F.length("text") - F.length(F.regexp_replace(F.lower("text"), r"(?<![0-9a-z\x{80}-\x{10ffff}])[0-9a-z\x{80}-\x{10ffff}]", ""))
    longest = items.groupBy("item_id").agg(F.ceil(F.log2(F.greatest(F.max(count), F.lit(1)))).cast("int").alias("class"))
    found = cut(seeds(items, n).join(longest, "item_id"), "seeds")
    told = found.select(F.col("size").alias("size_"), "class").distinct().collect()  # sizes up to n, classes up to the logarithm of the longest item
    sizes = sorted({n, *(r.size_ for r in told)})
    # of a passage over the threshold, the words put in are fewer than the score leaves; each class of lengths has its own reach
    filters = [(math.ceil(2**c * (2 - threshold)), seed_filter(found.filter(F.col("class") == c))) for c in sorted({r["class"] for r in told})]
    found = found.select("item_id", "seed")
    near = cut(neighbourhoods(documents(docs), filters, sizes).withColumn("key", F.sha2("text", 256)), "neighbourhoods")
    texts = near.dropDuplicates(["key"]).select("key", "text", "seeds")
    pairs = texts.select("key", F.explode("seeds").alias("seed")).join(found, "seed").select("key", "item_id").distinct()
    both = pairs.join(texts.select("key", "text"), "key").join(items.select("item_id", F.col("text").alias("item_text")).distinct(), "item_id")
    scored = both.mapInPandas(_aligned(threshold), "key string, item_id long, score double, passage string")
    # a text of many documents is dealt out in blocks
    block = lambda x: F.pmod(F.xxhash64(F.coalesce(x, F.lit(0))), F.col("blocks"))
    sizes_of = near.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / COPIES).alias("blocks"))
    many = sizes_of.filter("blocks > 1")
    holders = near.select("key", "doc_id").join(F.broadcast(many), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    holders = holders.select("key", "doc_id", block(F.col("doc_id")).alias("block"))
    dealt = scored.join(F.broadcast(many), "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    back = holders.join(dealt, ["key", "block"])
    return back.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "passage")).alias("best")).select("doc_id", "item_id", "best.score", "best.passage")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; each row is judged by its own text, whatever its id. All columns are as they were, whatever their names."""
    text = plain_text(docs)
    found = cut(contaminated(docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text")), benchmark, **settings).select(F.col("doc_id").alias("found")).distinct(), "contaminated")
    rows = wrapped(docs, key=F.xxhash64(text))
    return rows.join(F.broadcast(found) if found.count() <= SENT else found, F.col("key") == F.col("found"), "left_anti").select("row.*")
