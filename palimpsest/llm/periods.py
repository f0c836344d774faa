"""Periodic runs of words by string synchronising sets.

At each dyadic scale s a text's positions are thinned to a locally consistent set: a position belongs
to it if the least hashed name among the windows of s words that start in the next s + 1 places is
that of the first or of the last. Membership depends on the 2s words from there alone, so inside a
run of period q (s <= q < 2s) members return every q words with equal context, and the distance
of neighbours of equal context proposes q. Windows that repeat at a fourth of s or less take no part;
their regions are the runs found at smaller scales, and periods below the first scale are
read off by direct comparison. Every proposal is confirmed word by word.

Names of windows are exact (pairs of names of half the length, numbered), not hashes. All documents of a
batch are scanned together; positions that can't lie in a run of a scale's periods or longer ones leave early.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import documents
from palimpsest.llm.rolling import mix, prefix, spans

#: The first scale; smaller periods are compared directly. A run has at least LEAST words and TIMES periods.
FIRST, LEAST, TIMES = 8, 6, 4
#: Documents of so many bytes are scanned together; a longer one is scanned alone.
TOGETHER = 4_000_000
TAKES_NO_PART = np.uint64(2**64 - 1)
RESULT = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def stretches(true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal stretches of true places."""
    at = np.flatnonzero(true)
    if not len(at):
        return at, at
    gap = np.flatnonzero(np.diff(at) > 1)
    return at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])] + 1


def laid_out(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the intervals one after another, and the interval that each belongs to."""
    size = end - start
    which = np.repeat(np.arange(len(start)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[which], which


def paired(name: np.ndarray, segment: np.ndarray, width: int) -> np.ndarray:
    """Names of the windows twice as wide as `width`; -1 where a segment ends before."""
    out = np.full(len(name), -1)
    if len(name) > width:
        left, right = name[:-width], name[width:]
        ok = np.flatnonzero((segment[:-width] == segment[width:]) & (left >= 0) & (right >= 0))
        if len(ok):
            out[ok] = np.unique(left[ok] * (name.max() + 1) + right[ok], return_inverse=True)[1]
    return out


def around(codes: np.ndarray, x: int, p: int) -> tuple[int, int]:
    """The maximal stretch [s, e) about x of places whose word equals the one p further."""
    n, e, s, step = len(codes) - p, x, x, 64
    while e < n:
        to = min(e + step, n)
        other = np.flatnonzero(codes[e:to] != codes[e + p : to + p])
        if len(other):
            e += int(other[0])
            break
        e, step = to, 2 * step
    step = 64
    while s > 0:
        to = max(s - step, 0)
        other = np.flatnonzero(codes[to:s] != codes[to + p : s + p])
        if len(other):
            s = to + int(other[-1]) + 1
            break
        s, step = to, 2 * step
    return s, e


def may_repeat(codes: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """True where the window of `width` words stands more than once in its document (by hash: true for every such window)."""
    out = np.zeros(len(codes), bool)
    if len(codes) > width:
        n = len(codes) - width + 1
        at = np.arange(n)
        key = spans(prefix(codes), at, at + width) ^ mix(doc[:n].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def runs_of(codes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by start and period.

    codes: the words' numbers, documents one after another, each followed by a number of its own that
    no run can hold. doc: the document of each place.
    """
    found: dict[tuple[int, int], int] = {}  # a stretch keeps its smallest period: a larger one is a multiple
    for p in range(1, min(FIRST, len(codes))):
        s, e = stretches(codes[:-p] == codes[p:])
        ok = e - s >= max(LEAST, TIMES * p) - p
        for x, y in zip(s[ok].tolist(), (e[ok] + p).tolist()):
            found.setdefault((x, y), p)
    scale = FIRST
    # a run of period q >= scale is a stretch of repeated windows
    s, e = stretches(may_repeat(codes, doc, scale))
    ok = e - s > 3 * scale
    at, segment = laid_out(s[ok], e[ok] + scale - 1)
    name = np.unique(doc[at] * (codes.max(initial=0) + 1) + codes[at], return_inverse=True)[1] if len(at) else at
    for width in (1, 2, 4):
        name = paired(name, segment, width)
    while len(at):
        often = np.bincount(name[name >= 0])
        s, e = stretches((name >= 0) & (often[name] > 1))
        ok = e - s > 3 * scale
        if not ok.any():
            break
        picked, segment = laid_out(s[ok], e[ok] + scale - 1)
        at, name = at[picked], np.where(picked < e[ok][segment], name[picked], -1)
        twice = paired(name, segment, scale)
        key = mix(name.astype(np.uint64)) >> np.uint64(1)
        small = [(x, y) for (x, y), p in found.items() if 4 * p <= scale <= y - x]
        if small:
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, [x for x, _ in small], 1)
            np.add.at(change, [y - scale + 1 for _, y in small], -1)
            key[np.cumsum(change)[at] > 0] = TAKES_NO_PART
        least, width = key.copy(), 1
        while width < scale:
            least[:-width] = np.minimum(least[:-width], least[width:])
            width *= 2
        i = np.flatnonzero(twice >= 0)
        least = np.minimum(least[i], key[i + scale])
        i = i[(least < TAKES_NO_PART) & ((least == key[i]) | (least == key[i + scale]))]
        i = i[np.lexsort((at[i], twice[i]))]
        apart = at[i[1:]] - at[i[:-1]]
        ok = (twice[i[1:]] == twice[i[:-1]]) & (apart >= scale) & (apart < 2 * scale)
        last, until = 0, 0
        for p, x in sorted(zip(apart[ok].tolist(), at[i[:-1]][ok].tolist())):
            if p == last and x < until:
                continue
            s, e = around(codes, x, p)
            last, until = p, max(e, x + 1)
            if e - s >= (TIMES - 1) * p:
                found.setdefault((s, e + p), p)
        name, scale = twice, 2 * scale
    return sorted((x, y - x, p) for (x, y), p in found.items())


def _scan(ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
    words = [x.split() for x in texts]  # bytes are split at ASCII white space alone
    size = np.array([len(x) + 1 for x in words])
    end = np.cumsum(size)
    start = end - size
    codes = np.zeros(int(end[-1]), np.int64)
    told = np.ones(len(codes), bool)
    told[end - 1] = False
    flat = np.empty(int(told.sum()), object)
    flat[:] = [w for x in words for w in x]
    codes[told], known = pd.factorize(flat)
    codes[end - 1] = len(known) + np.arange(len(words))
    doc = np.repeat(np.arange(len(words)), size)
    runs = np.array(runs_of(codes, doc), np.int64).reshape(-1, 3)
    of = np.searchsorted(start, runs[:, 0], side="right") - 1
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(change)[:-1] > 0
    held = np.bincount(of, minlength=len(words))
    collapsed = [b" ".join(x) if not held[k] else b" ".join([x[i] for i in np.flatnonzero(~dropped[start[k] : end[k] - 1])]) for k, x in enumerate(words)]
    parts = pa.StructArray.from_arrays([pa.array(runs[:, 0] - start[of]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32()), parts)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        began, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= TOGETHER or i + 1 == len(texts):
                yield _scan(ids[began : i + 1], texts[began : i + 1])
                began, held = i + 1, 0


def period_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) for every row of docs.

    runs: the stretches of words (between ASCII white space) whose smallest period q stands in them four
    times or more, six words at least, and which no neighbouring word extends; by start, then period.
    collapsed: the words but those that a run holds after its first q words, joined by one space.
    A null text is empty and has no run; a null id stays null; repeated rows give repeated results and
    an empty table an empty result. Columns other than doc_id and text are not read. Documents are scanned
    whole and apart from each other; nothing is shuffled, and a task holds some 4 MB of texts or one document.
    """
    return documents(docs).mapInArrow(_scanned, RESULT)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one document of ten (by crc32 of its id) the words from a place on repeat those that stand there first.

    h is the checksum and g a tenth of it; the place is a = g mod n of n words, the period
    1 + floor((n - a) / (3 + g mod 8)). Rows without an id or without words are as they were.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(row: Column) -> Column:
        w, g = row["w"], row["g"]
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))

    rows = documents(docs).withColumn("h", h)
    picked = (F.col("h") % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    planted = F.transform(F.array(F.struct(words.alias("w"), F.floor(F.col("h") / 10).cast("long").alias("g"))), repeated)[0]
    return rows.select("doc_id", F.when(picked, planted).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, the longest run, digests) from what period_runs tells of docs; the longest run is null where there is none."""
    best = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    found = period_runs(docs).select("doc_id", "runs", "collapsed", F.get(best, F.lit(0)).alias("b"))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))))
    length, period = -F.col("b.l"), F.col("b.p")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.s").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
