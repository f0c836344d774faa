"""Exact removal of long repeated strings.

The named method merges the shards' Burrows-Wheeler transforms by refining their interleave one
symbol at a time, until blocks of suffixes with a common prefix of the wanted length remain. One
pass over all suffixes for each of 400 symbols is beyond any budget here (README gives figures), so
the refinement keeps the idea but not the step: intervals of suffixes (here: windows of 400 bytes)
are merged over all shards by what they share, those that occur once are dropped, and the rest is
refined, at three lengths instead of 400.

1. Anchors: the least hash of a 32-byte string in each window. Equal windows have equal anchors at
   equal offsets. Anchors whose string occurs once in the corpus end here.
2. Blocks: the windows around an anchor, 32 offsets together. Their union (outer string) repeated
   elsewhere: all are repeated. Their intersection (inner string) occurring once: none is.
3. Windows: for blocks that share an inner string with a block that is still open, each window.

Every decision is a global count of a hash, pre-aggregated before it is shuffled, so a hot passage
or a group of copies is never gathered in one place. The filters between the passes have a bounded
size; what they let through wrongly is decided by the counts. Strings are compared by 64-bit hashes.

The same passes look at two units at once: bytes, whose repeated windows are removed, and words,
whose repeated windows are reported as passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, documents, held, meet, remove
from palimpsest.llm.rolling import INVERSE, mix, powers, prefix, spans

#: log2 of a filter's bits: enough for 16 bits a key, within these bounds.
FILTER_BITS = (24, 27)
#: Words of a filter that are put together and sent as one row.
PART = 1 << 8
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SEGMENT = 1 << 22
#: Bytes of short texts that are scanned together, and rows that a pass gathers before it hands them on.
TOGETHER, ROWS = 1 << 16, 50_000
IDENTITY = "high long, low long, text string"


@dataclass(frozen=True)
class Unit:
    """What windows are made of: `length` symbols each, anchored at a gram of `gram`, decided in blocks of `block` windows."""

    number: int
    length: int
    gram: int
    block: int

    def symbols(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts end to end, and how many each text has: its bytes, or hashes of its words."""
        data = np.frombuffer(b"".join(raw), np.uint8)
        if self.number == 0:
            return data, np.array([len(x) for x in raw])
        parted = np.insert(~SPACE[data], np.cumsum([len(x) for x in raw]), False)  # no word runs from one text into the next
        edge = np.flatnonzero(np.diff(np.r_[False, parted].astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        whose = np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), start, side="right")
        return spans(prefix(data), start - whose, end - whose), np.bincount(whose, minlength=len(raw))


def identified(rows: DataFrame) -> DataFrame:
    """rows with high and low: 128 bits that stand for the text."""
    return rows.withColumns({"high": F.xxhash64("text"), "low": F.shiftleft(F.hash("text").cast("long"), 32).bitwiseOR(F.crc32(F.col("text").cast("binary")))})


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by running minima of blocks from both ends."""
    n = len(x) - width + 1
    rows = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(x)] = x
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(sums: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): the windows from start `first` to `last` have their anchor there."""
    found = []
    windows = len(sums) - length
    back = powers(INVERSE, len(sums))
    for a in range(0, windows, SEGMENT):
        n = min(SEGMENT, windows - a)
        size = n + length - gram
        h = sums[a + gram : a + gram + size] - sums[a : a + size]
        h *= back[a : a + size]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h &= np.uint64(0xFFFFFFFFFF000000)
        h |= np.arange(size, dtype=np.uint64)
        low = _least(h, length - gram + 1) & np.uint64(0xFFFFFF)
        new = np.flatnonzero(low[1:] != low[:-1]) + 1
        found.append((np.r_[low[:1], low[new]].astype(np.int64) + a, np.r_[0, new] + a, np.r_[new, n] - 1 + a))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _salted(h: np.ndarray, *more: np.ndarray) -> np.ndarray:
    for x in more:
        h = mix(h * np.uint64(3) + np.asarray(x).astype(np.uint64))
    return h.view(np.int64)


def _bits(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    x, low = x.view(np.uint64), np.uint64((1 << size) - 1)
    return x & low, (x >> np.uint64(36)) & low


def _filter(keys: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """(log2 of its bits, words): a filter of bounded size over a column of hashes, built by the tasks. Its parts are put together by tasks as well, so the driver gets the bits alone, 16 MB at most."""
    keys, path = held(keys.select(column), "filter-keys")
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * keys.count()).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.zeros(1 << size, bool)
        for pdf in batches:
            for b in _bits(pdf[column].to_numpy(), size):
                marks[b] = True
        words = np.packbits(marks, bitorder="little").view("<u4")
        at = np.flatnonzero(words)
        yield pd.DataFrame({"part": at // PART, "word": at % PART, "bit": words[at].astype(np.int64)})

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[int, np.ndarray] = {}
        for pdf in batches:
            part, word, bit = (pdf[c].to_numpy() for c in ("part", "word", "bit"))
            for p in np.unique(part).tolist():
                np.bitwise_or.at(parts.setdefault(p, np.zeros(PART, "<u4")), word[part == p], bit[part == p].astype("<u4"))
        yield pd.DataFrame({"part": np.array(list(parts), np.int64), "bits": [x.tobytes() for x in parts.values()]})

    parts = keys.mapInPandas(run, "part long, word int, bit long").repartition("part").mapInPandas(together, "part long, bits binary").toArrow()
    remove(keys.sparkSession, path)
    out = np.zeros(((1 << (size - 5)) // PART, PART), np.uint32)
    for batch in parts.to_batches():
        for p, bits in zip(batch["part"].to_pylist(), batch["bits"]):
            out[p] = np.frombuffer(bits.as_buffer(), "<u4")
    return size, out.ravel()


def _passes(marks: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    one, two = _bits(keys, marks[0])
    hit = lambda b: (marks[1][b >> np.uint64(5)] >> (b & np.uint64(31)).astype(np.uint32)) & np.uint32(1)
    return (hit(one) & hit(two)).astype(bool)


class Texts:
    """Some texts end to end: bytes, identities, prefix sums and the anchors of their windows; a window never runs from one text into the next."""

    def __init__(self, raw: list[bytes], high: list[int], low: list[int], unit: Unit):
        self.unit, self.length = unit, unit.length
        data, size = unit.symbols(raw)
        self.start = np.cumsum(size) - size
        self.high, self.low = np.array(high, np.int64), np.array(low, np.int64)
        self.sums = prefix(data)
        at, first, last = anchors(self.sums, self.length, unit.gram)
        end = self.start + size - self.length  # the last window of each text
        one, two = (np.searchsorted(self.start, x, side="right") - 1 for x in (first, last))
        parts = []
        for d, keep in ((one, slice(None)), (two, two != one)):
            f, t = np.maximum(first, self.start[d])[keep], np.minimum(last, end[d])[keep]
            ok = f <= t
            parts.append((at[keep][ok], f[ok], t[ok], d[keep][ok]))
        self.at, self.first, self.last, self.doc = (np.concatenate(x) for x in zip(*parts))
        self.gram = _salted(spans(self.sums, self.at, self.at + unit.gram), unit.number)

    def only(self, ok: np.ndarray) -> bool:
        self.at, self.first, self.last, self.doc, self.gram = (x[ok] for x in (self.at, self.first, self.last, self.doc, self.gram))
        return len(self.at) > 0

    def occurrence(self, doc: np.ndarray, at: np.ndarray, *more: np.ndarray) -> np.ndarray:
        return _salted(mix(self.high.view(np.uint64)[doc] ^ (self.low.view(np.uint64)[doc] * np.uint64(3))), at - self.start[doc], self.unit.number, *more)

    def named(self, doc: np.ndarray, **columns: np.ndarray) -> dict[str, np.ndarray]:
        return {"high": self.high[doc], "low": self.low[doc], "unit": np.full(len(doc), self.unit.number, np.int32), **columns}

    def blocks(self):
        """(doc, first, last, inner, outer, occurrence) of canonical blocks of `block` offsets of an anchor in its window, met with the windows that the anchor serves."""
        block, number_of = self.unit.block, self.unit.number
        far, near = self.at - self.first, self.at - self.last
        count = far // block - near // block + 1
        who = np.repeat(np.arange(len(self.at)), count)
        number = near[who] // block + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        p, doc = self.at[who], self.doc[who]
        last, first = p - np.maximum(near[who], number * block), p - np.minimum(far[who], number * block + block - 1)
        start = p - number * block
        inner = _salted(spans(self.sums, start, start - block + 1 + self.length), number, number_of)
        outer = _salted(spans(self.sums, first, last + self.length), p - first, p - last, number_of)
        return doc, first, last, inner, outer, self.occurrence(doc, p, number)


def _each(units: list[Unit], rows: Callable[[Texts], dict[str, np.ndarray] | None], columns: dict[str, str]):
    """A pass over texts, for each unit; a text that a task has already seen adds nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        held: list[dict[str, np.ndarray]] = []
        wait: tuple[list[bytes], list[int], list[int]] = ([], [], [])
        size = made = 0

        def scan():
            nonlocal made, size
            for unit in units:
                found = rows(Texts(*wait, unit))
                if found is not None:
                    held.append(found)
                    made += len(found["occ"])
            for x in wait:
                x.clear()
            size = 0

        def out() -> pd.DataFrame:
            done = pd.DataFrame({k: np.concatenate([h[k] for h in held]) for k in columns})
            held.clear()
            return done

        for pdf in batches:
            for text, high, low in zip(pdf["text"], pdf["high"].tolist(), pdf["low"].tolist()):
                if (high, low) in seen:
                    continue
                seen.add((high, low))
                for x, value in zip(wait, (text.encode("utf-8", "surrogatepass"), high, low)):
                    x.append(value)
                size += len(wait[0][-1])
                if size >= TOGETHER:
                    scan()
                    if made > ROWS:
                        yield out()
                        made = 0
        if wait[0]:
            scan()
        if held:
            yield out()

    return run, ", ".join(f"{k} {v}" for k, v in columns.items())


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """The keys with two different occurrences; repeats of one occurrence count once."""
    return rows.groupBy(key).agg(F.min("occ").alias("a"), F.max("occ").alias("b")).filter("a <> b").select(key)


def repeated_windows(texts: DataFrame, units: list[Unit]) -> tuple[DataFrame, list[str]]:
    """(high, low, unit, first, last): runs of starts of repeated windows, by text identity; and the scratch paths that they are read from. texts has the columns of IDENTITY."""
    spark = texts.sparkSession

    def grams(t: Texts):
        return {"gram": t.gram, "occ": t.occurrence(t.doc, t.at)}

    fn, schema = _each(units, grams, {"gram": "long", "occ": "long"})
    known = spark.sparkContext.broadcast(_filter(_repeated(texts.mapInPandas(fn, schema), "gram"), "gram"))

    def blocks(t: Texts):
        if not t.only(_passes(known.value, t.gram)):
            return None
        doc, first, last, inner, outer, occ = t.blocks()
        return t.named(doc, first=(first - t.start[doc]).astype(np.int32), last=(last - t.start[doc]).astype(np.int32), inner=inner, outer=outer, occ=occ)

    fn, schema = _each(units, blocks, {"high": "long", "low": "long", "unit": "int", "first": "int", "last": "int", "inner": "long", "outer": "long", "occ": "long"})
    found, found_at = held(texts.mapInPandas(fn, schema), "blocks")
    # an outer string has one inner string, so a row for each outer string is enough to decide on blocks
    kinds, kinds_at = held(found.groupBy("outer").agg(F.min("occ").alias("a"), F.max("occ").alias("b"), F.min("inner").alias("inner")), "outer")
    # inner strings that stand in an open block and in another block; of blocks with one outer string, one speaks for all
    asked = kinds.groupBy("inner").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.bool_or(F.col("a") == F.col("b")).alias("open")).filter("a <> b AND open").select("inner")
    speakers = kinds.join(asked, "inner", "left_semi").select(F.col("a").alias("occ"))
    undecided = spark.sparkContext.broadcast(_filter(speakers, "occ"))

    def windows(t: Texts):
        if not t.only(_passes(known.value, t.gram)):
            return None
        doc, first, last, _, _, occ = t.blocks()
        ok = _passes(undecided.value, occ)
        if not ok.any():
            return None
        doc, first, size = doc[ok], first[ok], (last - first + 1)[ok]
        starts = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        doc = np.repeat(doc, size)
        return t.named(doc, first=(starts - t.start[doc]).astype(np.int32), window=_salted(spans(t.sums, starts, starts + t.length), t.unit.number), occ=t.occurrence(doc, starts))

    fn, schema = _each(units, windows, {"high": "long", "low": "long", "unit": "int", "first": "int", "window": "long", "occ": "long"})
    single, single_at = held(texts.mapInPandas(fn, schema), "windows")
    known.destroy()
    undecided.destroy()
    more = single.join(_repeated(single, "window"), "window", "left_semi").select("high", "low", "unit", "first", F.col("first").alias("last"))
    sure = found.select("outer", "high", "low", "unit", "first", "last").join(kinds.filter("a <> b").select("outer"), "outer", "left_semi").drop("outer")
    return sure.unionByName(more), [found_at, kinds_at, single_at]


def remove_repeats(docs: DataFrame, length: int = 400, words: int = 50, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages[, kept]) for every row of docs.

    Each byte that a repeated `length`-byte string covers goes, at all its places. n_passages counts the
    maximal stretches of words that sequences of `words` words cover which also start anywhere else,
    shorter than `length` bytes or not; they are reported, not removed. Null texts count as empty; texts
    shorter than `length` are kept whole; of repeated rows, long enough, nothing is kept. kept (on
    request) is the rest as text, with bytes that are no UTF-8 any more replaced. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = identified(documents(docs))
    units = [Unit(0, length, 32, 32), Unit(1, words, 8, 8)]
    texts = rows.filter(F.octet_length("text") >= min(length, 2 * words - 1)).select("high", "low", "text")
    windows, paths = repeated_windows(texts, units)
    packed = lambda unit: F.collect_list(F.when(F.col("unit") == unit, F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("last").cast("long"))))
    runs = cut(windows.groupBy("high", "low").agg(packed(0).alias("runs"), packed(1).alias("word_runs")), "runs")
    remove(docs.sparkSession, *paths)

    def covered(found, size: int, length: int) -> np.ndarray:
        edge = np.zeros(size + 1, np.int64)
        if found is not None and len(found):
            edge += np.bincount(found >> 32, minlength=len(edge))
            edge -= np.bincount((found & 0xFFFFFFFF) + length, minlength=len(edge))
        return np.cumsum(edge[:-1]) > 0

    stretches = lambda gone: int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum())

    def first_of_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for pdf in batches:
            keys = list(zip(pdf["high"], pdf["low"]))
            yield pdf[[not (k in seen or seen.add(k)) for k in keys]]

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, found, passages in zip(pdf["text"], pdf["runs"], pdf["word_runs"]):
                raw = text.encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, np.uint8)
                gone = covered(found, len(data), length)
                left = data[~gone].tobytes()
                said = stretches(covered(passages, int((passages & 0xFFFFFFFF).max()) + words, words)) if passages is not None and len(passages) else 0
                out.append((int(gone.sum()), stretches(gone), hashlib.sha256(left).hexdigest(), said, len(raw.split(None, words - 1)) >= words, left.decode("utf-8", "replace") if with_text else None))
            res = pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256", "n_passages", "long", "kept"])
            yield pd.concat([pdf[["high", "low"]].reset_index(drop=True), res], axis=1)

    distinct = rows.select("high", "low", "text").mapInPandas(first_of_each, IDENTITY)
    own = distinct.join(runs, ["high", "low"], "left").mapInPandas(keep, "high long, low long, n_removed long, n_spans long, kept_sha256 string, n_passages long, long boolean, kept string").dropDuplicates(["high", "low"])
    small = rows.select("doc_id", "high", "low", F.octet_length("text").cast("long").alias("n_bytes"))
    often = small.groupBy("high", "low").agg(F.count(F.lit(1)).alias("copies"))
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    told = own.join(often, ["high", "low"])
    out = meet(small, told, ["high", "low"]).select(
        "doc_id", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(all_gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when((F.col("copies") > 1) & F.col("long"), F.lit(1).cast("long")).otherwise(F.col("n_passages")).alias("n_passages"), F.when(all_gone, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
    return out if with_text else out.drop("kept")
