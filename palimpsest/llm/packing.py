"""Packing by lexical retrieval: a sharded BM25 index gives each seed its unused neighbours, which fill its window.

Document frequencies and the mean length are those of the whole corpus. The index is sharded by
content: documents are ordered by their terms of largest BM25 weight, so those that share them lie
together, and ranges of that order are the shards, however many there are. In a shard, a window's
seed queries the inverted index with all its terms; its neighbours that no window has used yet
follow in the order of their scores until the window is full. A document that runs over the
window's end is cut there and seeds the next window. Only the last window of a range is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bpe import byte_bpe
from palimpsest.llm.common import batches_of, cut, documents, spread

#: Tokens of a range (one task), and of a shard of the index (what a task holds at a time).
RANGE, SHARD = 2_000_000, 400_000
#: Ids whose terms are counted together.
GROUP = 250_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Weights:
    """BM25 with the corpus's document frequencies (an array over the vocabulary) and mean length."""

    def __init__(self, df: np.ndarray, documents: int, mean: float, k1: float = 1.2, b: float = 0.75):
        self.df, self.mean, self.k1, self.b = df, max(mean, 1.0), k1, b
        self.idf = np.log(1 + (documents - df + 0.5) / (df + 0.5))

    def of(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, weight) of the distinct terms of docs, by document, then term."""
        size = np.array([len(x) for x in docs], np.int64)
        doc, term, tf = distinct_terms(docs, size, len(self.df))
        return doc, term, self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * size[doc] / self.mean))

    def leading(self, docs: list[np.ndarray], n: int) -> np.ndarray:
        """For each of docs the n terms of largest weight that another document has too (ties: the smaller id), -1 where there are fewer."""
        doc, term, weight = self.of(docs)
        shared = self.df[term] > 1
        doc, term, weight = doc[shared], term[shared], weight[shared]
        out = np.full((len(docs), n), -1, np.int32)
        if not len(doc):
            return out
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
        for k in range(n):
            most = np.maximum.reduceat(weight, first)
            at = np.flatnonzero((weight == most[row]) & (weight > 0))  # weights are above 0; -1 is taken
            at = at[np.concatenate([[True], doc[at[1:]] != doc[at[:-1]]])] if len(at) else at
            out[doc[at], k] = term[at]
            weight[at] = -1
        return out


def distinct_terms(docs: list[np.ndarray], size: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, uses) of the distinct terms of docs, by document, then term: one sort for all of them."""
    key = np.concatenate(docs).astype(np.int64)
    key += np.repeat(np.arange(len(docs)) * terms, size)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    uses = np.diff(np.append(first, len(key)))
    doc, term = np.divmod(key[first], terms)
    return doc, term, uses


def in_groups(docs: list[np.ndarray], most: int = GROUP) -> Iterator[list[np.ndarray]]:
    """docs in groups of about `most` ids together, so that what is worked out at once stays small."""
    group, n = [], 0
    for x in docs:
        group.append(x)
        n += len(x)
        if n > most:
            yield group
            group, n = [], 0
    if group:
        yield group


class Shard:
    """The inverted index of some documents: for each term its documents and weights."""

    def __init__(self, docs: list[np.ndarray], weights: Weights):
        doc, term, weight = weights.of(docs)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        count = np.bincount(term, minlength=len(weights.df))
        self.first = np.cumsum(count) - count
        self.count = count
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, len(docs))))
        self.n = len(docs)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The unused documents that share a term with the seed, by score (ties: the earlier)."""
        terms = self.terms[seed]
        terms = terms[self.count[terms] > 1]
        n = self.count[terms]
        at = np.repeat(self.first[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        score = np.bincount(self.doc[at], self.weight[at], minlength=self.n)
        score[~unused] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


class Filler:
    """Lays documents into windows, one after the other; a window stays open from one shard to the next."""

    def __init__(self, window: int):
        self.window, self.sequence, self.offset = window, 0, 0

    def place(self, size: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of a document of `size` ids."""
        out, start = [], 0
        while start < size:
            length = min(size - start, self.window - self.offset)
            out.append((start, length, self.sequence, self.offset))
            start, self.offset = start + length, self.offset + length
            if self.offset == self.window:
                self.sequence, self.offset = self.sequence + 1, 0
        return out

    def fill(self, docs: list[np.ndarray], weights: Weights) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, start, length, sequence, offset) of all pieces of docs: each window's seed, then its neighbours as they come."""
        index, unused, free, seed, ranked = Shard(docs, weights), np.ones(len(docs), bool), 0, -1, iter(())
        for _ in range(len(docs)):
            at = -1 if seed < 0 else next((int(d) for d in ranked if unused[d]), -1)
            alone = at < 0
            if alone:  # no seed yet, or no neighbour left: the next document in the order of the range
                while not unused[free]:
                    free += 1
                at = free
            unused[at] = False
            before = self.sequence
            for piece in self.place(len(docs[at])):
                yield at, *piece
            if alone or self.sequence != before:
                # the document that opens a window, stands at its start or has no neighbour before it is a seed
                seed = at if self.offset else -1
                ranked = iter(index.neighbours(seed, unused)) if self.offset else iter(())


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, range_tokens: int = RANGE, shard_tokens: int = SHARD) -> DataFrame:
    """One row for each piece of each row of docs, as in PIECES.

    Null and empty texts are documents of the end id alone. Repeated rows and rows with a null id
    are documents of their own. sequence_id is the range's number times 2^32 plus the sequence's
    number in it; offsets in a sequence run without gaps from 0. A document longer than a window
    fills windows of its own and leaves a rest. An empty table gives an empty result. Other columns
    are ignored. The order of ranges ends with a digest and doc_id, so copies may lie in several. A
    task holds the ids and the index of one shard: shard_tokens, or one longer document.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(tokenizer)
        df, end = np.zeros(max(bpe.size, end_id + 1), np.int64), np.array([end_id], bpe.dtype).tobytes()
        for pdf in batches:
            ids = [bpe.packed(x) + end for x in pdf["text"]]
            for group in in_groups([np.frombuffer(x, bpe.dtype) for x in ids]):
                df += np.bincount(distinct_terms(group, np.array([len(x) for x in group]), len(df))[1], minlength=len(df))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": ids, "size": [len(x) // bpe.dtype.itemsize for x in ids], "term": None, "df": None})
        seen = np.flatnonzero(df)
        yield pd.DataFrame({"doc_id": None, "ids": None, "size": None, "term": seen, "df": df[seen]})

    with batches_of(docs.sparkSession, 2000):
        held = cut(documents(docs).mapInPandas(encode, "doc_id long, ids binary, size long, term int, df long"), "encoded")
    encoded = held.filter("term IS NULL").select("doc_id", "ids", "size")
    count, tokens = encoded.agg(F.count("size"), F.sum("size")).first()
    bpe = byte_bpe(tokenizer)
    df = np.zeros(max(bpe.size, end_id + 1), np.int64)
    for term, n in held.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df")).collect():  # at most a row for each entry of the vocabulary
        df[term] = n
    weights = docs.sparkSession.sparkContext.broadcast(Weights(df, count, (tokens or 0) / max(1, count)))
    dtype = bpe.dtype

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lead = np.concatenate([np.zeros((0, 3), np.int32), *[weights.value.leading(group, 3) for group in in_groups([np.frombuffer(x, dtype) for x in pdf["ids"]])]])
            yield pd.DataFrame({"a": lead[:, 0], "b": lead[:, 1], "c": lead[:, 2], "digest": [zlib.crc32(x) for x in pdf["ids"]], "doc_id": pdf["doc_id"].astype("Int64"), "ids": pdf["ids"]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, filler = TaskContext.get().partitionId(), Filler(window)
        names, wait, size = [], [], 0

        def out() -> pd.DataFrame:
            pieces = list(filler.fill(wait, weights.value))
            return pd.DataFrame({
                "doc_id": pd.array([names[d] for d, *_ in pieces], "Int64"), "start": [s for _, s, *_ in pieces], "length": [n for _, _, n, *_ in pieces],
                "ids_crc32": [zlib.crc32(wait[d][s : s + n].astype("<u4").tobytes()) for d, s, n, *_ in pieces], "doc_tokens": [len(wait[d]) for d, *_ in pieces],
                "sequence_id": [(number << 32) + q for *_, q, _ in pieces], "offset": [o for *_, o in pieces],
            })

        for pdf in batches:
            for name, packed in zip(pdf["doc_id"].astype("Int64").astype(object), pdf["ids"]):
                ids = np.frombuffer(packed, dtype)
                if wait and size + len(ids) > shard_tokens:
                    yield out()
                    names, wait, size = [], [], 0
                names.append(name)
                wait.append(ids)
                size += len(ids)
        if wait:
            yield out()

    order = ["a", "b", "c", "digest", "doc_id"]
    ranges = encoded.select("doc_id", "ids").mapInPandas(keyed, "a int, b int, c int, digest long, doc_id long, ids binary").repartitionByRange(spread(tokens or 0, range_tokens), *order)
    return ranges.sortWithinPartitions(*order).mapInPandas(pack, PIECES)
