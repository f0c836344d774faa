"""Near duplicates by SimHash, found through a byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Two fingerprints within `radius` (4) differing bits differ in
at most 4 bytes and so share at least 4 of the 8: the guaranteed minimum of matches. The index is
keyed by the bytes at three positions together, over a family of 20 position triples chosen such
that any 4 shared positions hold a triple of the family; a pair with the guaranteed minimum thus
meets in a posting, and a posting of N fingerprints over 2^24 values stays short. Inside a posting
the shared positional bytes of each pair are tallied, pairs under the minimum go, and the rest is
verified on the differing bits. A posting gives a spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, documents, meet, plain_text, sent, wrapped
from palimpsest.llm.components import connected_components

BYTES = 8
#: A posting of more fingerprints than this is dealt out as pairs of blocks.
POSTING = 2048


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 positions of which every 4 positions hold one: inside one of three groups, or two of a group and one of the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    inside = [t for g in groups for t in combinations(g, 3)]
    across = [tuple(sorted((*pair, one))) for i, g in enumerate(groups) for pair in combinations(g, 2) for one in groups[(i + 1) % 3]]
    return inside + across


def simhash64(text: str, words: int = 4, seed: int = 42) -> int:
    """Bits set in over half the XXH64 of the text's word shingles; 0 without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    n = len(parts)
    if n <= words:
        return xxhash.xxh64_intdigest(line, seed)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: n - words] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    total, votes, step = len(starts), np.zeros(64, np.int64), 65536
    for k in range(0, total, step):
        h = np.array([digest(line[s:e], seed) for s, e in zip(starts[k : k + step], ends[k : k + step])], ">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the signed 64-bit SimHash of every whole text; null texts count as empty (fingerprint 0)."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([simhash64(x, words, seed) for x in batch], np.uint64).view(np.int64))

    return documents(docs).select("doc_id", fp("text").alias("fp"))


def _forest(fp: np.ndarray, own: np.ndarray | None, radius: int, least: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one posting (own None) or of one pair of blocks (own: which of the two)."""
    x = fp[:, None] ^ fp[None, :]
    shared = (x.view(np.uint8).reshape(*x.shape, BYTES) == 0).sum(axis=2, dtype=np.uint8)
    near = shared >= least
    near &= np.bitwise_count(x) <= radius
    if own is not None:
        near &= own[:, None] != own[None, :]
    label = np.arange(len(fp))
    while True:
        low = np.where(near, label[None, :], len(fp)).min(axis=1)
        now = np.minimum(label, low)
        now = now[now]
        if (now == label).all():
            break
        label = now
    return [(int(a), int(label[a])) for a in np.flatnonzero(label != np.arange(len(fp)))]


def _links(radius: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def solve(cell, side, fp):
            ends = np.flatnonzero(np.r_[cell[1:] != cell[:-1], True]) + 1
            starts = np.r_[0, ends[:-1]]
            size = ends - starts
            two = starts[size == 2]
            x = fp[two] ^ fp[two + 1]
            tally = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            ok = (tally >= least) & (np.bitwise_count(x) <= radius) & ((side[two] < 0) | (side[two] != side[two + 1]))
            a, b = list(fp[two[ok]]), list(fp[two[ok] + 1])
            for s, e in zip(starts[size > 2], ends[size > 2]):
                part = fp[s:e]
                for i, j in _forest(part, None if side[s] < 0 else side[s:e], radius, least):
                    a.append(part[i])
                    b.append(part[j])
            return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], names=["a", "b"])

        for batch in batches:
            new = (batch["cell"].to_numpy(), batch["side"].to_numpy(), batch["fp"].to_numpy().view(np.uint64))
            held.append(new)
            if len(new[0]) == 0 or held[0][0][0] == new[0][-1]:
                continue  # one cell so far; it is bounded
            cell, side, fp = (np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(cell, cell[-1]))
            yield solve(cell[:last], side[:last], fp[:last])
            held = [(cell[last:], side[last:], fp[last:])]
        if held and sum(len(x[0]) for x in held):
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    return run


def near_links(fps: DataFrame, radius: int = 4, posting: int = POSTING) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints (distinct, column fp) that chains of at most `radius` bits connect."""
    least = BYTES - radius
    if least < 4:
        raise ValueError("the position triples guarantee a meeting for at most 4 differing bytes")
    byte = lambda p: F.shiftrightunsigned("fp", 8 * (7 - p)).bitwiseAND(255)
    keys = F.array(*[F.lit(i << 24) + byte(a) * 65536 + byte(b) * 256 + byte(c) for i, (a, b, c) in enumerate(position_triples())])
    index = fps.select("fp", F.explode(keys).alias("key"))
    # only hot postings meet their sizes; each holds over `posting` of the index's rows
    hot = cut(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > posting).select("key", F.ceil(F.col("n") / posting).alias("blocks")), "hot-postings")
    met = index.join(sent(hot), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # a posting within the bound is one block; in a hot one each pair of blocks is one bounded cell, and a block meets itself in the cell (b, b)
    own = met.select("fp", "key", "blocks", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    pair = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") > F.col("other")).cast("int"))
    cells = own.select(F.xxhash64("key", pair).alias("cell"), side.alias("side"), "fp").repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(_links(radius, least), "a long, b long").distinct()


def simhash_components(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for every row of docs.

    Texts with chains of fingerprints at most `radius` bits apart share a component, named by its
    least doc_id. Null and empty texts have fingerprint 0 and are linked like any other. Repeated
    rows keep their rows and share a component; rows with a null doc_id take part, and a component
    of null ids alone has a null name. An empty table gives an empty result; other columns of docs,
    whatever their names, are ignored.
    """
    fps = cut(fingerprints(docs, words, seed), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(near_links(nodes.select("fp"), radius), "a", "b")
    named = cut(nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = meet(named, least, ["component"]).select("fp", "component_id")
    return meet(fps, names, ["fp"]).select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, **settings) -> DataFrame:
    """docs with one row of each component of near-duplicate texts: that of the least doc_id (null ids last), of equal ids that of the least text hash.

    Rows are judged by their own text, so rows of one id and different texts may both stay; of repeated rows one stays. Null texts
    count as empty. All columns, whatever their names, are as they were; an empty table gives an empty result.
    """
    text = plain_text(docs)
    rows = cut(wrapped(docs, key=F.xxhash64(text), id=docs["doc_id"].cast("long"), text=text).withColumn("nth", F.monotonically_increasing_id()), "rows")
    texts = rows.groupBy("key").agg(F.min("text").alias("text")).select(F.col("key").alias("doc_id"), "text")
    parts = simhash_components(texts, **settings).select(F.col("doc_id").alias("key"), F.col("component_id").alias("component"))
    named = meet(rows.select("key", "id", "nth"), parts, ["key"], F.col("nth"))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "nth")).alias("first")).select("first.nth")
    return rows.join(first, "nth", "left_semi").select("row.*")
