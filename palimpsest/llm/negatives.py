"""Hard negatives by slots.

A positive asks for the best rows of other labels whose score lies in its window: not above the
positive's score, and not under a share of it. The windows of an anchor overlap; its positives' scores
cut the scores into disjoint slots, so each row falls in one slot of an anchor at most. Tasks keep the
best few rows of a slot, these are merged over tasks, and every window is answered from the slots below
its limit, merged from the highest down.

Scores are computed in blocks: rows are packed where they are, anchors are packed into blocks of
a bounded size, and a block of rows meets a block of anchors in one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut

#: Rows and anchors in a block. With 1,000 components these are 8 and 16 MB, their scores 16 MB.
ROWS, ANCHORS = 1024, 2048
#: Bytes of anchors that may be sent to every task.
SENT_BYTES = 64_000_000
#: Scores below this are exact as doubles, and so are their order keys as integers.
MOST = 2**51
PACKED = "ids binary, labels binary, vectors binary, width int"


def scored_rows(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; components are floor(scale * x)."""
    told = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))  # NaN is above all
    kept = told.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & finite)
    return kept.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * scale).cast("double")).alias("vector"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros, which add nothing to a product."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """Of several rows of one vec_id the one of least label, then vector. Ids alone are counted; only rows of repeated ids are compared."""
    again = cut(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "repeated-ids")
    if again.isEmpty():
        return rows
    some = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("m")).select("vec_id", "m.label", "m.vector")
    return rows.join(again, "vec_id", "left_anti").unionByName(some)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = pa.Table.from_batches([batch.slice(at, ROWS)]).sort_by("vec_id").combine_chunks()
            ids, labels, vectors = (part.column(n).chunk(0) for n in ("vec_id", "label", "vector"))
            width = int(np.diff(vectors.offsets.to_numpy()).max(initial=0))
            packed = (ids.to_numpy().tobytes(), labels.to_numpy().tobytes(), _matrix(vectors, width).tobytes())
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in packed), pa.array([width], pa.int32())], ["ids", "labels", "vectors", "width"])


def _anchor_blocks(anchors: DataFrame, blocks: int) -> DataFrame:
    """Anchors packed into numbered blocks of some ANCHORS rows."""
    limits = "limits" in anchors.columns

    def packed(key, pdf):
        vectors = pa.array(pdf["vector"].tolist(), pa.list_(pa.float64()))
        width = max(map(len, pdf["vector"]))
        row = {"block": key[0], "a_ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "a_labels": pdf["label"].to_numpy(np.int64).tobytes(), "a_vectors": _matrix(vectors, width).tobytes(), "a_width": width}
        return pd.DataFrame([row | ({"a_limits": np.array(pdf["limits"].tolist(), np.int64).tobytes()} if limits else {})])

    schema = "block int, a_ids binary, a_labels binary, a_vectors binary, a_width int" + ", a_limits binary" * limits
    return anchors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")).applyInPandas(packed, schema)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of both."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    if width * np.abs(left).max(initial=0) * np.abs(right).max(initial=0) >= MOST:
        raise OverflowError("inner products of 2^51 or more aren't exact")
    return (left @ right.T).astype(np.int64)


class Best:
    """The best k (score, row) of each (anchor, slot): higher scores first, ties by smaller row."""

    def __init__(self, k: int):
        self.k = k
        self.kept = [np.zeros(0, np.int64)] * 4
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, *found: np.ndarray) -> None:
        self.waiting.append(found)
        self.held += len(found[0])
        if self.held > 500_000 + 2 * len(self.kept[0]):
            self.merge()

    def merge(self) -> list[np.ndarray]:
        a, s, v, r = (np.concatenate(x) for x in zip(self.kept, *self.waiting))
        order = np.lexsort((r, -v, s, a))
        a, s, v, r = a[order], s[order], v[order], r[order]
        beyond = np.zeros(len(a), bool)  # k places after a row of its own slot
        beyond[self.k :] = (a[self.k :] == a[: -self.k]) & (s[self.k :] == s[: -self.k])
        self.kept, self.waiting, self.held = [x[~beyond] for x in (a, s, v, r)], [], 0
        return self.kept


def _best_few(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of each anchor's best k places that are ok; ties by earlier row, and rows come by id."""
    n = len(scores)
    if n > k:
        key = np.where(ok, scores * n + np.arange(n - 1, -1, -1)[:, None], np.iinfo(np.int64).min)
        ok = ok & (key >= np.partition(key, n - k, axis=0)[n - k])
    return np.nonzero(ok)


def _scores(batches: Iterator[pa.RecordBatch], k: int, share: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """The combiner. Without a share: the best rows of the anchor's label, slot 0. With it: the best rows of other labels in each slot between the anchor's limits."""
    best = Best(k)
    for batch in batches:
        for row in batch.to_pylist():
            ids, labels, a_ids, a_labels = (np.frombuffer(row[n], np.int64) for n in ("ids", "labels", "a_ids", "a_labels"))
            scores = _products(np.frombuffer(row["vectors"]).reshape(len(ids), -1 if row["width"] else 0), np.frombuffer(row["a_vectors"]).reshape(len(a_ids), -1 if row["a_width"] else 0))
            if share is None:
                r, a = _best_few(scores, (labels[:, None] == a_labels) & (ids[:, None] != a_ids), k)
                best.add(a_ids[a], np.zeros(len(a), np.int64), scores[r, a], ids[r])
                continue
            limits, other = np.frombuffer(row["a_limits"], np.int64).reshape(len(a_ids), -1), labels[:, None] != a_labels
            for slot, upper in enumerate(limits[:, :-1].T):
                ok = other & (scores <= upper) & (scores > limits[:, slot + 1]) & (share[1] * scores >= share[0] * upper)
                if ok.any():
                    r, a = _best_few(scores, ok, k)
                    best.add(a_ids[a], np.full(len(a), slot), scores[r, a], ids[r])
    if len((kept := best.merge())[0]):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], ["anchor_id", "slot", "score", "row_id"])


def _met(packed: DataFrame, anchors: DataFrame, blocks: int, small: bool, k: int, share: tuple[int, int] | None) -> DataFrame:
    """(anchor_id, slot, score, row_id): the best k of each slot. Each block of rows meets each block of anchors; where these aren't small, both are dealt out by (anchor block, salt)."""
    salts = 1 if small else 64
    dealt = packed.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    given = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = dealt.join(F.broadcast(given) if small else given, ["block", "salt"]).mapInArrow(lambda b: _scores(b, k, share), "anchor_id long, slot long, score long, row_id long")
    nth = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "row_id"))
    return found.withColumn("_n", nth).filter(F.col("_n") <= k).drop("_n")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: vec_id, label, vector (whole numbers, see scored_rows). Anchors are the rows that is_anchor
    allows. An anchor's positives are the best `positives` other rows of its label; for each, the best
    `negatives` rows of other labels with share[0] * positive_score <= share[1] * score <= share[1] * positive_score
    are returned, all if there are fewer. Higher scores come first, ties by smaller vec_id.

    Of several rows of one vec_id the one of least label, then vector, takes part. Shorter vectors are filled
    with zeros. An anchor without positives, and a positive without negatives, give no row; an empty table
    gives an empty result. Columns other than the three are not read. Scores of 2^51 or more raise OverflowError.

    Anchors are sent to every task up to 64 MB; beyond, blocks of both sides are dealt out by
    (anchor block, salt). A task holds one block of each and the best few rows so far.
    """
    told = one_row_an_id(rows.select("vec_id", "label", "vector"))
    anchors = cut(told.filter(is_anchor), "anchors")
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("w")).first()
    blocks, small = -(-size["n"] // ANCHORS) or 1, size["n"] * 8 * (size["w"] or 0) <= SENT_BYTES
    packed = told.mapInArrow(_packed, PACKED)
    best = cut(_met(packed, _anchor_blocks(anchors, blocks), blocks, small, positives, None), "positives").select("anchor_id", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # the slots' limits: an anchor's distinct positive scores from the highest down, then one that no score reaches
    limits = best.groupBy("anchor_id").agg(F.reverse(F.array_sort(F.collect_set("positive_score"))).alias("limits"), F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    filled = F.concat("limits", F.array_repeat(F.lit(-MOST), positives + 1 - F.size("limits")))
    asked = anchors.join(limits.select(F.col("anchor_id").alias("vec_id"), filled.alias("limits")), "vec_id")
    slots = _met(packed, _anchor_blocks(asked, blocks), blocks, small, negatives, share)
    # merged from the highest slot down: a window is a stretch of what stands at or below its limit
    merged = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("s"), F.col("row_id").alias("r")))).alias("found"))
    asks = limits.join(merged, "anchor_id").select("anchor_id", "found", F.explode("positives").alias("p"))
    within = F.filter("found", lambda x: (-x["s"] <= F.col("p.positive_score")) & (-share[1] * x["s"] >= share[0] * F.col("p.positive_score")))
    answered = asks.select("anchor_id", "p.*", F.posexplode(F.slice(within, 1, negatives)).alias("nth", "n"))
    return answered.select("anchor_id", "positive_id", (F.col("nth") + 1).cast("int").alias("rank"), F.col("n.r").alias("negative_id"), "positive_score", (-F.col("n.s")).alias("negative_score"))
