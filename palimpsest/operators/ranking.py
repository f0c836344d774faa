"""Order over all rows, without one task that holds them; fronts; top-k."""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _path(df: DataFrame) -> str:
    import tempfile
    import uuid

    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:  # tests and single machines
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/ranks-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df from files in the shared folder, so that range partitions are cut once."""
    path = _path(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with its place, from 1, in a total order. Ranges are ranked each by itself, and the counts of the ranges before are added; the table of counts has a row a range."""
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, local.cast("long")).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def sums_before(df: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of `value` over the rows before its own in its key (`name`), and over its whole key (`name`_all); null keys are one key.

    key and order must be a total order. Ranges of it are summed each by itself and a row for each range and key carries the
    sums over, so a key with a large share of all rows is still many tasks.
    """
    ranged = written(df.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()))
    heads = ranged.groupBy("_range", *key).agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("_s").over(Window.partitionBy(*key))
    carried = heads.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"), F.coalesce(whole, F.lit(0)).alias(f"{name}_all"))
    here = Window.partitionBy("_range", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    summed = ranged.withColumn("_here", F.coalesce(F.sum(value).over(here), F.lit(0))).join(carried, same)
    return summed.withColumn(name, F.col("_here") + F.col("_before")).select(*df.columns, name, f"{name}_all")


def order_statistics(df: DataFrame, key: list[str], x: str) -> DataFrame:
    """(key, x, n, before, of): each value that is not null with its rows, the rows of smaller values in its key, and all of the key's. The i-th smallest is the x with before < i <= before + n. Equal values are counted first."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*key, x).agg(F.count(F.lit(1)).alias("n"))
    return sums_before(counts, key, [x], "n", "before").withColumnRenamed("before_all", "of")


def nth_smallest(i: Column, x: str) -> Column:
    """The i-th smallest x of a key, as an aggregate over order_statistics."""
    return F.max(F.when((F.col("before") < i) & (i <= F.col("before") + F.col("n")), F.col(x)))


def medians(df: DataFrame, key: list[str], values: dict[str, Column]) -> DataFrame:
    """(key, a column for each of `values` with its exact median), for keys with any value. All values are ordered in one pass over ranges; no median is held in one buffer."""
    said = df.select(*key, F.explode(F.array(*[F.struct(F.lit(w).alias("which"), c.cast("double").alias("x")) for w, c in values.items()])).alias("_v")).select(*key, F.col("_v.which").alias("_which"), F.col("_v.x").alias("_x"))
    placed = order_statistics(said, [*key, "_which"], "_x")
    mid = placed.groupBy(*key, "_which").agg(((nth_smallest(F.ceil(F.col("of") / 2), "_x") + nth_smallest(F.floor(F.col("of") / 2) + 1, "_x")) / 2).alias("_m"))
    return mid.groupBy(*key).agg(*[F.max(F.when(F.col("_which") == w, F.col("_m"))).alias(w) for w in values])


def index_percentile(df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """df with i/(n-1) of its place by value, then key: ties have places of their own; a single row has 1."""
    ranked = global_rank(df, [F.asc(value), F.asc(key)], "_i")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.crossJoin(F.broadcast(total)).withColumn(name, F.when(F.col("_n") == 1, 1.0).otherwise((F.col("_i") - 1) / (F.col("_n") - 1))).drop("_i", "_n")


def _ranges(vectors: DataFrame, a: str, level: str, b: str) -> DataFrame:
    return written(vectors.repartitionByRange(F.desc(a), F.desc(b), F.desc(level)).withColumn("_range", F.spark_partition_id()))


def _mark(ranged: DataFrame, a: str, level: str, b: str, levels: int) -> DataFrame:
    here = Window.partitionBy("_range").orderBy(F.desc(a), F.desc(b), F.desc(level)).rowsBetween(Window.unboundedPreceding, -1)
    best = lambda k: F.max(F.when(F.col(level) >= k, F.col(b)))
    heads = ranged.groupBy("_range").agg(*[best(k).alias(f"_h{k}") for k in range(levels)])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = heads.select("_range", *[F.max(f"_h{k}").over(earlier).alias(f"_c{k}") for k in range(levels)])
    joined = ranged.withColumns({f"_w{k}": best(k).over(here) for k in range(levels)}).join(F.broadcast(carried), "_range")
    reach = F.when(F.lit(False), F.lit(False))
    for k in range(levels):
        reach = reach.when(F.col(level) == k, F.greatest(f"_w{k}", f"_c{k}") >= F.col(b))
    return joined.select(*ranged.columns, F.coalesce(reach, F.lit(False)).alias("dominated"))


def skyline(vectors: DataFrame, a: str, level: str, b: str, levels: int = 3) -> DataFrame:
    """vectors (distinct) with `dominated`: another vector is as good in a, level and b. Larger is better; level is 0 to levels-1.

    In the order of a, b and level falling, whatever dominates a vector stands before it and has a level as high
    and a b as high; so a vector is dominated if the largest b before it, among levels as high, reaches its own.
    Ranges of that order are read each by itself, and carry their maxima over in a table with a row a range.
    """
    return _mark(_ranges(vectors, a, level, b), a, level, b, levels).drop("_range")


class Reach:
    """For each least level the fronts' envelope: at place f the largest x of any vector of front f or a later one. Held negated, so that places ascend and a front is found by bisection."""

    def __init__(self, levels: int):
        self.held: list[list[int]] = [[] for _ in range(levels)]

    def front(self, level: int, x: int) -> int:
        """One more than the last front that has a vector as high in level and x."""
        return bisect.bisect_right(self.held[level], -x)

    def add(self, level: int, x: int, front: int) -> None:
        """A vector of a front has dominators of every front before, as high in level and x as itself, wherever they stand."""
        for held in self.held[: level + 1]:
            g = min(front, len(held) - 1)
            held.extend([-x] * (front + 1 - len(held)))
            while g >= 0 and held[g] > -x:
                held[g] = -x
                g -= 1

    def rows(self, kind: int) -> list[tuple]:
        return [(kind, k, f, -x) for k, held in enumerate(self.held) for f, x in enumerate(held)]

    def load(self, rows: pd.DataFrame) -> Reach:
        for k, f, x in sorted(zip(rows["level"], rows["front"], rows["x"])):
            assert f == len(self.held[k])
            self.held[k].append(-int(x))
        return self


#: Kinds of rows that blocks hand on: b by front from the blocks of better a, a by front from those of better b, the last front of those better in both.
VECTOR, BY_B, BY_A, BOTH = range(4)
HANDED = "i int, j int, kind int, a long, level long, b long, front long, x long"


def _block(levels: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The fronts of one block's vectors, and what the blocks after it in either direction need to know."""

    def run(key: tuple, vectors: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[0]), int(key[1])
        above, beside = (Reach(levels).load(known[known["kind"] == kind]) for kind in (BY_B, BY_A))
        on_by_a = Reach(levels).load(known[known["kind"] == BY_A])
        least = [0] * levels
        for k, f in zip(known.loc[known["kind"] == BOTH, "level"], known.loc[known["kind"] == BOTH, "front"]):
            least[int(k)] = int(f)
        beyond = [max(n, len(held)) for n, held in zip(least, beside.held)]
        out = []
        ordered = vectors.sort_values(["a", "b", "level"], ascending=False)
        for a, level, b in zip(ordered["a"].tolist(), ordered["level"].tolist(), ordered["b"].tolist()):
            front = max(least[level], beside.front(level, a), above.front(level, b))
            above.add(level, b, front)
            on_by_a.add(level, a, front)
            out.append((i, j, VECTOR, a, level, b, front, 0))
        out += [(i + 1, j, kind, 0, k, 0, f, x) for kind, k, f, x in above.rows(BY_B)] + [(i, j + 1, kind, 0, k, 0, f, x) for kind, k, f, x in on_by_a.rows(BY_A)]
        out += [(i + 1, j, BOTH, 0, k, 0, n, 0) for k, n in enumerate(beyond) if n]
        return pd.DataFrame(out, columns=["i", "j", "kind", "a", "level", "b", "front", "x"])

    return run


def pareto_fronts(df: DataFrame, a: str, level: str, b: str, levels: int = 3, small: int = 20_000) -> DataFrame:
    """(a, level, b, front) of each distinct vector: front 0 is dominated by none, the next by front 0 alone, and so on, to the last.

    Larger is better; level is 0 to levels-1. The vectors are cut into a square of blocks by ranges of a and of b, of `small` vectors on
    average. A block needs to know of those better in a, in b or in both only their fronts' largest b, largest a, or last front; so
    all blocks of a diagonal are worked out together, and n blocks take some 2·√n jobs, each over many tasks. Equal values of a, or of b, lie in one
    range. What a block hands on has a row a front and level.
    """
    distinct = written(df.select(F.col(a).cast("long").alias("a"), F.col(level).cast("long").alias("level"), F.col(b).cast("long").alias("b")).dropna().distinct())
    side = max(1, math.ceil(math.sqrt(distinct.count() / small)))
    shares = [k / side for k in range(1, side)]
    bounds = [sorted({int(x) for x in q}) for q in distinct.approxQuantile(["a", "b"], shares, 0.1 / side)] if shares else [[], []]  # as many as the square has ranges
    place = lambda c, at: F.size(F.filter(F.array(*map(F.lit, at)), lambda x: x > F.col(c))) if at else F.lit(0)
    spark, path = df.sparkSession, _path(df)
    blocks = distinct.withColumns({"i": place("a", bounds[0]), "j": place("b", bounds[1])}).withColumn("d", F.col("i") + F.col("j"))
    blocks.write.partitionBy("d").parquet(path)
    blocks = spark.read.schema("a long, level long, b long, i int, j int, d int").parquet(path)
    known, paths = spark.createDataFrame([], HANDED), []
    for d in range(len(bounds[0]) + len(bounds[1]) + 1):
        out = blocks.filter(F.col("d") == d).groupBy("i", "j").cogroup(known.groupBy("i", "j")).applyInPandas(_block(levels), HANDED)
        paths.append(_path(df))
        out.write.parquet(paths[-1])
        known = spark.read.schema(HANDED).parquet(paths[-1]).filter((F.col("kind") != VECTOR) & (F.col("i") <= len(bounds[0])) & (F.col("j") <= len(bounds[1])))
    found = spark.read.schema(HANDED).parquet(*paths).filter(F.col("kind") == VECTOR)
    return found.select(F.col("a").alias(a), F.col("level").alias(level), F.col("b").alias(b), "front")


def rank_board(df: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, vector: tuple[str, str, str], weights: dict[str, float], levels: int = 3) -> DataFrame:
    """The scored rows with front and rank: by front, then by the weighted sum of index percentiles, falling, then by key.

    score is a hook on plans, DataFrame to DataFrame, not on rows; it must give the vector's columns (none null) and those that weights names.
    """
    board = score(df)
    fronts = pareto_fronts(board, *vector, levels=levels)
    board = board.join(fronts, list(vector))
    for c in weights:
        board = index_percentile(board, c, key, f"_p_{c}")
    total = sum(w * F.col(f"_p_{c}") for c, w in weights.items())
    return global_rank(board.withColumn("_total", total), [F.asc("front"), F.desc("_total"), F.asc(key)], "rank").drop("_total", *[f"_p_{c}" for c in weights])


def cap_per_key(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each key."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_nth") <= most).drop("_nth")


def quota_topk(df: DataFrame, stratum: str, quotas: dict[str, int], order: list[Column]) -> DataFrame:
    """The first rows of each stratum, as many as its quota; other strata give none."""
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(stratum))
    return df.filter(F.col(stratum).isin(*quotas)).withColumn("_nth", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).filter(F.col("_nth") <= quota).drop("_nth")


def round_robin(df: DataFrame, group: str, order: list[str], budget: int) -> DataFrame:
    """The groups' rows in turn, the first of each, then the second, up to the budget."""
    # no more than `budget` rows of a group can come in
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col("turn") <= budget).orderBy("turn", group).limit(budget)


def share_of_largest(counts: DataFrame, n: str) -> DataFrame:
    return counts.crossJoin(F.broadcast(counts.agg(F.max(n).alias("_most")))).withColumn("share", F.col(n) / F.col("_most")).drop("_most")


def pick_examples(df: DataFrame, key: str, n: str) -> DataFrame:
    """One row: the entity with fewest streams (over 0), the first with none, the one with most; ties to the lower key."""
    some = F.col(n) > 0
    return df.agg(
        F.min(F.when(some, F.struct(n, key)))[key].alias("fewest"), F.min(F.when(F.col(n) == 0, F.col(key))).alias("none"), F.min(F.struct((-F.col(n)).alias("m"), F.col(key)))[key].alias("most")
    )


def missing_by_rate(held: DataFrame, key: str, value: str, expected: float, quotas: dict[str, int]) -> DataFrame:
    """(key, kind, items): for everyone in held (key, value, distinct) the values that most others have and they lack, commonest first: `expected` ones at that share or more, `priced` ones below.

    Values in the order of their shares are one row of two arrays, each as long as the largest set held and the quota, which is all that
    anybody can need; each key takes from them what its own set lacks. No key meets every value.
    """
    sets = held.groupBy(key).agg(F.collect_set(value).alias("_held"))
    sizes = sets.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.max(F.size("_held")), F.lit(0)).alias("_most"))
    rates = held.groupBy(value).agg(F.count(F.lit(1)).alias("_k")).crossJoin(F.broadcast(sizes)).withColumn("_rate", F.col("_k") / F.col("_n"))
    rates = rates.withColumn("_kind", F.when(F.col("_rate") >= expected, "expected").otherwise("priced"))
    nth = F.row_number().over(Window.partitionBy("_kind").orderBy(F.desc("_rate"), F.asc(value)))
    listed = rates.withColumn("_nth", nth).filter(F.col("_nth") <= F.col("_most") + max(quotas.values()))
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("_kind") == kind, F.struct("_nth", value)))), lambda x: x[value])
    lists = listed.agg(*[of(kind).alias(f"_{kind}") for kind in quotas])  # one row
    lacking = F.array(*[F.struct(F.lit(kind).alias("kind"), F.slice(F.array_except(f"_{kind}", "_held"), 1, most).alias("items")) for kind, most in quotas.items()])
    return sets.crossJoin(F.broadcast(lists)).select(key, F.explode(lacking).alias("_l")).select(key, "_l.*").filter(F.size("items") > 0)
