"""Joins with a rule for which match wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_of(names: list[str], dims: list[str]) -> Column:
    """One string for the values of some dimensions, with the dimensions' names; nulls read as unknown. Bars and backslashes in values are escaped, so no two cells share a string."""
    value = lambda d: F.replace(F.replace(F.coalesce(F.col(d).cast("string"), F.lit("unknown")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.concat_ws("|", *[F.concat(F.lit(f"{d}="), value(d)) for d in names if d in dims]) if names else F.lit("")


def backoff_join(entities: DataFrame, cells: DataFrame, ladder: list[list[str]], dims: list[str], values: list[str], size: str = "n", least: int = 12) -> DataFrame:
    """Each entity with the first cell of the ladder that has `least` members at least; the last rung is always accepted. Every row stays, equal ones and those without a cell (nulls) too.

    cells has `level` (place in the ladder), `cell` (key_of its dimensions), size and values. The ladder is climbed
    once for each distinct combination of dimensions, by equality on (level, cell); entities then meet their combination's cell.
    """
    keyed = entities.withColumn("_key", key_of(dims, dims))
    combinations = keyed.select("_key", F.array(*[F.struct(F.lit(i).alias("level"), key_of(r, dims).alias("cell")) for i, r in enumerate(ladder)]).alias("_r")).groupBy("_key").agg(F.first("_r").alias("_r"))
    asked = combinations.select("_key", F.explode("_r").alias("_r")).select("_key", "_r.*")
    found = asked.join(cells.select("level", "cell", size, *values), ["level", "cell"]).filter((F.col(size) >= least) | (F.col("level") == len(ladder) - 1))
    best = found.groupBy("_key").agg(F.min_by(F.struct("level", "cell", size, *values), "level").alias("_b"))
    return keyed.join(best, "_key", "left").select(*entities.columns, "_b.*")


def grouping_cells(df: DataFrame, ladder: list[list[str]], dims: list[str], aggs: dict[str, Column], also: list[str] | None = None) -> DataFrame:
    """(level, cell, also, aggregates) of each rung, from one GROUPING SETS pass; nulls count as unknown. The columns `also` are in every set."""
    also = also or []
    known = df.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit("unknown")) for d in dims})
    out = known.groupingSets([[F.col(d) for d in [*also, *r]] for r in ladder], *[F.col(d) for d in [*also, *dims]]).agg(F.grouping_id().alias("_g"), *[c.alias(k) for k, c in aggs.items()])
    bit = lambda r: sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in r)
    level = reduce(lambda a, x: a.when(F.col("_g") == bit(x[1]), x[0]), enumerate(ladder[1:], 1), F.when(F.col("_g") == bit(ladder[0]), 0))
    cell = reduce(lambda a, x: a.when(F.col("_g") == bit(x[1]), key_of(x[1], dims)), enumerate(ladder[1:], 1), F.when(F.col("_g") == bit(ladder[0]), key_of(ladder[0], dims)))
    return out.select(level.alias("level"), cell.alias("cell"), *also, *aggs)


def most_specific(entities: DataFrame, rules: DataFrame, key: str, base: str, dims: list[str], order: str) -> DataFrame:
    """For each entity and base artifact the rule that fits with most conditions (ties: the first by `order`).

    A rule's null dimension fits anything; its `conditions` (a map from dimension to value) must hold, and an entity whose
    value is null fails them. rules are a parameter table: its distinct patterns of set dimensions, at most 2^dims,
    each give an equality join.
    """
    named = rules.withColumn("_mask", sum(F.when(F.col(f"rule_{d}").isNotNull(), 1 << i).otherwise(0) for i, d in enumerate(dims)))
    parts = []
    for mask in range(1 << len(dims)):
        on = [d for i, d in enumerate(dims) if mask >> i & 1]
        part = named.filter(F.col("_mask") == mask)
        # without a set dimension a rule fits every entity: that is the rule table times the entities, by its meaning
        joined = entities.join(part, reduce(lambda a, b: a & b, [F.col(d) == F.col(f"rule_{d}") for d in on])) if on else entities.crossJoin(F.broadcast(part))
        parts.append(joined)
    all_fits = reduce(DataFrame.unionByName, parts)
    holds = F.forall(F.map_entries(F.coalesce("conditions", F.create_map().cast("map<string,string>"))), lambda e: F.coalesce(F.element_at(F.create_map(*[x for d in dims for x in (F.lit(d), F.col(d).cast("string"))]), e["key"]) == e["value"], F.lit(False)))
    specificity = F.bit_count("_mask") + F.coalesce(F.size(F.map_keys("conditions")), F.lit(0))
    best = Window.partitionBy(key, base).orderBy(F.desc(specificity), order)
    return all_fits.filter(holds).withColumn("_nth", F.row_number().over(best)).filter("_nth = 1").drop("_nth", "_mask")


def exact_then_margin(asked: DataFrame, cells: DataFrame, exact: list[str], margin: list[str], p: str = "p", n: str = "n", clock: str = "observed_at", thin: int = 25) -> DataFrame:
    """asked with p, n, basis and thin: the latest cell equal on all of `exact` (nulls equal nulls), else the n-weighted mean over the cells equal on `margin`, else nulls."""
    one = cells.groupBy(*exact).agg(F.max_by(F.struct(p, n), clock).alias("_e"))
    many = cells.groupBy(*margin).agg((F.sum(F.col(p) * F.col(n)) / F.sum(n)).alias("_p"), F.sum(n).alias("_n"))
    same = lambda a, b, keys: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    out = asked.join(one, same(asked, one, exact), "left").select(asked["*"], "_e")
    out = out.join(many, same(out, many, margin), "left").select(out["*"], "_p", "_n")
    m = F.round("_p", 3)
    return out.select(*asked.columns, F.coalesce(f"_e.{p}", m).alias("p"), F.coalesce(f"_e.{n}", "_n").alias("n"), F.when(F.col("_e").isNotNull(), "exact").when(F.col("_p").isNotNull(), "margin").otherwise("none").alias("basis"),
                      F.coalesce(F.col(f"_e.{n}"), F.col("_n")).__lt__(thin).alias("thin"))


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, clock: str, values: list[str], tie: str, most: int = 1_000_000) -> DataFrame:
    """left with the values of the latest right row of its key that isn't after `at`; nulls where there is none, or no key.

    Both sides are laid end to end and read in order within each key; no pair of rows is compared. Keys are counted first: one with over
    `most` rows is cut into ranges of time, each read by itself, and a range's last values are carried into the next; of a range only
    its first key can have begun before, so a row a range is carried at most.
    """
    from palimpsest.operators.ranking import written

    kinds = left.select(F.struct("*").alias("r")).schema["r"].dataType, right.select(F.struct(*values).alias("v")).schema["v"].dataType
    nothing = lambda kind: F.lit(None).cast(kind)
    tagged = left.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), nothing(right.schema[tie].dataType).alias("_tie"), F.struct("*").alias("_row"), nothing(kinds[1]).alias("_v"))
    marks = right.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(clock).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), nothing(kinds[0]).alias("_row"), F.struct(*values).alias("_v"))
    rows, order = tagged.unionByName(marks), ["_t", "_side", "_tie"]
    latest = lambda *by: F.last("_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))

    counts = left.groupBy(F.col(key).alias("_k")).count().unionByName(right.groupBy(F.col(key).alias("_k")).count()).groupBy("_k").agg(F.sum("count").alias("_n"))
    hot = counts.filter((F.col("_n") > most) & F.col("_k").isNotNull()).select("_k")
    n_hot = 0 if hot.isEmpty() else (hot := written(hot)).count()
    small = F.broadcast(hot) if n_hot <= 100_000 else hot
    done = (rows.join(small, "_k", "left_anti") if n_hot else rows).withColumn("_v", latest("_k")).filter("_side = 1")
    if n_hot:
        ranged = written(rows.join(small, "_k", "left_semi").repartitionByRange("_k", *order).withColumn("_range", F.spark_partition_id()))
        heads = ranged.filter(F.col("_v").isNotNull()).groupBy("_range", "_k").agg(F.max_by("_v", F.struct(*order)).alias("_v"))
        # a range without values hands on what came before it
        spans = ranged.groupBy("_range", "_k").agg(F.lit(1).alias("_")).join(heads, ["_range", "_k"], "left")
        before = F.last("_v", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        carried = spans.select("_range", "_k", before.alias("_c")).filter(F.col("_c").isNotNull())
        cut = ranged.withColumn("_v", latest("_range", "_k")).filter("_side = 1").join(F.broadcast(carried), ["_range", "_k"], "left").withColumn("_v", F.coalesce("_v", "_c"))
        done = done.select("_row", "_v").unionByName(cut.select("_row", "_v"))
    keyless = left.filter(F.col(key).isNull()).select(F.struct("*").alias("_row"), nothing(kinds[1]).alias("_v"))
    return done.select("_row", "_v").unionByName(keyless).select("_row.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def receipt_join(evidence: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """evidence with the receipt's status and address, where it was not skipped and has a status; an address already there stays."""
    kept = receipts.filter((F.col("verdict") != "SKIPPED") & (F.col("receipt_status") != 0)).select(key, "verdict", "receipt_status", "receipt_url")
    return evidence.join(kept, key, "left").withColumn("final_url", F.coalesce("final_url", "receipt_url")).withColumn("http_status", F.coalesce("receipt_status", "http_status")).drop("receipt_url", "receipt_status")


def id_drift_pairs(ids: DataFrame, name: str, prefix: str = "ch_") -> DataFrame:
    """(drifted, other): ids with the prefix whose stem and another id are prefixes of each other. Each id is met by equality with the other side's beginnings, of the lengths that the ids have; so no common beginning is a hot key."""
    left = ids.filter(F.col(name).startswith(prefix)).select(F.col(name).alias("drifted"), F.col(name).substr(F.lit(len(prefix) + 1), F.length(name)).alias("_stem")).filter("_stem <> ''")
    right = ids.filter(~F.col(name).startswith(prefix) & (F.col(name) != "")).select(F.col(name).alias("other"))

    def beginnings(long: DataFrame, c: str, short: DataFrame, d: str, shorter: bool) -> DataFrame:
        lengths = short.agg(F.collect_set(F.length(d)).alias("_ls"))  # one row, an entry for each length
        fits = lambda n: (n < F.length(c)) if shorter else (n <= F.length(c))
        cuts = F.transform(F.filter("_ls", fits), lambda n: F.col(c).substr(F.lit(1), n))
        return long.crossJoin(F.broadcast(lengths)).select(*long.columns, F.explode(cuts).alias("_k"))

    by_stem = beginnings(left, "_stem", right, "other", False).join(right.withColumn("_k", F.col("other")), "_k").select("drifted", "other")
    by_other = beginnings(right, "other", left, "_stem", True).join(left.withColumn("_k", F.col("_stem")), "_k").select("drifted", "other")
    return by_stem.unionByName(by_other)


def board_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, status, rank_a, rank_b, rank_delta, verdict_changed) of two boards with rank and verdict, ordered by change of verdict, best rank, size of move."""
    both = a.select(key, F.col("rank").alias("rank_a"), F.col("verdict").alias("verdict_a")).join(b.select(key, F.col("rank").alias("rank_b"), F.col("verdict").alias("verdict_b")), key, "full_outer")
    status = F.when(F.col("rank_a").isNull(), "entered").when(F.col("rank_b").isNull(), "left").otherwise("both")
    out = both.select(key, status.alias("status"), "rank_a", "rank_b", (F.col("rank_a") - F.col("rank_b")).alias("rank_delta"), F.coalesce(F.col("verdict_a") != F.col("verdict_b"), F.lit(False)).alias("verdict_changed"))
    return out.orderBy(F.desc("verdict_changed"), F.least("rank_a", "rank_b"), F.desc_nulls_last(F.abs("rank_delta")), key)


def _runs(n: int):
    """The runs of n words of an array of words."""
    return lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))


def name_leaks(names: DataFrame, texts: DataFrame, name: str, text_id: str, text: str, longer_than: int = 4) -> DataFrame:
    """(text_id, name): texts that hold a name as a run of whole words, in any case. Names are met by the hash of their words; a name glued inside a word is not found."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}#]+"), lambda w: w != "")
    known = names.filter(F.length(name) > longer_than).select(F.col(name).alias("name"), F.array_join(words(F.col(name)), " ").alias("_gram"), F.size(words(F.col(name))).alias("_n")).filter("_n > 0").distinct()
    sizes = [r["_n"] for r in known.select("_n").distinct().orderBy("_n").collect()]  # a few small numbers
    found = []
    said = texts.select(text_id, words(F.col(text)).alias("_w"))
    for n in sizes:
        grams = said.filter(F.size("_w") >= n).select(text_id, F.explode(F.transform(F.array("_w"), _runs(n))[0]).alias("_gram")).distinct()
        found.append(grams.join(known.filter(F.col("_n") == n), "_gram").select(text_id, "name"))
    return reduce(DataFrame.unionByName, found) if found else said.select(text_id, F.lit(None).cast("string").alias("name")).limit(0)
