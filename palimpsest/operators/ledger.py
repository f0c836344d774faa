"""Point-in-time reads and append-only writes of a ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import short_digest


def asof(df: DataFrame, at: str, clock: str = "observed_at") -> DataFrame:
    """Rows visible at an instant: their clock is not after it. Rows without a clock are never visible."""
    return df.filter(F.col(clock) <= F.lit(at).cast("timestamp_ntz"))


def ledger_scan(df: DataFrame, at: str, equals: dict[str, object] | None = None, allowed: list[str] | None = None, clock: str = "observed_at", key: str = "observation_id", descending: bool = False, limit: int | None = None) -> DataFrame:
    """Visible rows that meet all equalities, in the order of clock and key. A filter on an unknown column is an error."""
    unknown = [c for c in equals or {} if c not in (allowed if allowed is not None else df.columns) or c not in df.columns]
    if unknown:
        raise ValueError(f"no such filter: {', '.join(unknown)}")
    out = reduce(lambda d, c: d.filter(F.col(c[0]) == F.lit(c[1])), (equals or {}).items(), asof(df, at, clock))
    order = [F.desc(clock), F.desc(key)] if descending else [F.asc(clock), F.asc(key)]
    return out.orderBy(*order) if limit is None else out.orderBy(*order).limit(limit)


def scan_for_opportunities(obs: DataFrame, opps: DataFrame, at: str, clock: str = "observed_at") -> DataFrame:
    """(opportunity_id, n_rows, first_seen) of the visible rows of each opportunity's person or organisation.

    Rows of either are counted per person, per organisation and per both, and joined by equality: a
    row of both counts once, and no row is multiplied by its opportunities. Without person and
    organisation, or without rows, the count is 0.
    """
    seen = asof(obs, at, clock)
    count = lambda by, p: seen.dropna(subset=by).groupBy(*by).agg(F.count(F.lit(1)).alias(f"n_{p}"), F.min(clock).alias(f"first_{p}"))
    out = opps.select("opportunity_id", "person_id", "org_id").join(count(["person_id"], "p"), "person_id", "left").join(count(["org_id"], "o"), "org_id", "left").join(count(["person_id", "org_id"], "b"), ["person_id", "org_id"], "left")
    n = lambda c: F.coalesce(f"n_{c}", F.lit(0))
    return out.select("opportunity_id", (n("p") + n("o") - n("b")).alias("n_rows"), F.least("first_p", "first_o").alias("first_seen"))


def count_visible(df: DataFrame, at: str, by: list[str], clock: str = "observed_at") -> DataFrame:
    return asof(df, at, clock).groupBy(*by).agg(F.count(F.lit(1)).alias("n_visible"), F.min(clock).alias("first_seen"))


def with_digest(df: DataFrame, value: str, out: str = "value_hash") -> DataFrame:
    return df.withColumn(out, short_digest(value))


def new_rows(batch: DataFrame, target: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch that a unique key lets in: the first of each key by `order`, unless the target has the key. A key with a null part is equal to none."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    keyed = batch.filter(whole)
    first = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_nth = 1").drop("_nth")
    return first.join(target.select(*key).dropna().distinct(), key, "left_anti").select(*batch.columns).unionByName(batch.filter(~whole))


def append_counters(batch: DataFrame, target: DataFrame, key: list[str], order: list[str], by: str) -> DataFrame:
    """(by, emitted, ingested, deduped) of an append."""
    kept = new_rows(batch, target, key, order).groupBy(by).agg(F.count(F.lit(1)).alias("ingested"))
    return batch.groupBy(by).agg(F.count(F.lit(1)).alias("emitted")).join(kept, by, "left").select(by, "emitted", F.coalesce("ingested", F.lit(0)).cast("long").alias("ingested"), (F.col("emitted") - F.coalesce("ingested", F.lit(0))).alias("deduped"))


def append_ledger(batch: DataFrame, path: str, key: list[str], order: list[str], clock: str = "observed_at") -> None:
    """Writes the new rows of a batch to a Parquet ledger partitioned by month, by way of the index of its keys (see keyed); offering rows again changes nothing."""
    from palimpsest.operators.keyed import KeyedLedger

    KeyedLedger(batch.sparkSession, path, key, order, clock).append(batch)


def stamp_clocks(df: DataFrame, now: str, clocks: tuple[str, ...] = ("observed_at", "ingested_at")) -> DataFrame:
    """Fills missing clocks: a row without one would never be visible."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(now).cast("timestamp_ntz")) for c in clocks})


def append_missing(rows: DataFrame, target: DataFrame, key: str, aliases: str | None = None) -> DataFrame:
    """Rows whose key is neither a key nor an alias (an array column) of the target."""
    known = target.select(F.col(key).alias("_known"))
    if aliases:
        known = known.unionByName(target.select(F.explode(aliases).alias("_known")))
    return rows.join(known.distinct(), F.col(key) == F.col("_known"), "left_anti")


def large_enough(priors: DataFrame, held: DataFrame, key: str, population: str, least: int = 50) -> DataFrame:
    """The cells not held yet, provided that the population of the fit is `least` at least; else an error from the job that would write them."""
    biggest = priors.agg(F.max(population).alias("_population"))
    guarded = priors.join(held.select(key), key, "left_anti").crossJoin(F.broadcast(biggest))  # one row
    return guarded.withColumn("_ok", F.when(F.col("_population") >= least, True).otherwise(F.raise_error(F.lit(f"fewer than {least} in the population")).cast("boolean"))).filter("_ok").drop("_ok", "_population")


def narrow(df: DataFrame, kinds: list[tuple[str, Column, Column, Column]], keep: list[str]) -> DataFrame:
    """One wide row to a narrow row for each kind (name, condition, value, confidence) whose condition holds, in one pass."""
    rows = F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(name).alias("claim_type"), value.cast("string").alias("value"), conf.cast("double").alias("confidence"))) for name, ok, value, conf in kinds]))
    return df.select(*keep, F.explode(rows).alias("_r")).select(*keep, "_r.*")


def feed_rows(entries: DataFrame, entry: str, authors: str, abstract: str, most: int = 4) -> DataFrame:
    """(entry, claim_type, author, value, team): rows of nested feed entries.

    An authorship row for each of at most `most` authors, an affiliation row for each distinct affiliation of an entry (by its
    first holder), an abstract row for the first author. `authors` is an array of (name, affiliation).
    Entries without authors give nothing; of repeated entries the first in the order of the abstract counts.
    """
    once = entries.filter(F.size(authors) > 0).withColumn("_nth", F.row_number().over(Window.partitionBy(entry).orderBy(abstract))).filter("_nth = 1")
    who = once.select(entry, F.when(F.size(authors) > 1, "team").otherwise("solo").alias("team"), F.col(abstract).alias("_abstract"), F.posexplode(F.slice(authors, 1, most)).alias("_at", "_a"))
    named = who.select(entry, F.lit("authorship").alias("claim_type"), F.col("_a.name").alias("author"), F.col("_a.name").alias("value"), "team")
    placed = who.filter("_a.affiliation IS NOT NULL").groupBy(entry, F.col("_a.affiliation").alias("value")).agg(F.min_by("_a.name", "_at").alias("author"), F.first("team").alias("team")).select(entry, F.lit("affiliation").alias("claim_type"), "author", "value", "team")
    told = who.filter("_at = 0").select(entry, F.lit("abstract").alias("claim_type"), F.col("_a.name").alias("author"), F.col("_abstract").alias("value"), "team")
    return named.unionByName(placed).unionByName(told)


def hosts(df: DataFrame, url: str) -> DataFrame:
    """(host): lower-cased hosts of a column of addresses, without a leading www."""
    with_scheme = F.when(F.col(url).contains("://"), F.col(url)).otherwise(F.concat(F.lit("http://"), F.col(url)))
    return df.select(F.regexp_replace(F.lower(F.try_parse_url(with_scheme, F.lit("HOST"))), r"^www\.", "").alias("host")).filter("host <> ''")


def not_blocked(found: DataFrame, blocked: DataFrame, host: str = "host") -> DataFrame:
    """Hosts that are neither blocked nor below a blocked host: their suffixes are joined by equality."""
    labels = F.split(host, r"\.")
    suffixes = found.select(host, F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    caught = suffixes.join(blocked.select(F.col(host).alias("suffix")), "suffix", "left_semi").select(host).distinct()
    return found.join(caught, host, "left_anti")


def export_json(df: DataFrame, key: str, fields: list[str], path: str, order: str) -> None:
    """One nested document for each key, as lines of JSON."""
    nested_documents(df, key, fields, order).select(F.to_json(F.struct(key, "items")).alias("value")).write.text(path)


def nested_documents(df: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """(key, items): one document for each key. A row without a key belongs to nobody: it is a document of its own, so that such rows don't gather in one."""
    own = F.when(F.col(key).isNull(), F.col(order)).alias("_own")
    return df.groupBy(key, own).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias("items")).drop("_own")
