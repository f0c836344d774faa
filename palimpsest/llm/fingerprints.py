"""Document fingerprints: weighted SimHash in SQL expressions, and search by permuted block tables.

A term is a pair of neighbouring words; its weight (1 to 4) grows with its length, since long terms
tell more. The hash of a term votes with its weight on each of 128 bits, for or against; a bit is
set where the votes in favour outweigh the rest. Votes of 4 bits share one long integer while terms
are added up (16 bits each, for at most 8,000 terms at a time: the highest votes stay within a signed long),
so a document costs 32 sums.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import SENT, cut, documents

BITS = 128
CHUNK = 8_000
LANES = 0x0001000100010001
BLOCKS, BLOCK_BITS = 8, 16


def term_hashes(text: Column) -> Column:
    """An array of one long for each pair of neighbouring words (of lower-cased text, cut at spaces); the two low bits are the weight less 1. A text of one word has that word as its only term."""
    words = F.split(F.lower(text), " ")

    def of(ws: Column) -> Column:
        pair = lambda i: F.struct(F.get(ws, i).alias("a"), F.coalesce(F.get(ws, i + 1), F.lit("")).alias("b"))

        def packed(i: Column) -> Column:
            x = pair(i)
            weight = F.least(F.lit(3), ((F.length(x["a"]) + F.length(x["b"])) / 8).cast("int"))
            return F.xxhash64(x["a"], x["b"]).bitwiseAND(F.lit(~3)).bitwiseOR(weight.cast("long"))

        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - 2, F.lit(0))), packed)

    return F.transform(F.array(words), of)[0]  # words are bound once; as a mere expression they would be split anew for each pair


def add_votes(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, hi, lo): the fingerprint of each row's text. keys must tell the rows apart.

    If rows are hash-partitioned by some of the keys, nothing is shuffled.
    """
    terms = rows.select(*keys, F.posexplode(term_hashes(F.col(text))).alias("at", "h")).select(
        *keys, (F.col("at") / CHUNK).cast("int").alias("chunk"), F.xxhash64("h").alias("x0"), F.xxhash64("h", F.lit(1)).alias("x1"), (F.col("h").bitwiseAND(F.lit(3)) + 1).alias("w")
    )
    vote = lambda c, i: F.sum(F.shiftrightunsigned(c, i).bitwiseAND(F.lit(LANES)) * F.col("w"))
    packed = terms.groupBy(*keys, "chunk").agg(F.sum("w").alias("w"), *[vote(f"x{k}", i).alias(f"v{k}_{i}") for k in (0, 1) for i in range(16)])
    lanes = packed.withColumn("lane", F.explode(F.array(*[F.lit(n) for n in range(4)])))
    one = lambda c: F.expr(f"shiftrightunsigned({c}, 16 * lane) & 65535")
    sums = lanes.groupBy(*keys, "lane").agg(F.sum("w").alias("w"), *[F.sum(one(f"v{k}_{i}")).alias(f"s{k}_{i}") for k in (0, 1) for i in range(16)])
    bit = lambda k, i: F.when(2 * F.col(f"s{k}_{i}") > F.col("w"), F.expr(f"shiftleft(1L, {i} + 16 * lane)")).otherwise(F.lit(0).cast("long"))
    halves = sums.select(*keys, *[reduce(lambda a, b: a.bitwiseOR(b), [bit(k, i) for i in range(16)]).alias(name) for k, name in ((0, "hi"), (1, "lo"))])
    return halves.groupBy(*keys).agg(F.bit_or("hi").alias("hi"), F.bit_or("lo").alias("lo"))


def as_hex(hi: str, lo: str) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in (hi, lo)])


def likeness(a: str, b: str) -> Column:
    """Share of equal bits of the fingerprints (a_hi, a_lo) and (b_hi, b_lo)."""
    differ = sum(F.bit_count(F.col(f"{a}_{h}").bitwiseXOR(F.col(f"{b}_{h}"))) for h in ("hi", "lo"))
    return 1 - differ / F.lit(float(BITS))


def block_keys(hi: str, lo: str, radius: int) -> Column:
    """One long for each permuted table: the table's number and the leading blocks. Fingerprints within radius share a key."""
    lead = BLOCKS - radius
    if not 1 <= lead <= 3:
        raise ValueError("radius must leave 1 to 3 of 8 blocks equal")
    block = lambda i: F.shiftrightunsigned(hi if i < 4 else lo, 16 * (3 - i % 4)).bitwiseAND(0xFFFF)
    return F.array(*[F.xxhash64(F.lit(n), *[block(i) for i in chosen]) for n, chosen in enumerate(combinations(range(BLOCKS), lead))])


def search(queries: DataFrame, index: DataFrame, radius: int = 6) -> DataFrame:
    """(q_hi, q_lo, hi, lo, differ): all distinct fingerprints of index within radius bits of each distinct fingerprint of queries, itself included where indexed.

    Both have columns hi and lo. With 8 blocks of 16 bits, two fingerprints within 6 bits have 2
    equal blocks; a table for each choice of 2 blocks, keyed by them, holds every answer. Rows with
    a null half match nothing. The keys of the queries are sent to every task if there are SENT at most;
    beyond, both sides are shuffled: sizes estimated before the keys are dealt out are far too small.
    """
    known = lambda df: df.select("hi", "lo").filter("hi IS NOT NULL AND lo IS NOT NULL").distinct()
    asked = cut(known(queries), "queries").select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"))
    few = asked.count() * comb(BLOCKS, BLOCKS - radius) <= SENT
    left = asked.withColumn("key", F.explode(block_keys("q_hi", "q_lo", radius))).hint("broadcast" if few else "merge")
    right = known(index).withColumn("key", F.explode(block_keys("hi", "lo", radius)))
    differ = F.bit_count(F.col("q_hi").bitwiseXOR(F.col("hi"))) + F.bit_count(F.col("q_lo").bitwiseXOR(F.col("lo")))
    return left.join(right, "key").withColumn("differ", differ.cast("int")).filter(F.col("differ") <= radius).drop("key").distinct()


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next distinct id in descending order, after the last the first. Ranges are ordered each by itself; one row a range joins them."""
    ranges = cut(docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().repartitionByRange(F.desc("doc_id")).withColumn("range", F.spark_partition_id()), "ranges")
    within = ranges.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("range").orderBy(F.desc("doc_id"))))
    heads = ranges.groupBy("range").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy("range")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("range", F.coalesce(F.lead("head").over(order), F.first("head").over(everything)).alias("after"))
    return within.join(F.broadcast(after), "range").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """(k, doc_id, nth, next_id, text, n_chars, edited): each row's text beside the text whose last third is replaced by the start of the next document.

    k is the id, or a hash of the text for rows with a null id; the rows are hash-partitioned by it. nth tells rows of one k
    apart. Of rows of the next id, the text of least hash is taken. Rows with a null id
    have no next document: nothing replaces their end.
    """
    # k is never null, so both joins below read one and the same exchange of the texts
    rows = documents(docs).select(F.coalesce("doc_id", F.xxhash64("text", F.lit(5))).alias("k"), "doc_id", "text")
    follows = next_ids(rows)
    need = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 3)).alias("need")).join(follows, "doc_id").select(F.col("doc_id").alias("of_id"), F.col("next_id").alias("k"), "need")
    starts = rows.join(need, "k").select("of_id", F.col("doc_id").alias("next_id"), F.xxhash64("text").alias("h"), F.expr("left(text, cast(need as int))").alias("start"))
    starts = starts.groupBy("of_id").agg(F.min(F.struct("h", "start", "next_id")).alias("s")).select(F.col("of_id").alias("k"), "s.start", "s.next_id")
    both = rows.join(starts, "k", "left").withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(left(text, cast(n_chars - n_chars div 3 as int)), left(coalesce(start, ''), cast(n_chars div 3 as int)))")
    nth = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("text"), F.length("text")))
    return both.select("k", "doc_id", nth.alias("nth"), "next_id", "text", "n_chars", edited.alias("edited"))


def fingerprint_edits(docs: DataFrame, radius: int = 6, every: int = 50) -> DataFrame:
    """For every row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    n_near is the number of distinct fingerprints of docs within `radius` bits (its own included), for
    rows whose id is a multiple of `every`, else null. Null texts count as empty. Rows with a null id
    have no next document: their end is removed and near_next is 0. Repeated rows give repeated
    results; a table of one document is its own next; an empty table gives an empty result.
    """
    pairs = edited_pairs(docs)
    keys = ["k", "nth", "doc_id", "next_id", "n_chars", "digest", "which"]
    texts = pairs.withColumn("digest", F.unhex(F.sha2("edited", 256))).select(*keys[:-1], F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("t")).select(*keys[:-1], "t.which", "t.text")
    votes = add_votes(texts, keys)
    pick = lambda which, half: F.bit_or(F.when(F.col("which") == which, F.col(half)).otherwise(F.lit(0).cast("long")))
    prints = cut(votes.groupBy(*keys[:-1]).agg(pick(0, "hi").alias("a_hi"), pick(0, "lo").alias("a_lo"), pick(1, "hi").alias("e_hi"), pick(1, "lo").alias("e_lo")), "fingerprints")
    after = prints.filter("nth = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("next_id"), F.col("a_hi").alias("b_hi"), F.col("a_lo").alias("b_lo"))
    asked = prints.filter(F.col("doc_id") % every == 0).select(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo"))
    near = search(asked, prints.select(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")), radius).groupBy("q_hi", "q_lo").agg(F.count(F.lit(1)).alias("n_near"))
    counts = near.select(F.col("q_hi").alias("a_hi"), F.col("q_lo").alias("a_lo"), "n_near")
    out = prints.join(after, "next_id", "left").join(counts, ["a_hi", "a_lo"], "left")
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), as_hex("a_hi", "a_lo").alias("fingerprint"), as_hex("e_hi", "e_lo").alias("edited_fingerprint"),
        likeness("a", "e").alias("near_edited"), F.coalesce(likeness("a", "b"), F.lit(0.0)).alias("near_next"), F.when(F.col("doc_id") % every == 0, F.col("n_near")).alias("n_near"),
    )
