"""Compound queries: a table of constraints over a population, in one pass.

A constraint is a row: constraint_id, field, op, values (array of strings), number, prior, rate, hard, negated. Ops:
`in` (the field equals one of the values), `contains` (it holds one of them, in any case), `at_least` and `at_most` (against number),
`evidence` (rows were found that show it; prior and rate price what wasn't). A new constraint needs no code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.scoring import p_absent, p_present

CONSTRAINT = "constraint_id int, field string, op string, values array<string>, number double, prior double, rate double, hard boolean, negated boolean"
MATCH, MISMATCH, UNRESOLVED = "match", "mismatch", "unresolved"
#: A constraint table is written by hand or by a parser: more rows than this are refused.
MOST = 1_000


def attributes(text: list[str] | None = None, numbers: list[str] | None = None, hits: list[str] | None = None) -> Column:
    """A map from field to what is known of it. A field without a value is unresolved: it has a null text and number, and no evidence."""
    kind = "struct<text:array<string>,number:double,hits:bigint>"
    none = lambda t: F.lit(None).cast(t)
    as_array = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string")))
    entries = [(c, as_array(c), none("double"), none("bigint")) for c in text or []] + [(c, none("array<string>"), F.col(c).cast("double"), none("bigint")) for c in numbers or []] + [(c, none("array<string>"), none("double"), F.col(c).cast("bigint")) for c in hits or []]
    return F.create_map(*[x for name, t, n, h in entries for x in (F.lit(name), F.struct(t.alias("text"), n.alias("number"), h.alias("hits")).cast(kind))])


def _holds(known: Column, c: Column) -> Column:
    """Whether a constraint holds; null where its field is unresolved."""
    text = F.when(c["op"] == "in", F.arrays_overlap(known["text"], c["values"])).when(c["op"] == "contains", F.exists(known["text"], lambda t: F.exists(c["values"], lambda v: F.contains(F.lower(t), F.lower(v)))))
    number = F.when(c["op"] == "at_least", known["number"] >= c["number"]).when(c["op"] == "at_most", known["number"] <= c["number"])
    return F.coalesce(text, number, F.when(c["op"] == "evidence", known["hits"] > 0))


def evaluate(people: DataFrame, constraints: DataFrame, known: Column, n: str) -> DataFrame:
    """people with `hard` (constraint_id, state), `soft` (constraint_id, field, p, negated), n_unresolved, `kept` and p_all.

    A hard constraint is a match, a mismatch or unresolved; negation swaps the first two; only a mismatch drops a row. A soft one is a
    probability of four decimals: of evidence by Bayes over n rows looked at, of an attribute 0.95 or 0.05, and 0.5 where it is
    unresolved or the field is unknown. p_all is the product of the soft ones, 1 without any. The table travels as one row of at most MOST
    constraints; each person is read once and nothing is shuffled.
    """
    rows = constraints.select([f.split()[0] for f in CONSTRAINT.split(", ")])
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("constraint_id", "field", "op", "values", "number", "prior", "rate", F.coalesce("hard", F.lit(False)).alias("hard"), F.coalesce("negated", F.lit(False)).alias("negated")))).alias("_c"))
    packed = packed.withColumn("_c", F.when(F.size("_c") <= MOST, F.col("_c")).otherwise(F.raise_error(F.lit(f"over {MOST} constraints")).cast(packed.schema["_c"].dataType)))
    met = people.withColumn("_known", known).crossJoin(F.broadcast(packed))  # one row

    def state(c: Column) -> Column:
        holds = _holds(F.try_element_at(F.col("_known"), c["field"]), c)
        return F.struct(c["constraint_id"].alias("constraint_id"), F.when(holds.isNull(), UNRESOLVED).when(holds != c["negated"], MATCH).otherwise(MISMATCH).alias("state"))

    def chance(c: Column) -> Column:
        own = F.try_element_at(F.col("_known"), c["field"])
        holds, hits = _holds(own, c), F.coalesce(own["hits"], F.lit(0))
        looked = F.greatest(F.coalesce(F.col(n), F.lit(0)), F.lit(0))
        shown = F.when(c["negated"], p_absent(c["prior"], c["rate"], looked, hits)).otherwise(p_present(c["prior"], c["rate"], looked, hits))
        plain = F.when(holds.isNull(), 0.5).when(holds != c["negated"], 0.95).otherwise(0.05)
        p = F.when((c["op"] == "evidence") & own.isNotNull(), shown).otherwise(plain)
        return F.struct(c["constraint_id"].alias("constraint_id"), c["field"].alias("field"), F.round(p, 4).alias("p"), c["negated"].alias("negated"))

    split = lambda hard: F.filter("_c", lambda c: c["hard"] if hard else ~c["hard"])
    out = met.withColumns({"hard": F.transform(split(True), state), "soft": F.transform(split(False), chance)})
    out = out.withColumns({"n_unresolved": F.size(F.filter("hard", lambda s: s["state"] == UNRESOLVED)), "kept": ~F.exists("hard", lambda s: s["state"] == MISMATCH)})
    return out.withColumn("p_all", F.aggregate("soft", F.lit(1.0), lambda a, s: a * s["p"])).select(*people.columns, "hard", "soft", "n_unresolved", "kept", "p_all")


def ranked(evaluated: DataFrame, point: str, n: str, key: str, top: int | None = None) -> DataFrame:
    """The rows kept, by p_all, then point, then n, all falling, then key: two figures that are never multiplied into one; the first `top`."""
    out = evaluated.filter("kept").orderBy(F.desc("p_all"), F.desc(point), F.desc(n), F.asc(key))
    return out if top is None else out.limit(top)


def constraint_chips(evaluated: DataFrame) -> DataFrame:
    """(constraint_id, n_match, n_mismatch, n_unresolved, n_scored, mean_p): a hard constraint's states over everyone, a soft one's mean probability over those kept."""
    hard = F.transform("hard", lambda s: F.struct(s["constraint_id"].alias("constraint_id"), s["state"].alias("state"), F.lit(None).cast("double").alias("p")))
    soft = F.transform("soft", lambda s: F.struct(s["constraint_id"].alias("constraint_id"), F.lit(None).cast("string").alias("state"), s["p"].alias("p")))
    rows = evaluated.select(F.explode(F.concat(hard, F.when(F.col("kept"), soft).otherwise(F.filter(soft, lambda s: F.lit(False))))).alias("s")).select("s.*")
    count = lambda what: F.count_if(F.col("state") == what).alias(f"n_{what}")
    return rows.groupBy("constraint_id").agg(count(MATCH), count(MISMATCH), count(UNRESOLVED), F.count("p").alias("n_scored"), F.avg("p").alias("mean_p"))


def cold_start_survival(evaluated: DataFrame, n: str, evidence: str, thin: int = 2) -> DataFrame:
    """One row (n_total, n_kept, n_without_evidence, n_thin, kept_unresolved, applies): how many are kept without evidence either way, whom a filter that asks for evidence of absence would delete, and with `thin` rows or fewer; pairs of person and hard constraint that stay though unresolved; whether a negated soft constraint was asked at all."""
    kept = F.col("kept")
    asked = F.coalesce(F.max(F.exists("soft", lambda s: s["negated"])), F.lit(False))
    return evaluated.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(kept).alias("n_kept"), F.count_if(kept & (F.coalesce(F.col(evidence), F.lit(0)) == 0)).alias("n_without_evidence"), F.count_if(kept & (F.col(n) <= thin)).alias("n_thin"), F.coalesce(F.sum("n_unresolved"), F.lit(0)).alias("kept_unresolved"), asked.alias("applies"))
