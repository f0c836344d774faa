"""Filters that keep what they cannot tell, and the counts that go with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH, MISMATCH, OPEN = "match", "mismatch", "unresolved"


def three_valued(attribute: Column | str, holds: Column, negated: bool = False) -> Column:
    """match, mismatch, or unresolved where the attribute is null. Negation turns the first two."""
    a = F.col(attribute) if isinstance(attribute, str) else attribute
    yes, no = (MISMATCH, MATCH) if negated else (MATCH, MISMATCH)
    return F.when(a.isNull(), OPEN).when(holds, yes).otherwise(no)


def apply_constraints(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """df with a state column for each constraint and `passes`: no constraint is a mismatch."""
    states = df.withColumns(constraints)
    return states.withColumn("passes", reduce(lambda a, b: a & b, [F.col(c) != MISMATCH for c in constraints]))


def constraint_counts(states: DataFrame, names: list[str]) -> DataFrame:
    """(constraint_name, n_match, n_mismatch, n_unresolved): one aggregate over all constraints, then a row for each."""
    count = lambda c, s: F.count_if(F.col(c) == s)
    wide = states.agg(*[F.struct(F.lit(c).alias("constraint_name"), count(c, MATCH).alias("n_match"), count(c, MISMATCH).alias("n_mismatch"), count(c, OPEN).alias("n_unresolved")).alias(c) for c in names])
    return wide.select(F.explode(F.array(*names)).alias("c")).select("c.*")


def membership(df: DataFrame, key: str, wanted: list[str], buckets: DataFrame, bucket_key: str, bucket_set: str) -> DataFrame:
    """df with `in_hierarchy`: whether the key's set of buckets meets the wanted ones; null where the key is. buckets is one row a key."""
    hit = F.arrays_overlap(F.col(bucket_set), F.array(*[F.lit(w) for w in wanted]))
    return df.join(buckets, F.col(key) == F.col(bucket_key), "left").withColumn("in_hierarchy", F.when(F.col(key).isNull(), F.lit(None)).otherwise(F.coalesce(hit, F.lit(False)))).drop(bucket_key, bucket_set)


def exclusion_reasons(df: DataFrame, wanted: dict[str, tuple[str, str, Column]]) -> DataFrame:
    """Removed rows with `reasons`: an array of (field, wanted, actual) for each state column that is a mismatch. wanted: state column → (field, wanted value, actual value)."""
    reasons = F.array_compact(F.array(*[F.when(F.col(s) == MISMATCH, F.struct(F.lit(field).alias("field"), F.lit(want).alias("wanted"), actual.cast("string").alias("actual"))) for s, (field, want, actual) in wanted.items()]))
    return df.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def staged_funnel(df: DataFrame, predicates: list[tuple[str, Column]]) -> DataFrame:
    """(step, name, n_alone, n_so_far, of_previous): each predicate alone and together with all before it, in one pass."""
    parts, so_far = [], F.lit(True)
    for i, (name, p) in enumerate(predicates):
        ok = F.coalesce(p, F.lit(False))
        so_far = so_far & ok
        parts.append(F.struct(F.lit(i).cast("long").alias("step"), F.lit(name).alias("name"), F.count_if(ok).alias("n_alone"), F.count_if(so_far).alias("n_so_far")).alias(f"s{i}"))
    wide = df.agg(F.count(F.lit(1)).alias("n"), *parts)
    before = [F.col("n"), *[F.col(f"s{i}.n_so_far") for i in range(len(predicates) - 1)]]
    rows = F.array(*[F.struct(F.col(f"s{i}.step"), F.col(f"s{i}.name"), F.col(f"s{i}.n_alone"), F.col(f"s{i}.n_so_far"), before[i].alias("of_previous")) for i in range(len(predicates))])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def consensus(source_class: str, claim_type: str, artifact: str, source: str, classes: list[str], claims: list[str], artifacts: list[str], markers: list[str]) -> Column:
    """Whether a row shows that the market knows: by class, claim type, artifact, or a marker in the source's name."""
    from palimpsest.functions import contains_any

    known = [F.col(c).isin(xs) for c, xs in ((source_class, classes), (claim_type, claims), (artifact, artifacts)) if xs]
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(k, F.lit(False)) for k in [*known, contains_any(source, markers)]]), F.lit(False))


def strip_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Without the named columns and those that begin with an underscore."""
    return df.drop(*[c for c in df.columns if c in names or c.startswith("_")])


def text_contains_any(df: DataFrame, fields: list[str], terms: list[str], longer_than: int = 2) -> DataFrame:
    """Rows in whose joined fields any term of more than `longer_than` characters occurs; all rows if no term is long enough."""
    from palimpsest.functions import contains_any

    kept = [t for t in terms if len(t) > longer_than]
    return df.filter(contains_any(F.concat_ws(" ", *fields), kept)) if kept else df


def top_by_state(df: DataFrame, state: str, order: list[str], then: list[Column], k: int = 5, last: int = 99) -> DataFrame:
    """The first k rows by the fixed order of states (unknown ones at place `last`)."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(state))
    return df.withColumn("state_rank", F.when(at > 0, at - 1).otherwise(F.lit(last)).cast("long")).orderBy("state_rank", *then).limit(k)


def first_failing(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that fails, else pass."""
    from palimpsest.functions import first_of

    return first_of(rules, "pass")
