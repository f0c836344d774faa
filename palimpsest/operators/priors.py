"""Priors of artifact families by reference class, the guards that refuse them, and manifests priced by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import log_ratio_absent, log_ratio_found
from palimpsest.operators.population import climbed, ladder_cells

#: The pseudo-count of the margin, members of a cell that may speak, people that must hold a family, what makes an artifact expected, points of width for each unit of prior.
STRENGTH, THIN, SUPPORT, EXPECT_P, EXPECT_RATIO, WIDEN = 8.0, 8, 8, 0.35, -0.15, 8.0
PUBLISHED, GAP, TAUTOLOGY = "published", "coverage_gap", "tautological"


def typed_population(obs: DataFrame, families: dict[str, list[str]], determinants: dict[str, list[str]], key: str = "person_id") -> DataFrame:
    """(key, families, a true or false for each determined dimension): everyone with a row, the families held, and whether any of a dimension's determinants is among them."""
    of = F.create_map(*[F.lit(x) for f, xs in families.items() for a in xs for x in (a, f)])
    held = obs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(of[F.col("artifact_type")])).alias("families"))  # as many as there are families, at most
    return held.withColumns({d: F.arrays_overlap("families", F.array(*map(F.lit, xs))) for d, xs in determinants.items()})


def family_priors(people: DataFrame, families: list[str], ladder: list[list[str]], determinants: dict[str, list[str]]) -> DataFrame:
    """(family, level, cell, k, n, raw, p, n_complement, p_complement, thin, support, population, state) of every rung, cell and family.

    p = (k + STRENGTH · margin)/(n + STRENGTH), and p_complement the same of everyone outside the cell; the ladder ends with the whole population, the margin.
    A family that fewer than SUPPORT people hold is a coverage gap, one that helps to define a dimension of the ladder is tautological: it
    gets one row, at the last rung, without priors. Shares have four decimals, on which later steps decide. All rungs and families are
    counted in one pass. No people, no rows.
    """
    last = len(ladder) - 1
    counts = {"n": F.count(F.lit(1))} | {f"_k{i}": F.count_if(F.array_contains("families", f)) for i, f in enumerate(families)}
    cells = ladder_cells(people, ladder, counts, [])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"_k{i}").alias("k")) for i, f in enumerate(families)]))
    rows = cells.select("level", "cell", "n", rows.alias("_f")).select("_f.family", "level", "cell", "_f.k", "n")
    whole = rows.filter(F.col("level") == last).select("family", F.col("k").alias("support"), F.col("n").alias("population"))  # a row a family
    defining = [x for d, xs in determinants.items() if any(d in r for r in ladder) for x in xs]
    state = F.when(F.col("support") < SUPPORT, GAP).when(F.col("family").isin(defining), TAUTOLOGY).otherwise(PUBLISHED)
    out = rows.join(F.broadcast(whole), "family").withColumn("state", state).filter((F.col("state") == PUBLISHED) | (F.col("level") == last))
    margin, told = F.col("support") / F.col("population"), F.col("state") == PUBLISHED
    shrunk = lambda k, n: F.when(told, F.round((k + STRENGTH * margin) / (n + STRENGTH), 4))
    n_other = F.col("population") - F.col("n")
    return out.select(
        "family", "level", "cell", "k", "n", F.when(told, F.round(F.col("k") / F.col("n"), 4)).alias("raw"), shrunk(F.col("k"), F.col("n")).alias("p"), n_other.alias("n_complement"), shrunk(F.col("support") - F.col("k"), n_other).alias("p_complement"),
        (F.col("n") < THIN).alias("thin"), "support", "population", "state",
    )


def manifest_rows(subjects: DataFrame, priors: DataFrame, ladder: list[list[str]], searched: DataFrame, key: str = "person_id") -> DataFrame:
    """(key, family, found, expected, penalised, refused, prior, prior_n, prior_if_false, level, delta, widen, source) for each subject and family.

    subjects: key, families and the ladder's dimensions, over all their rows; priors: of family_priors, which may stand on fewer. The
    prior is that of the first rung whose cell has THIN members, or of the margin. A family without a published prior is a zero row that
    says which guard refused it. searched (key, family, was_found, was_expected, was_penalised, charge, width, ordinal, evidence_id)
    holds what a verifier looked for: its first row stands instead of the computed one, families outside the priors too. An absence that wasn't expected
    charges nothing: a searched row that does raises an error.
    """
    dims = list(dict.fromkeys(d for r in ladder for d in r))
    cells = priors.filter(F.col("state") == PUBLISHED).select("family", "level", "cell", "n", F.struct("p", "p_complement").alias("_p"))
    asked = climbed(subjects, cells, ladder, ["family"], "_p", [], THIN).select(*dims, "family", "taken.level", F.col("taken.n").alias("prior_n"), "taken.value.p", "taken.value.p_complement")
    vocabulary = priors.groupBy("family").agg(F.first("state").alias("_state"))  # a row a family
    grid = subjects.select(key, *dims, "families").crossJoin(F.broadcast(vocabulary)).join(asked, [*dims, "family"], "left")
    llr = F.round(log_ratio_absent("p", "p_complement"), 4)
    found, expected = F.array_contains("families", F.col("family")), F.coalesce((F.col("p") >= EXPECT_P) & (llr <= EXPECT_RATIO), F.lit(False))
    delta = F.when(F.col("p").isNull(), 0.0).when(found, F.round(F.round(log_ratio_found("p", "p_complement"), 4), 2)).when(expected, F.round(llr, 2)).otherwise(0.0)
    computed = grid.select(
        key, "family", found.alias("found"), expected.alias("expected"), (expected & ~found).alias("penalised"), F.nullif("_state", F.lit(PUBLISHED)).alias("refused"), F.round("p", 2).alias("prior"), "prior_n", F.round("p_complement", 2).alias("prior_if_false"), "level",
        (delta + 0.0).alias("delta"), F.when(F.col("p").isNull() | found, 0.0).otherwise(F.round(WIDEN * F.col("p"), 1)).alias("widen"),
    )
    first = searched.groupBy(key, "family").agg(F.min_by(F.struct("was_found", "was_expected", "was_penalised", "charge", "width"), F.struct("ordinal", "evidence_id")).alias("_s"))
    wrong = ~F.col("_s.was_found") & ~F.col("_s.was_expected") & (F.col("_s.charge") != 0)
    charge = F.when(wrong, F.raise_error(F.lit("an absence that was not expected is charged")).cast("double")).otherwise(F.col("_s.charge"))
    both = computed.join(first.join(subjects.select(key), key, "left_semi"), [key, "family"], "full_outer")
    told = F.col("_s").isNotNull()
    pick = lambda a, b: F.when(told, a).otherwise(F.col(b)).alias(b)
    fields = [("was_found", "found"), ("was_expected", "expected"), ("was_penalised", "penalised")]
    nothing = [F.when(~told, F.col(c)).alias(c) for c in ("refused", "prior", "prior_n", "prior_if_false", "level")]
    return both.select(key, "family", *[pick(F.col(f"_s.{a}"), b) for a, b in fields], *nothing, pick(F.round(charge, 2), "delta"), pick(F.round(F.col("_s.width"), 1), "widen"), F.when(told, "searched").otherwise("computed").alias("source"))


def expected_charges(rows: DataFrame, key: str = "person_id") -> DataFrame:
    """(key, n_rows, n_penalised, n_not_expected, n_refused, n_free, widen) of manifests: free are absences that were priced and not expected."""
    free = ~F.col("found") & ~F.col("expected") & F.col("refused").isNull()
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("penalised").alias("n_penalised"), F.count_if(~F.col("expected")).alias("n_not_expected"), F.count("refused").alias("n_refused"), F.count_if(free).alias("n_free"), F.round(F.sum("widen"), 1).alias("widen"))
