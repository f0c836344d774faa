"""E4, F9: priors of artifact families with their refusals, and the manifests priced by them."""

from pyspark.sql import functions as F

from palimpsest.operators import priors as R
from palimpsest.plans.population import climb, ladder
from palimpsest.plans.registry import query
from palimpsest.plans.scoring import ABSENT_LLR, FOUND_LLR

FAMILIES = {"talk": ["view_0", "view_1", "error_0"], "code": ["click_0", "click_1", "click_2"], "registry": ["purchase_0", "signup_3"], "hiring": ["purchase_1", "purchase_2"], "reviews": ["view_3", "error_2"], "rare": ["error_3"], "unseen": ["never"]}
DETERMINANTS = {"is_technical": ["code"], "has_domain": ["registry"]}
LADDER = [["is_technical", "has_domain"], ["is_technical"], []]


def typed(source: str) -> str:
    flags = ", ".join(f"list_has_any(families, {xs}) AS {d}" for d, xs in DETERMINANTS.items())
    return f"SELECT person_id, families, {flags} FROM (SELECT person_id, coalesce(list(DISTINCT family) FILTER (family IS NOT NULL), []) AS families FROM {source} LEFT JOIN fam USING (artifact_type) WHERE person_id IS NOT NULL GROUP BY 1)"


def counted(family: str) -> str:
    return f"SELECT '{family}' AS family, level, cell, n, k FROM ({ladder('(SELECT 0 AS slice, * FROM ' + TEXT.format('live') + ')', LADDER, f'''count(*) AS n, count(*) FILTER (list_contains(families, '{family}')) AS k''')})"


TEXT = "(SELECT person_id, families, CAST(is_technical AS VARCHAR) AS is_technical, CAST(has_domain AS VARCHAR) AS has_domain FROM {0})"
PRIORS = {
    "fam": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{a}')" for f, xs in FAMILIES.items() for a in xs) + ") AS f(family, artifact_type)",
    "live": typed("(SELECT * FROM observation WHERE provenance_class = 'live')"),
    "counts": " UNION ALL ".join(map(counted, FAMILIES)),
    "pri": """SELECT family, level, cell, k, n, CASE WHEN ok THEN round(k / n, 4) END AS raw, CASE WHEN ok THEN round((k + 8 * support / population) / (n + 8), 4) END AS p, population - n AS n_complement, CASE WHEN ok THEN round((support - k + 8 * support / population) / (population - n + 8), 4) END AS p_complement, n < 8 AS thin, support, population, state
        FROM (SELECT *, state = 'published' AS ok FROM (SELECT c.*, support, population, CASE WHEN support < 8 THEN 'coverage_gap' WHEN family IN ('code', 'registry') THEN 'tautological' ELSE 'published' END AS state FROM counts c JOIN (SELECT family, k AS support, n AS population FROM counts WHERE level = 2) USING (family))) WHERE ok OR level = 2""",
}


def priors(v):
    live = R.typed_population(v.observation().filter("provenance_class = 'live'"), FAMILIES, DETERMINANTS)
    return R.family_priors(live, list(FAMILIES), LADDER, DETERMINANTS)


@query("e4_family_priors", "SELECT * REPLACE (array_to_string(cell, '|') AS cell) FROM pri", PRIORS)
def families(v):
    return priors(v).withColumn("cell", F.array_join("cell", "|"))


MANIFEST = PRIORS | {
    "subject": typed("observation"),
    "searched": """SELECT person_id, 'code' AS family, person_id % 14 = 0 AS was_found, person_id % 3 = 0 AS was_expected, person_id % 3 = 0 AND person_id % 14 <> 0 AS was_penalised, CASE WHEN person_id % 14 = 0 THEN 0.4 WHEN person_id % 3 = 0 THEN -0.3 ELSE 0.0 END::DOUBLE AS charge, 1.5::DOUBLE AS width FROM subject WHERE person_id % 7 = 0
        UNION ALL SELECT person_id, 'cap_table', FALSE, FALSE, FALSE, 0.0, 2.0 FROM subject WHERE person_id % 11 = 0""",
    "chosen": f"SELECT person_id, family, min(level) AS level, arg_min(n, level) AS prior_n, arg_min(p, level) AS p, arg_min(p_complement, level) AS q FROM ({climb(LADDER, 'person_id', TEXT.format('subject'))}) JOIN pri USING (level, cell) WHERE state = 'published' AND (n >= 8 OR level = 2) GROUP BY 1, 2",
    "priced": f"""SELECT person_id, family, was AS found, ex AS expected, ex AND NOT was AS penalised, nullif(state, 'published') AS refused, round(p, 2) AS prior, prior_n, round(q, 2) AS prior_if_false, level, CASE WHEN p IS NULL THEN 0 WHEN was THEN round(round({FOUND_LLR.format('p', 'q')}, 4), 2) WHEN ex THEN round(llr, 2) ELSE 0 END + 0.0::DOUBLE AS delta, CASE WHEN p IS NULL OR was THEN 0.0 ELSE round(8 * p, 1) END AS widen
        FROM (SELECT *, coalesce(p >= 0.35 AND llr <= -0.15, FALSE) AS ex FROM (SELECT s.person_id, g.family, state, list_contains(families, g.family) AS was, level, prior_n, p, q, round({ABSENT_LLR.format('p', 'q')}, 4) AS llr FROM subject s CROSS JOIN (SELECT family, first(state) AS state FROM pri GROUP BY 1) g LEFT JOIN chosen c ON c.person_id = s.person_id AND c.family = g.family))""",
    "manifest": """SELECT person_id, family, coalesce(was_found, found) AS found, coalesce(was_expected, expected) AS expected, coalesce(was_penalised, penalised) AS penalised, CASE WHEN charge IS NULL THEN refused END AS refused, CASE WHEN charge IS NULL THEN prior END AS prior, CASE WHEN charge IS NULL THEN prior_n END AS prior_n, CASE WHEN charge IS NULL THEN prior_if_false END AS prior_if_false, CASE WHEN charge IS NULL THEN level END AS level,
        coalesce(charge, delta) AS delta, coalesce(width, widen) AS widen, CASE WHEN charge IS NULL THEN 'computed' ELSE 'searched' END AS source FROM priced FULL JOIN searched USING (person_id, family)""",
}


def manifests(v):
    subjects = R.typed_population(v.observation(), FAMILIES, DETERMINANTS)
    p = F.col("person_id")
    charge = F.when(p % 14 == 0, 0.4).when(p % 3 == 0, -0.3).otherwise(0.0)
    code = subjects.filter("person_id % 7 = 0").select(p, F.lit("code").alias("family"), (p % 14 == 0).alias("was_found"), (p % 3 == 0).alias("was_expected"), ((p % 3 == 0) & (p % 14 != 0)).alias("was_penalised"), charge.alias("charge"), F.lit(1.5).alias("width"))
    table = subjects.filter("person_id % 11 = 0").select(p, F.lit("cap_table"), F.lit(False), F.lit(False), F.lit(False), F.lit(0.0), F.lit(2.0)).toDF(*code.columns)
    searched = code.unionByName(table).withColumns({"ordinal": F.lit(1), "evidence_id": F.lit("e")})
    return R.manifest_rows(subjects, priors(v), LADDER, searched)


@query("f9_manifest_rows", "SELECT * FROM manifest", MANIFEST)
def manifest(v):
    return manifests(v)


@query("f9_expected_charges", "SELECT person_id, count(*) AS n_rows, count(*) FILTER (penalised) AS n_penalised, count(*) FILTER (NOT expected) AS n_not_expected, count(refused) AS n_refused, count(*) FILTER (NOT found AND NOT expected AND refused IS NULL) AS n_free, round(sum(widen), 1) AS widen FROM manifest GROUP BY 1", MANIFEST)
def charges(v):
    return R.expected_charges(manifests(v))
