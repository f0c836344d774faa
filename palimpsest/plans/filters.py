"""B: projections, filters, predicates; N2: screening rules."""

from pyspark.sql import functions as F

from palimpsest.operators import predicates as P
from palimpsest.plans.registry import query

STATES = {"states": """SELECT *, CASE WHEN sector IS NULL THEN 'unresolved' WHEN sector IN ('BUILDING', 'MACHINERY') THEN 'match' ELSE 'mismatch' END AS s_sector, CASE WHEN region IS NULL THEN 'unresolved' WHEN region IN ('EUROPE', 'ASIA') THEN 'match' ELSE 'mismatch' END AS s_region,
    CASE WHEN solo_or_team IS NULL THEN 'unresolved' WHEN solo_or_team = 'team' THEN 'mismatch' ELSE 'match' END AS s_shape FROM person"""}
NAMES = ["s_sector", "s_region", "s_shape"]


def states(v):
    return P.apply_constraints(v.person(), {
        "s_sector": P.three_valued("sector", F.col("sector").isin("BUILDING", "MACHINERY")), "s_region": P.three_valued("region", F.col("region").isin("EUROPE", "ASIA")),
        "s_shape": P.three_valued("solo_or_team", F.col("solo_or_team") == "team", negated=True),
    })


@query("b1_three_valued_filter", "SELECT person_id, s_sector, s_region, s_shape FROM states WHERE s_sector <> 'mismatch' AND s_region <> 'mismatch' AND s_shape <> 'mismatch'", STATES)
def three_valued_filter(v):
    return states(v).filter("passes").select("person_id", *NAMES)


@query("b1_constraint_counts", " UNION ALL ".join(f"SELECT '{c}' AS constraint_name, count(*) FILTER ({c} = 'match') AS n_match, count(*) FILTER ({c} = 'mismatch') AS n_mismatch, count(*) FILTER ({c} = 'unresolved') AS n_unresolved FROM states" for c in NAMES), STATES)
def constraint_counts(v):
    return P.constraint_counts(states(v), NAMES)


@query("b2_hierarchy_membership", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE n_name IN ('NATION_3', 'NATION_7') OR r_name IN ('EUROPE') END AS in_hierarchy FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def hierarchy(v):
    buckets = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("place"), F.array("n_name", "r_name", F.lit("WORLD")).alias("buckets"))
    people = v.table("customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey")).alias("home"))
    return P.membership(people, "home", ["NATION_3", "NATION_7", "EUROPE"], buckets, "place", "buckets").select("c_custkey", "in_hierarchy")


@query("b3_exclusion_reasons", """SELECT person_id, count(*) AS n_reasons, string_agg(field || '|' || wanted || '|' || actual, ';' ORDER BY field) AS reasons FROM (
    SELECT person_id, 'sector' AS field, 'BUILDING,MACHINERY' AS wanted, sector AS actual FROM states WHERE s_sector = 'mismatch' UNION ALL SELECT person_id, 'region', 'EUROPE,ASIA', region FROM states WHERE s_region = 'mismatch'
    UNION ALL SELECT person_id, 'shape', 'not team', solo_or_team FROM states WHERE s_shape = 'mismatch') GROUP BY person_id""", STATES)
def reasons(v):
    out = P.exclusion_reasons(states(v), {"s_sector": ("sector", "BUILDING,MACHINERY", F.col("sector")), "s_region": ("region", "EUROPE,ASIA", F.col("region")), "s_shape": ("shape", "not team", F.col("solo_or_team"))})
    written = F.array_join(F.array_sort(F.transform("reasons", lambda r: F.concat_ws("|", r["field"], r["wanted"], r["actual"]))), ";")
    return out.select("person_id", F.size("reasons").cast("long").alias("n_reasons"), written.alias("reasons"))


FUNNEL = [("returned", "l_returnflag = 'R'"), ("large", "l_quantity > 25"), ("late", "l_linestatus = 'O'"), ("cheap", "l_extendedprice < 40000")]


@query("b4_staged_funnel", " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS step, '{n}' AS name, count(*) FILTER ({p}) AS n_alone, count(*) FILTER ({' AND '.join(q for _, q in FUNNEL[: i + 1])}) AS n_so_far, count(*) FILTER ({' AND '.join(['TRUE', *[q for _, q in FUNNEL[:i]]])}) AS of_previous FROM lineitem" for i, (n, p) in enumerate(FUNNEL)))
def funnel(v):
    return P.staged_funnel(v.table("lineitem"), [(n, F.expr(p)) for n, p in FUNNEL])


CONSENSUS = "(source_class = 'press' OR claim_type = 'purchase' AND FALSE OR artifact_type = 'view_3' OR coalesce(contains(lower(source_url), 'src13.'), FALSE))"


def consensus():
    return P.consensus("source_class", "claim_type", "artifact_type", "source_url", ["press"], [], ["view_3"], ["SRC13."])


@query("b5_consensus_predicate", f"SELECT observation_id, {CONSENSUS} AS is_consensus FROM observation")
def consensus_rows(v):
    return v.observation().select("observation_id", consensus().alias("is_consensus"))


@query("b6_strip_columns", "SELECT observation_id, person_id, claim_type FROM observation")
def strip(v):
    rows = v.observation().select("observation_id", "person_id", "claim_type", "value", F.col("k").alias("_score"))
    return P.strip_columns(rows, ["value"])


@query("b7_text_contains_any", "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', lang, source, text)), 'license') OR contains(lower(concat_ws(' ', lang, source, text)), 'src7')")
def text_contains(v):
    return P.text_contains_any(v.table("documents"), ["lang", "source", "text"], ["License", "of", "SRC7"]).select("doc_id")


@query("b8_state_filter_topk", "SELECT person_id, s_sector, CASE s_sector WHEN 'mismatch' THEN 0 WHEN 'match' THEN 1 ELSE 99 END AS state_rank FROM states WHERE s_region = 'match' ORDER BY CAST(CASE s_sector WHEN 'mismatch' THEN 0 WHEN 'match' THEN 1 ELSE 99 END AS BIGINT), person_id LIMIT 5".replace("CASE s_sector WHEN 'mismatch' THEN 0 WHEN 'match' THEN 1 ELSE 99 END AS state_rank", "CAST(CASE s_sector WHEN 'mismatch' THEN 0 WHEN 'match' THEN 1 ELSE 99 END AS BIGINT) AS state_rank"), STATES)
def state_topk(v):
    return P.top_by_state(states(v).filter("s_region = 'match'"), "s_sector", ["mismatch", "match"], [F.col("person_id")]).select("person_id", "s_sector", "state_rank")


@query("n2_screen_rules", "SELECT person_id, CASE WHEN NOT coalesce(held, FALSE) THEN 'no_artifact' WHEN s_sector = 'mismatch' THEN 'out_of_thesis' WHEN s_region = 'mismatch' THEN 'excluded_category' WHEN NOT is_real_person THEN 'no_identity' ELSE 'pass' END AS screen_rule FROM states LEFT JOIN (SELECT DISTINCT person_id, TRUE AS held FROM observation WHERE person_id IS NOT NULL) USING (person_id)", STATES)
def screen(v):
    held = v.observation().filter("person_id IS NOT NULL").select("person_id").distinct().withColumn("held", F.lit(True))
    rules = [(~F.coalesce("held", F.lit(False)), "no_artifact"), (F.col("s_sector") == P.MISMATCH, "out_of_thesis"), (F.col("s_region") == P.MISMATCH, "excluded_category"), (~F.col("is_real_person"), "no_identity")]
    return states(v).join(held, "person_id", "left").select("person_id", P.first_failing(rules).alias("screen_rule"))
