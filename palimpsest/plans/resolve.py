"""J1-J4: entity resolution."""

from pyspark.sql import functions as F

from palimpsest.operators import resolve as R
from palimpsest.plans.registry import query

RAW = """SELECT event_id AS row_id, CASE WHEN event_id % 17 = 0 THEN user_id END AS given_id, CASE WHEN event_id % 5 = 0 THEN 'CUSTOMER  #' ELSE 'customer-' END || lpad(CAST(user_id * 2 AS VARCHAR), 9, '0') AS name,
    CASE WHEN event_id % 4 = 0 THEN 'https://www.Dom' || (user_id * 2 % 50) || '.example.com/x?y=1' END AS domain, CASE WHEN event_id % 60 = 0 THEN '@Alt' || (user_id % 7) WHEN event_id % 3 = 0 THEN '@User' || (user_id * 3) END AS handle FROM events"""
NAME = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
DOMAIN = r"nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^[a-z]+://', ''), '[/?#:].*$', ''), '^www\.', ''), '')"
HANDLE = "nullif(regexp_replace(lower(trim({0})), '^@+', ''), '')"
KEYS = f"{NAME.format('name')} AS name_key, {DOMAIN.format('domain')} AS domain_key, {HANDLE.format('handle')} AS handle_key"
SPINE = f"SELECT person_id, {KEYS} FROM (SELECT c_custkey AS person_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'dom' || (c_custkey % 50) || '.example.com' END AS domain, CASE WHEN c_custkey % 4 = 0 THEN 'user' || c_custkey END AS handle FROM customer WHERE c_custkey % 5 <> 1)"
ALIASES = "SELECT c_custkey + 2 AS person_id, 'customer ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS name_key FROM customer WHERE c_custkey % 14 = 0"
RESOLVED = {
    "keyed": f"SELECT row_id, given_id, {KEYS} FROM ({RAW})", "spine": SPINE, "aliases": ALIASES,
    "fit": "SELECT name_key, " + ", ".join(f"count(DISTINCT person_id) FILTER ({c}) AS n_{w}, min(person_id) FILTER ({c}) AS id_{w}" for w, c in (("all", "TRUE"), ("nh", "handle_key IS NULL"), ("nd", "domain_key IS NULL"), ("nn", "handle_key IS NULL AND domain_key IS NULL"))) + " FROM spine WHERE name_key <> '' GROUP BY 1",
    "met": """SELECT row_id, name_key, coalesce(CAST(i AS VARCHAR), CAST(al AS VARCHAR), CAST(h AS VARCHAR), CAST(b AS VARCHAR), CAST(nm AS VARCHAR)) AS hit, CASE WHEN i IS NOT NULL THEN 'id' WHEN al IS NOT NULL THEN 'alias' WHEN h IS NOT NULL THEN 'handle' WHEN b IS NOT NULL THEN 'name_domain' WHEN nm IS NOT NULL THEN 'name' ELSE 'new' END AS matched_on, '@' || handle_key AS hk, '|' || name_key || '|' || domain_key AS bk
        FROM (SELECT *, CASE WHEN handle_key IS NULL AND domain_key IS NULL THEN CASE WHEN n_all = 1 THEN id_all END WHEN handle_key IS NULL THEN CASE WHEN n_nd = 1 THEN id_nd END WHEN domain_key IS NULL THEN CASE WHEN n_nh = 1 THEN id_nh END WHEN n_nn = 1 THEN id_nn END AS nm
        FROM keyed k LEFT JOIN (SELECT person_id AS i FROM spine) ON i = given_id LEFT JOIN (SELECT name_key, min(person_id) AS al FROM aliases GROUP BY 1) USING (name_key) LEFT JOIN (SELECT handle_key, min(person_id) AS h FROM spine GROUP BY 1) USING (handle_key)
        LEFT JOIN (SELECT name_key, domain_key, min(person_id) AS b FROM spine WHERE domain_key IS NOT NULL GROUP BY 1, 2) USING (name_key, domain_key) LEFT JOIN fit USING (name_key))""",
    "pairs": "SELECT hk AS x, bk AS y FROM met WHERE hit IS NULL AND hk IS NOT NULL AND bk IS NOT NULL UNION SELECT bk, hk FROM met WHERE hit IS NULL AND hk IS NOT NULL AND bk IS NOT NULL",
    "reach(node, other)": "SELECT x, x FROM pairs UNION SELECT r.node, p.y FROM reach r JOIN pairs p ON p.x = r.other",
    "own": "SELECT met.*, CASE WHEN hit IS NULL THEN coalesce(c, hk, bk) END AS own FROM met LEFT JOIN (SELECT node, min(other) AS c FROM reach GROUP BY 1) ON node = coalesce(hk, bk)",
    "res": """SELECT row_id, coalesce(hit, 'new:' || coalesce(own, n, CASE WHEN name_key <> '' THEN '|' || name_key END, '#' || row_id)) AS person_id, matched_on FROM own LEFT JOIN (SELECT name_key, min(own) AS n FROM own WHERE own IS NOT NULL AND name_key <> '' GROUP BY 1 HAVING min(own) = max(own)) USING (name_key)""",
}


def batch(v):
    rows = v.table("events").selectExpr(
        "event_id AS row_id", "CASE WHEN event_id % 17 = 0 THEN user_id END AS given_id", "concat(CASE WHEN event_id % 5 = 0 THEN 'CUSTOMER  #' ELSE 'customer-' END, lpad(cast(user_id * 2 AS string), 9, '0')) AS name",
        "CASE WHEN event_id % 4 = 0 THEN concat('https://www.Dom', user_id * 2 % 50, '.example.com/x?y=1') END AS domain", "CASE WHEN event_id % 60 = 0 THEN concat('@Alt', user_id % 7) WHEN event_id % 3 = 0 THEN concat('@User', user_id * 3) END AS handle",
    )
    return R.with_keys(rows)


def spine(v):
    rows = v.table("customer").filter("c_custkey % 5 <> 1").selectExpr("c_custkey AS person_id", "c_name AS name", "CASE WHEN c_custkey % 3 = 0 THEN concat('dom', c_custkey % 50, '.example.com') END AS domain", "CASE WHEN c_custkey % 4 = 0 THEN concat('user', c_custkey) END AS handle")
    return R.with_keys(rows)


def aliases(v):
    return v.table("customer").filter("c_custkey % 14 = 0").selectExpr("c_custkey + 2 AS person_id", "concat('customer ', lpad(cast(c_custkey AS string), 9, '0')) AS name_key")


@query("j1_normalize_keys", "SELECT row_id, name_key, domain_key, handle_key FROM keyed", RESOLVED)
def normalize(v):
    return batch(v).select("row_id", "name_key", "domain_key", "handle_key")


@query("j2_resolve_entities", "SELECT * FROM res", RESOLVED)
def resolve(v):
    return R.resolve_entities(batch(v), spine(v), aliases(v))


@query("j3_alias_rows", "SELECT DISTINCT r.person_id, k.name_key FROM res r JOIN keyed k USING (row_id) WHERE matched_on <> 'new' AND k.name_key <> '' AND NOT EXISTS (SELECT 1 FROM spine s WHERE CAST(s.person_id AS VARCHAR) = r.person_id AND s.name_key = k.name_key) AND NOT EXISTS (SELECT 1 FROM aliases s WHERE CAST(s.person_id AS VARCHAR) = r.person_id AND s.name_key = k.name_key)", RESOLVED)
def new_aliases(v):
    return R.alias_rows(resolve(v), batch(v), spine(v), aliases(v))


@query("j4_resolve_org", "SELECT row_id, coalesce(i, d, n) AS org_id, CASE WHEN i IS NOT NULL THEN 'id' WHEN d IS NOT NULL THEN 'domain' WHEN n IS NOT NULL THEN 'name' ELSE 'none' END AS matched_on FROM (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 200 END AS given_id, CASE WHEN o_orderkey % 3 = 0 THEN 's' || (o_orderkey % 300) || '.example.com' END AS domain_key, 'Supplier#' || lpad(CAST(o_orderkey % 150 AS VARCHAR), 9, '0') AS org_name FROM orders) LEFT JOIN (SELECT s_suppkey AS i FROM supplier) ON i = given_id LEFT JOIN (SELECT 's' || s_suppkey || '.example.com' AS dk, min(s_suppkey) AS d FROM supplier GROUP BY 1) ON dk = domain_key LEFT JOIN (SELECT s_name, min(s_suppkey) AS n FROM supplier GROUP BY 1) ON s_name = org_name")
def org(v):
    rows = v.table("orders").selectExpr("o_orderkey AS row_id", "CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 200 END AS given_id", "CASE WHEN o_orderkey % 3 = 0 THEN concat('s', o_orderkey % 300, '.example.com') END AS domain_key", "concat('Supplier#', lpad(cast(o_orderkey % 150 AS string), 9, '0')) AS org_name")
    orgs = v.table("supplier").selectExpr("s_suppkey AS org_id", "concat('s', s_suppkey, '.example.com') AS domain_key", "s_name AS org_name")
    return R.resolve_org(rows, orgs)
