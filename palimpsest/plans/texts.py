"""J5-J11 and F20: text and page jobs."""

from pyspark.sql import functions as F

from palimpsest.operators import texts as T
from palimpsest.plans.registry import query

BARE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script\s*>', ' ', 'gis'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gis'), '<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"""


#: The entities that the pages hold, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
DECODED = BARE
for _entity, _char in ENTITIES.items():
    DECODED = f"replace({DECODED}, '{_entity}', '{_char}')"


@query("j5_clean_markup", f"SELECT page_id, {DECODED} AS text FROM pages")
def clean(v):
    return v.table("pages").select("page_id", T.clean_markup(F.col("html")).alias("text"))


@query("j5_strip_tags", f"SELECT page_id, {BARE} AS text FROM pages")
def strip(v):
    return v.table("pages").select("page_id", T.clean_markup(F.col("html"), unescape=False).alias("text"))


MARKERS = {"parked": ['class="ad"', "<nav", "<aside"], "transacting": ["<form", "<table"], "pricing": ["&amp;&amp;"], "changelog": ["<pre", "2024-"], "waitlist": ["<footer"]}


@query("j6_page_state", """SELECT page_id, CASE WHEN page_id % 40 = 0 THEN 'unknown' WHEN trim(coalesce(l, '')) = '' THEN 'unknown' WHEN contains(l, 'class="ad"') OR contains(l, 'class="ad"')::INT + contains(l, '<nav')::INT + contains(l, '<aside')::INT >= 2 THEN 'parked' WHEN contains(l, '<form') OR contains(l, '<table') THEN 'transacting' WHEN contains(l, '&amp;&amp;') THEN 'pricing' WHEN contains(l, '<pre') OR contains(l, '2024-') THEN 'changelog' WHEN contains(l, '<footer') THEN 'waitlist' ELSE 'unknown' END AS state FROM (SELECT page_id, lower(html) AS l FROM pages)""")
def state(v):
    status = F.when(F.col("page_id") % 40 == 0, 403).otherwise(200)
    return v.table("pages").select("page_id", T.page_state(F.col("html"), status, MARKERS, ["<nav", "<aside"]).alias("state"))


ENTITIES, SECTOR = ["postgres", "kafka", "and", "tion", "license", "redis"], ["license", "token", "the"]
LEAD = "CASE doc_id % 4 WHEN 0 THEN 'We ran 12 ms p99 and 40 rps on postgres in production at my last job, v1.2 for $40k and 3.5 months ' WHEN 1 THEN 'I wrote it the hard way: 10% of 300 users ' ELSE '' END"


def _sql_text(pattern: str) -> str:
    return pattern.replace("'", "''")


@query("j7_text_signal_score", rf"""SELECT doc_id, round(s, 6) AS score, s >= 0.42 AS kept, s >= 0.3 AS kept_in_template FROM (SELECT doc_id, (0.2 * least(greatest((length(body) - 320) / 1880, 0), 1) + 0.2 * least((len(regexp_extract_all(body, '{_sql_text(T.UNITS)}')) + len(regexp_extract_all(body, '{_sql_text(T.AMOUNTS)}')) + len(regexp_extract_all(body, '{_sql_text(T.VERSIONS)}'))) / 6, 1)
    + 0.2 * least(({" + ".join(f"contains(l, '{w}')::INT" for w in ENTITIES)}) / 5, 1) + 0.3 * least(({" + ".join(f"regexp_matches(body, '(?i){_sql_text(p)}')::INT" for p in T.LIVED)}) / 3, 1) + 0.1 * least(({" + ".join(f"contains(l, '{w}')::INT" for w in SECTOR)}) / 2, 1))
    * CASE WHEN length(body) - length(regexp_replace(body, 'https?://\S+', '', 'g')) > 0.25 * length(body) THEN 0.6 ELSE 1 END * CASE WHEN len(regexp_extract_all(body, '(?m)^\s*>')) >= 4 THEN 0.8 ELSE 1 END AS s
    FROM (SELECT doc_id, {LEAD} || text AS body, lower({LEAD} || text) AS l FROM documents))""".replace("\\\\", "\\"))
def signal(v):
    rows = T.spread_out(v.table("documents").select("doc_id", "text")).select("doc_id", F.concat(F.expr(LEAD), "text").alias("body"))
    return T.with_signal_score(rows, "body", ENTITIES, SECTOR, "s").select("doc_id", F.round("s", 6).alias("score"), (F.col("s") >= T.KEEP_AT).alias("kept"), (F.col("s") >= T.KEEP_TEMPLATE_AT).alias("kept_in_template"))


FORM = "CASE doc_id % 4 WHEN 0 THEN 'Location: x | REMOTE : y | Résumé| z' WHEN 1 THEN concat('no role: x', chr(10), 'ab | cd | e', chr(10), ' tech stack: q') WHEN 2 THEN concat('Stack: a', chr(10), 'email| b', chr(10)) ELSE '' END"


@query("j8_hiring_template_fields", rf"SELECT doc_id, CAST(len(list_distinct(list_transform(regexp_extract_all(body, '(?i)(?:^|\n|\|)\s*({'|'.join(T.LABELS)})\s*[:|]', 1), lambda x: lower(x)))) + CASE WHEN regexp_matches(body, '{T.HEADER}') THEN 2 ELSE 0 END AS BIGINT) AS fields FROM (SELECT doc_id, {FORM} || text AS body FROM documents)")
def template(v):
    return v.table("documents").select("doc_id", F.concat(F.expr(FORM), "text").alias("body")).select("doc_id", T.template_fields(F.col("body")).cast("long").alias("fields"))


def _atoms_sql() -> str:
    rest, parts = "body", []
    for kind, pattern in T.ATOMS:
        parts.append(f"SELECT doc_id, '{kind}' AS kind, trim(unnest(regexp_extract_all(body, '{pattern}'))) AS raw, TRUE AS hard FROM b")
        rest = f"regexp_replace({rest}, '{pattern}', ' ', 'g')"
    number = f"SELECT doc_id, unnest(regexp_extract_all({rest}, '{T.NUMBER}')) AS raw FROM b"
    parts.append(f"SELECT doc_id, CASE WHEN length(regexp_replace(raw, '\\D', '', 'g')) >= 4 THEN 'serial' ELSE 'count' END AS kind, raw, length(regexp_replace(raw, '\\D', '', 'g')) >= 4 AS hard FROM ({number})".replace("\\\\", "\\"))
    return " UNION ALL ".join(parts)


@query("j9_extract_atoms", _atoms_sql(), {"b": "SELECT doc_id, 'v1.' || (doc_id % 7) || ' of 2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || ' at $' || doc_id || '.5m, £ 1,815 k and 98/441,' || doc_id || ', ' || (doc_id % 90) || ' % ' || text AS body FROM documents"})
def atoms(v):
    body = F.expr("concat('v1.', doc_id % 7, ' of 2024-01-', lpad(cast(1 + doc_id % 28 AS string), 2, '0'), ' at $', doc_id, '.5m, £ 1,815 k and 98/441,', doc_id, ', ', doc_id % 90, ' % ', text)")
    return T.extract_atoms(v.table("documents").withColumn("body", body), "doc_id", "body")


@query("j10_passages_in_documents", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def literal(v):
    return T.passages_in_texts(v.table("benchmark"), v.table("documents"), "item_id", "text", "doc_id", "text")


def _forms(raw: str) -> str:
    """The spellings of a number as an SQL list."""
    bare = rf"regexp_replace({raw}, '[^\d.,/]', '', 'g')"
    digits = rf"regexp_replace({bare}, '\D', '', 'g')"
    unzero = lambda x: f"CASE WHEN ltrim({x}, '0') = '' THEN '0' ELSE ltrim({x}, '0') END"
    runs = rf"list_filter(regexp_split_to_array({bare}, '\D+'), lambda r: r <> '')"
    scale = f"CASE lower(regexp_extract({raw}, '([KkMmBb])$', 1)) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 WHEN 'b' THEN 1000000000 END"
    scaled = f"CAST(CAST(TRY_CAST(replace({bare}, ',', '') AS DOUBLE) * {scale} AS BIGINT) AS VARCHAR)"
    return f"CASE WHEN {digits} = '' THEN CAST([] AS VARCHAR[]) ELSE list_filter(list_concat([{digits}, {unzero(digits)}, regexp_replace({bare}, '[,/]', '', 'g'), {scaled}], list_concat({runs}, list_transform({runs}, lambda u: {unzero('u')}))), lambda f: f IS NOT NULL AND f <> '') END"


def _flat(c: str) -> str:
    for a, b in zip("’‘“”—–−\u00a0", ("''", "''", '"', '"', "-", "-", "-", " ")):
        c = f"replace({c}, '{a}', '{b}')"
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def _all(c: str, pattern: str) -> str:
    return f"regexp_extract_all({c}, '{pattern}')"


_REST = "e"
for _, _pattern in T.ATOMS:
    _REST = f"regexp_replace({_REST}, '{_pattern}', ' ', 'g')"
_WORDS = f"list_distinct(list_filter({{0}}, lambda w: NOT list_contains({T.STOP_WORDS}, w)))"
EXCERPTS = {
    "checks": "SELECT conv_id || '-' || turn AS check_id, coalesce(CASE WHEN turn % 3 = 0 THEN substr(coalesce(page_text, text), 5) ELSE text || ' v1.' || (conv_id % 3) END, '') AS e, coalesce(page_text, '') AS page, CASE conv_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS status, conv_id % 14 = 0 AS absent, conv_id % 11 = 0 AS reserved FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS page_text FROM conversations)",
    "facts": f"SELECT *, list_concat(list_transform({_all('e', T.ATOMS[0][1])}, lambda a: [a]), list_concat(list_transform({_all('e', T.ATOMS[3][1])}, lambda a: [ltrim(a, 'v')]), list_transform(list_concat({_all('e', T.ATOMS[1][1])}, list_concat({_all('e', T.ATOMS[2][1])}, list_filter({_all(_REST, T.NUMBER)}, lambda a: length(regexp_replace(a, '\\D', '', 'g')) >= 4))), lambda a: {_forms('a')}))) AS hard, list_concat({_all('page', T.ATOMS[0][1])}, flatten(list_transform({_all('page', T.NUMBER)}, lambda a: {_forms('a')}))) AS there, {_WORDS.format(_all('lower(e)', '[a-z]{4,}'))} AS we, {_WORDS.format(_all('lower(page)', '[a-z]{4,}'))} AS wp FROM checks",
    "missed": "SELECT *, len(list_filter(hard, lambda f: NOT list_has_any(f, there))) AS n_missing FROM facts",
}


@query("j10_verify_excerpts", f"SELECT check_id, CASE WHEN reserved THEN 'SKIPPED' WHEN status = 404 THEN CASE WHEN absent THEN 'ABSENT-OK' ELSE 'ABSENT-BAD' END WHEN status >= 400 THEN 'ERROR' WHEN trim(e) = '' OR contains({_flat('lower(page)')}, {_flat('lower(e)')}) THEN 'PASS' WHEN len(hard) = 0 THEN 'SOFT-OK' WHEN n_missing = 0 THEN 'PASS' ELSE 'MISMATCH' END AS verdict, n_missing, CASE WHEN len(we) = 0 THEN 0.0 ELSE len(list_intersect(we, wp)) / len(we) END AS overlap FROM missed", EXCERPTS)
def verify(v):
    """Conversation turns as excerpts, each against the turn before it as its page."""
    from pyspark.sql import Window

    c = v.table("conversations").withColumn("page_text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    rows = c.select(F.concat_ws("-", "conv_id", "turn").alias("check_id"), F.expr("CASE WHEN turn % 3 = 0 THEN substr(coalesce(page_text, text), 5) ELSE concat(text, ' v1.', conv_id % 3) END").alias("excerpt"), "page_text",
                    F.expr("CASE conv_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END").alias("http_status"), F.expr("conv_id % 14 = 0").alias("expected_absent"), F.expr("conv_id % 14 <> 0").alias("claimed_found"), F.expr("CASE WHEN conv_id % 11 = 0 THEN 'http://a.test/x' ELSE 'http://a.example.com/' END").alias("url"))
    return T.verify_excerpts(rows)


@query("j11_excerpt_truncate", r"SELECT doc_id, CASE WHEN length(f) > 120 THEN rtrim(substr(f, 1, 119)) || '…' ELSE f END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)")
def truncate(v):
    return v.table("documents").select("doc_id", T.one_line(F.col("text"), 120).alias("excerpt"))


@query("f20_derived_attributes", """SELECT source, CASE WHEN t >= 4 THEN 'technical' WHEN o >= 2 THEN 'operator' ELSE 'unknown' END AS founder_type, region, CASE WHEN greatest(s1, s2) = 0 THEN NULL WHEN s1 = greatest(s1, s2) THEN 'law' ELSE 'security' END AS sector FROM (
    SELECT source, max(contains(l, 'tion')::INT) + max(contains(l, 'ing')::INT) + max(contains(l, 'ed')::INT) + max(contains(l, 'qzx')::INT) AS t, max(contains(l, 'license')::INT) + max(contains(l, 'moron')::INT) AS o, arg_min(r, doc_id) FILTER (r IS NOT NULL) AS region, max(contains(l, 'license')::INT) + max(contains(l, 'gnu')::INT) AS s1, max(contains(l, 'token')::INT) + max(contains(l, 'scum')::INT) AS s2
    FROM (SELECT source, doc_id, lower(text) AS l, CASE WHEN contains(lower(text), 'schung') THEN 'DE' WHEN contains(lower(text), 'ción') THEN 'ES' END AS r FROM documents) GROUP BY source)""")
def attributes(v):
    return T.derived_attributes(v.table("documents"), "source", "text", "doc_id", ["tion", "ing", "ed", "qzx"], ["license", "moron"], {"law": ["license", "gnu"], "security": ["token", "scum"]}, {"schung": "DE", "ción": "ES"})
