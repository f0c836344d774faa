"""A: scans, sources, sinks."""

from pyspark.sql import functions as F

from palimpsest.operators import ledger as L
from palimpsest.plans.registry import query

AT = "2024-01-20 00:00:00"


@query("a1_ledger_scan", f"SELECT observation_id, person_id, channel_id, artifact_type, observed_at, value FROM observation WHERE observed_at <= TIMESTAMP '{AT}' AND claim_type = 'click' AND provenance_class = 'live'")
def ledger_scan(v):
    return L.ledger_scan(v.observation(), AT, {"claim_type": "click", "provenance_class": "live"}).select("observation_id", "person_id", "channel_id", "artifact_type", "observed_at", "value")


@query("a1_ledger_scan_latest", f"SELECT observation_id, observed_at FROM observation WHERE observed_at <= TIMESTAMP '{AT}' ORDER BY observed_at DESC, observation_id DESC LIMIT 100")
def ledger_scan_latest(v):
    return L.ledger_scan(v.observation(), AT, descending=True, limit=100).select("observation_id", "observed_at")


@query("a2_ledger_scan_for_opportunity", f"""SELECT opportunity_id, CAST(coalesce(np, 0) + coalesce(no, 0) - coalesce(nb, 0) AS BIGINT) AS n_rows, least(fp, fo) AS first_seen FROM opportunity
    LEFT JOIN (SELECT person_id, count(*) np, min(observed_at) fp FROM seen GROUP BY 1) p USING (person_id) LEFT JOIN (SELECT org_id, count(*) no, min(observed_at) fo FROM seen GROUP BY 1) o USING (org_id)
    LEFT JOIN (SELECT person_id, org_id, count(*) nb FROM seen GROUP BY 1, 2) b USING (person_id, org_id)""", {"seen": f"SELECT * FROM observation WHERE observed_at <= TIMESTAMP '{AT}'"})
def for_opportunity(v):
    return L.scan_for_opportunities(v.observation(), v.opportunity(), AT)


@query("a3_count_visible", f"SELECT person_id, count(*) AS n_visible, min(observed_at) AS first_seen FROM observation WHERE observed_at <= TIMESTAMP '{AT}' GROUP BY person_id")
def count_visible(v):
    return L.count_visible(v.observation(), AT, ["person_id"])


@query("a4_read_versions_asof", """SELECT 'claim' AS kind, CAST(claim_id AS VARCHAR) AS id, observed_at AS at FROM claim WHERE observed_at <= TIMESTAMP '1999-01-01' UNION ALL SELECT 'evidence', evidence_id, observed_at FROM evidence WHERE observed_at <= TIMESTAMP '1999-01-01'
    UNION ALL SELECT 'stage', opportunity_id || ':' || stage, entered_at FROM stage WHERE entered_at <= TIMESTAMP '1999-01-01' UNION ALL SELECT 'opportunity', CAST(opportunity_id AS VARCHAR), opened_at FROM opportunity WHERE opened_at <= TIMESTAMP '1999-01-01'""")
def versions(v):
    at = "1999-01-01 00:00:00"
    read = lambda df, kind, key, clock: L.asof(df, at, clock).select(F.lit(kind).alias("kind"), key.cast("string").alias("id"), F.col(clock).alias("at"))
    return (
        read(v.claim(), "claim", F.col("claim_id"), "observed_at").unionByName(read(v.evidence(), "evidence", F.col("evidence_id"), "observed_at"))
        .unionByName(read(v.stage(), "stage", F.concat_ws(":", "opportunity_id", "stage"), "entered_at")).unionByName(read(v.opportunity(), "opportunity", F.col("opportunity_id"), "opened_at"))
    )


KEY = ["source_url", "claim_type", "value_hash"]
HASHED = {"hashed": "SELECT *, substr(sha256(value_text), 1, 16) AS value_hash FROM observation", "batch": "SELECT * FROM hashed WHERE observation_id % 4 <> 1", "target": "SELECT * FROM hashed WHERE observation_id % 4 = 1",
          "surviving": """SELECT * FROM batch WHERE source_url IS NULL UNION ALL SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY source_url, claim_type, value_hash ORDER BY ingested_at, observation_id) AS nth FROM batch WHERE source_url IS NOT NULL) b
            WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM target t WHERE t.source_url = b.source_url AND t.claim_type = b.claim_type AND t.value_hash = b.value_hash)"""}


def batch_and_target(v):
    rows = L.with_digest(v.observation(), "value_text")
    return rows.filter("observation_id % 4 <> 1"), rows.filter("observation_id % 4 = 1")


@query("a5_append_ledger", "SELECT observation_id, source_url, claim_type, value_hash, observed_at FROM surviving", HASHED)
def append_ledger(v):
    return L.new_rows(*batch_and_target(v), KEY, ["ingested_at", "observation_id"]).select("observation_id", *KEY, "observed_at")


@query("e16_ingest_counters", """SELECT provenance_class, emitted, coalesce(ingested, 0) AS ingested, emitted - coalesce(ingested, 0) AS deduped FROM (SELECT provenance_class, count(*) AS emitted FROM batch GROUP BY 1)
    LEFT JOIN (SELECT provenance_class, count(*) AS ingested FROM surviving GROUP BY 1) USING (provenance_class)""", HASHED)
def ingest_counters(v):
    return L.append_counters(*batch_and_target(v), KEY, ["ingested_at", "observation_id"], "provenance_class")


@query("a6_append_reference_rows", "SELECT opportunity_id, coalesce(first_signal_at, TIMESTAMP '2024-02-01') AS first_signal_at, coalesce(opened_at, TIMESTAMP '2024-02-01') AS opened_at FROM opportunity")
def append_reference(v):
    return L.stamp_clocks(v.opportunity().select("opportunity_id", "first_signal_at", "opened_at"), "2024-02-01 00:00:00", ("first_signal_at", "opened_at"))


@query("a7_feed_to_observations", """SELECT conv_id, 'authorship' AS claim_type, name AS author, name AS value, team FROM who WHERE turn < 4
    UNION ALL SELECT conv_id, 'affiliation', arg_min(name, turn), affiliation, any_value(team) FROM who WHERE turn < 4 AND affiliation IS NOT NULL GROUP BY conv_id, affiliation
    UNION ALL SELECT conv_id, 'abstract', name, abstract, team FROM who WHERE turn = 0""",
    {"who": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, 'author ' || (length(text) % 50) AS name, CASE WHEN turn % 2 = 0 THEN role END AS affiliation, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS abstract,
        CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN 'team' ELSE 'solo' END AS team FROM conversations"""})
def feed(v):
    c = v.table("conversations")
    author = F.struct("turn", F.concat(F.lit("author "), (F.length("text") % 50).cast("string")).alias("name"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("affiliation"))
    entries = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(author)).alias("authors"), F.min_by("text", "turn").alias("abstract"))
    return L.feed_rows(entries.withColumn("authors", F.transform("authors", lambda a: F.struct(a["name"].alias("name"), a["affiliation"].alias("affiliation")))), "conv_id", "authors", "abstract")


FEED = {
    "told": r"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, CASE WHEN turn % 5 <> 4 THEN 'author ' || (length(text) % 50) END AS name, CASE WHEN turn % 2 = 0 THEN role END AS affiliation, trim(regexp_replace(first_value(text) OVER (PARTITION BY conv_id ORDER BY turn), '\s+', ' ', 'g')) AS abstract FROM conversations WHERE conv_id % 13 <> 0""",
    "who": "SELECT * EXCLUDE (turn), row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN 'team' ELSE 'solo' END AS team FROM told WHERE name IS NOT NULL",
}


@query("a7_feed_xml", """SELECT CAST(conv_id AS VARCHAR) AS entry, 'authorship' AS claim_type, name AS author, name AS value, team FROM who WHERE turn < 4
    UNION ALL SELECT CAST(conv_id AS VARCHAR), 'affiliation', arg_min(name, turn), affiliation, any_value(team) FROM who WHERE turn < 4 AND affiliation IS NOT NULL GROUP BY conv_id, affiliation
    UNION ALL SELECT CAST(conv_id AS VARCHAR), 'abstract', name, abstract, team FROM who WHERE turn = 0""", FEED)
def feed_xml(v):
    """The conversations written as XML feeds, some entries without a date and all of them again in a later file, and read back as nested entries."""
    from palimpsest.operators.ranking import _path
    from palimpsest.sources.feeds import first_entries, read_feed

    c = v.table("conversations")
    author = F.struct("turn", F.when(F.col("turn") % 5 != 4, F.concat(F.lit("author "), (F.length("text") % 50).cast("string"))).otherwise(F.lit("  ")).alias("name"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("affiliation"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(author)).alias("a"), F.min_by("text", "turn").alias("summary"))
    day = F.date_format(F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval((F.col("conv_id") % 400).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entries = rows.select(
        F.concat(F.lit("http://x.example.org/abs/"), F.col("conv_id").cast("string")).alias("id"), F.lit("A  title").alias("title"), "summary", F.when(F.col("conv_id") % 13 != 0, day).otherwise("no date").alias("published"),
        F.struct(F.lit("cs.LG").alias("_term")).alias("primary_category"), F.transform("a", lambda x: F.struct(x["name"].alias("name"), x["affiliation"].alias("affiliation"))).alias("author"),
    )
    place = _path(c)
    again = entries.withColumn("summary", F.lit("later")).withColumn("published", F.lit("1999-01-01T00:00:00Z"))
    for name, part in (("a", entries), ("b", again.filter(F.regexp_extract("id", "([0-9]+)$", 1).cast("long") % 13 != 0))):
        part.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(f"{place}/{name}")
    return L.feed_rows(first_entries(read_feed(v.spark, f"{place}/a", f"{place}/b")), "entry", "authors", "abstract")


@query("a8_json_export", "SELECT person_id, CASE WHEN person_id IS NULL THEN '{' ELSE '{\"person_id\":' || person_id || ',' END || '\"items\":[' || string_agg(CAST(to_json({'observation_id': observation_id, 'claim_type': claim_type, 'value': value}) AS VARCHAR), ',' ORDER BY observation_id) || ']}' AS document FROM observation GROUP BY person_id, CASE WHEN person_id IS NULL THEN observation_id END")
def json_export(v):
    """Rows of the nested documents, as the sink writes them."""
    return L.nested_documents(v.observation(), "person_id", ["observation_id", "claim_type", "value"], "observation_id").select("person_id", F.to_json(F.struct("person_id", "items")).alias("document"))


@query("a9_candidate_hosts", r"""SELECT DISTINCT host FROM raw WHERE host <> '' AND NOT EXISTS (SELECT 1 FROM (VALUES ('example.org'), ('src7.example.net')) b(d) WHERE host = d OR host LIKE '%.' || d)""",
    {"raw": r"""SELECT regexp_replace(lower(regexp_extract(u, '^[a-z]+://([^/:?#]*)', 1)), '^www\.', '') AS host FROM (SELECT url AS u FROM pages UNION ALL SELECT source_url FROM observation UNION ALL SELECT 'http://www.s' || s_suppkey || '.example.com/' FROM supplier)"""})
def candidate_hosts(v):
    blocked = v.spark.createDataFrame([("example.org",), ("src7.example.net",)], "host string")
    return L.not_blocked(union_of_hosts(v), blocked)


@query("i1_union_hosts", "SELECT DISTINCT host FROM raw WHERE host <> ''",
    {"raw": r"""SELECT regexp_replace(lower(regexp_extract(u, '^[a-z]+://([^/:?#]*)', 1)), '^www\.', '') AS host FROM (SELECT url AS u FROM pages UNION ALL SELECT source_url FROM observation UNION ALL SELECT 'http://www.s' || s_suppkey || '.example.com/' FROM supplier)"""})
def union_of_hosts(v):
    suppliers = v.table("supplier").select(F.format_string("www.s%d.example.com/", "s_suppkey").alias("url"))
    return L.hosts(v.table("pages"), "url").unionByName(L.hosts(v.observation(), "source_url")).unionByName(L.hosts(suppliers, "url")).distinct()


@query("a10_record_to_observations", """SELECT o_orderkey, 'price' AS claim_type, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS value, least(0.95, 0.35 + 0.6 * (o_orderkey % 100) / 100.0) AS confidence FROM orders
    UNION ALL SELECT o_orderkey, 'priority', o_orderpriority, CAST(0.9 AS DOUBLE) FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' UNION ALL SELECT o_orderkey, 'open', NULL, CAST(0.5 AS DOUBLE) FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT o_orderkey, 'milestone', o_orderstatus, CAST(0.8 AS DOUBLE) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000""")
def record_rows(v):
    high = F.least(F.lit(0.95), 0.35 + 0.6 * (F.col("o_orderkey") % 100) / 100.0)
    kinds = [
        ("price", F.lit(True), F.floor("o_totalprice").cast("long"), high), ("priority", F.col("o_orderpriority").rlike("^[12]"), F.col("o_orderpriority"), F.lit(0.9)),
        ("open", F.col("o_orderstatus") == "O", F.lit(None), F.lit(0.5)), ("milestone", (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000), F.col("o_orderstatus"), F.lit(0.8)),
    ]
    return L.narrow(v.table("orders"), kinds, ["o_orderkey"])


@query("a11_persist_priors", "SELECT artifact_type, n_cell, round(p, 9) AS p FROM (SELECT artifact_type, count(DISTINCT person_id) AS n_cell, count(DISTINCT person_id) / (SELECT count(DISTINCT person_id) FROM observation) AS p FROM observation GROUP BY 1) WHERE artifact_type NOT LIKE 'click%'")
def persist_priors(v):
    obs = v.observation()
    total = obs.agg(F.countDistinct("person_id").alias("n"))
    cells = obs.groupBy("artifact_type").agg(F.countDistinct("person_id").alias("n_cell")).crossJoin(F.broadcast(total)).withColumn("p", F.round(F.col("n_cell") / F.col("n"), 9))
    held = obs.filter("artifact_type LIKE 'click%'").select("artifact_type").distinct()
    return L.large_enough(cells, held, "artifact_type", "n").select("artifact_type", "n_cell", "p")
