"""K: the streaming jobs run over a file stream of events and read back as tables; K3's SQL knows the watermark."""

from pyspark.sql import functions as F

from palimpsest.operators.ranking import _path
from palimpsest.plans.registry import query
from palimpsest.plans.scans import HASHED, KEY
from palimpsest.sources.views import reliability
from palimpsest.streaming import jobs


class StreamViews:
    """The observation view over a stream of the events file."""

    def __init__(self, v):
        self.v = v

    def observation(self):
        from palimpsest.sources.views import Views

        spark, sf_dir = self.v.spark, self.v.sf_dir
        schema = self.v.table("events").schema
        source = Views(spark, sf_dir)
        source.table = lambda name: spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
        return source.observation()


FIRST = {"hashed": HASHED["hashed"], "first_rows": "SELECT observation_id, source_url, claim_type, value_hash FROM hashed WHERE source_url IS NULL UNION ALL SELECT min(observation_id), source_url, claim_type, value_hash FROM hashed WHERE source_url IS NOT NULL GROUP BY ALL"}


@query("k1_stream_append", "SELECT source_url, claim_type, value_hash, count(*) AS n FROM first_rows GROUP BY ALL", FIRST)
def append(v):
    from palimpsest.operators.ledger import with_digest

    rows = with_digest(StreamViews(v).observation(), "value_text").withColumn("observed_at", F.col("observed_at").cast("timestamp")).select("observation_id", *KEY, "observed_at")
    path = _path(v.table("region"))
    jobs.stream_append(rows, path, f"{path}-state", KEY, ["observation_id"]).awaitTermination()
    return v.spark.read.parquet(path).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def closed_volumes(v, width, slide=None):
    rows = StreamViews(v).observation().withColumn("at", F.col("observed_at").cast("timestamp"))
    path = _path(v.table("region"))
    jobs.stream_volume(rows, path, f"{path}-state", "channel_id", "at", width, slide).awaitTermination()
    return v.spark.read.schema("channel_id string, start timestamp, n long").parquet(path).select("channel_id", F.col("start").cast("long").alias("start_s"), "n")


#: Windows whose end the watermark has passed: a day before the latest row.
CLOSED = "SELECT channel_id, epoch_us(d) // 1000000 AS start_s, count(*) AS n FROM (SELECT channel_id, date_trunc('day', observed_at) - CAST(i AS INT) * INTERVAL 1 DAY AS d FROM observation, range(0, {0}) r(i)) WHERE d + INTERVAL {0} DAY <= (SELECT max(observed_at) FROM observation) - INTERVAL 1 DAY GROUP BY ALL"


@query("k2_stream_volume", CLOSED.format(1))
def volume(v):
    return closed_volumes(v, "1 day")


@query("k2_sliding_volume", CLOSED.format(30))
def sliding(v):
    return closed_volumes(v, "30 days", "1 day")


@query("k2_late_rows", """SELECT count(*) AS seen, count(*) FILTER (observed_at >= TIMESTAMP '2024-01-15' AND date_trunc('day', observed_at) + INTERVAL 1 DAY <= top - INTERVAL 1 DAY) AS written, count(*) FILTER (observed_at >= TIMESTAMP '2024-01-15' AND date_trunc('day', observed_at) + INTERVAL 1 DAY > top - INTERVAL 1 DAY) AS waiting, count(*) FILTER (observed_at < TIMESTAMP '2024-01-15') AS late FROM observation, (SELECT max(observed_at) AS top FROM observation)""")
def late(v):
    """The observations in two runs of one stream, the later half first: the earlier half comes when the watermark has passed it."""
    rows = v.observation().select("observation_id", "channel_id", F.col("observed_at").cast("timestamp").alias("at"))
    path = _path(v.table("region"))
    for early in (False, True):
        rows.filter((F.col("at") < "2024-01-15") == early).coalesce(1).write.mode("append").parquet(f"{path}/in")
        with jobs.kept_progress(v.spark, f"{path}/progress"):
            jobs.stream_volume(v.spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/state", "channel_id", "at", "1 day").awaitTermination()
    return jobs.late_rows(v.spark, f"{path}/progress", f"{path}/out", f"{path}/state")


CROSS = """SELECT person_id, epoch_us(arg_min(observed_at, (observed_at, observation_id))) AS triggered_us, round(arg_min(s, (observed_at, observation_id)), 6) AS total FROM (SELECT person_id, observed_at, observation_id, round(sum(weight) OVER (PARTITION BY person_id ORDER BY observed_at, observation_id ROWS UNBOUNDED PRECEDING), 6) AS s FROM observation JOIN reliability USING (source_class) WHERE person_id IS NOT NULL) WHERE s >= 12 GROUP BY 1"""


@query("k3_stream_trigger", CROSS)
def trigger(v):
    rows = v.observation().join(F.broadcast(reliability(v.spark)), "source_class")
    return jobs.crossings(rows, "person_id", "weight", 12.0, "observed_at", "observation_id").select("person_id", F.unix_micros(F.col("triggered_at").cast("timestamp")).alias("triggered_us"), "total")


#: What the stream can tell: crossings that the watermark, a day before the latest row in whole milliseconds, has passed.
PASSED = "epoch_us(observed_at) <= 1000 * (SELECT epoch_us(max(observed_at)) // 1000 - 86400000 FROM observation WHERE person_id IS NOT NULL)"


@query("k3_stream_trigger_state", CROSS.replace("WHERE person_id IS NOT NULL)", f"WHERE person_id IS NOT NULL AND {PASSED})"))
def trigger_state(v):
    """The stateful stream over the events file."""
    rows = StreamViews(v).observation().join(F.broadcast(reliability(v.spark)), "source_class").select("person_id", F.col("observed_at").cast("timestamp").alias("observed_at"), "observation_id", "weight")
    path = _path(v.table("region"))
    jobs.stream_trigger(rows, path, f"{path}-state", 12.0).awaitTermination()
    return v.spark.read.schema(jobs.TRIGGERS).parquet(path).select("person_id", F.unix_micros("triggered_at").alias("triggered_us"), "total")
