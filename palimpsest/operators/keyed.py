"""An append-only ledger with an index of its keys, so that a batch reads the index's buckets it falls into and never the ledger.

    <path>            the ledger, Parquet, partitioned by month
    <path>-keys       the index: digests of the keys held, partitioned by bucket
    <path>-pending    batches on their way: each is written here first, then to the ledger, then to the index

One writer at a time. A writer that dies leaves its batch pending; the next one finishes it before it begins:
only then are ledger rows read, those of that batch in its months.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 256


class Folder:
    """A path on whatever file system holds it."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def delete(self) -> None:
        self._fs.delete(self._path, True)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path)) if self.exists() else []


def digest(key: list[str]) -> Column:
    """128 bits of the key's parts, each with its length, so that no two keys are written alike; null if a part is null."""
    whole = F.concat(*[F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in key])
    return F.substring(F.sha2(whole, 256), 1, 32)


class KeyedLedger:
    """Appends batches whose keys aren't held yet: of a batch's rows of one key the first by `order` counts; a key with a null part is equal to none."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str], clock: str = "observed_at", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.clock, self.buckets = spark, path, key, order, clock, buckets
        self.index, self.pending = f"{path}-keys", f"{path}-pending"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("_digest"), F.lit(self.buckets)).cast("int")

    def _held(self, touched: list[int]) -> DataFrame:
        """The index's digests in some buckets: other buckets' files aren't opened."""
        schema = "_digest string, _bucket int"
        if not Folder(self.spark, self.index).exists():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.index).filter(F.col("_bucket").isin(touched) if touched else F.lit(False))

    def new_rows(self, batch: DataFrame) -> DataFrame:
        """The rows of the batch that the ledger lets in, with _digest and _bucket (null where a key has a null part)."""
        keyed = batch.withColumn("_digest", digest(self.key))
        names = batch.columns
        whole = keyed.filter(F.col("_digest").isNotNull())
        first = whole.groupBy("_digest").agg(F.min_by(F.struct(*names), F.struct(*self.order)).alias("_r")).select("_r.*", "_digest").withColumn("_bucket", self._bucket())
        touched = [r["_bucket"] for r in whole.select(self._bucket().alias("_bucket")).distinct().collect()]  # as many as there are buckets, at most
        fresh = first.join(self._held(touched), ["_bucket", "_digest"], "left_anti")
        return fresh.select(*names, "_digest", "_bucket").unionByName(keyed.filter(F.col("_digest").isNull()).withColumn("_bucket", F.lit(None).cast("int")))

    def append(self, batch: DataFrame) -> None:
        """Writes the batch's new rows; offering rows again changes nothing, nor does dying at any point and offering them again."""
        self.recover()
        self._finish(self._stage(batch), begun=False)

    def recover(self) -> None:
        """Finishes what an earlier writer left pending. A batch that was written whole is brought into the ledger, then into the index, less what is there; one that wasn't goes: nothing of it has left its folder."""
        for name in Folder(self.spark, self.pending).names():
            self._finish(name, begun=True)

    def rows(self) -> DataFrame:
        """The ledger's rows; batch names the batch that brought them."""
        return self.spark.read.parquet(self.path)

    def _stage(self, batch: DataFrame) -> str:
        name = uuid.uuid4().hex
        self.new_rows(batch).withColumn("month", F.date_format(self.clock, "yyyy-MM")).withColumn("batch", F.lit(name)).write.parquet(f"{self.pending}/{name}")
        return name

    def _finish(self, name: str, begun: bool) -> None:
        place = f"{self.pending}/{name}"
        if Folder(self.spark, f"{place}/_SUCCESS").exists():
            rows = self.spark.read.parquet(place)
            self._to_ledger(rows, name, begun)
            keys = rows.filter(F.col("_digest").isNotNull()).select("_digest", "_bucket")
            keys.repartition("_bucket").write.mode("append").partitionBy("_bucket").parquet(self.index)  # a digest that stands twice does no harm
        Folder(self.spark, place).delete()

    def _to_ledger(self, rows: DataFrame, name: str, begun: bool) -> None:
        told = rows.drop("_digest", "_bucket")
        if begun and Folder(self.spark, self.path).exists():
            months = [r["month"] for r in rows.select("month").distinct().collect()]
            there = self.rows().filter(F.col("month").isin(months) & (F.col("batch") == name)).select(*told.columns)
            line = F.sha2(F.to_json(F.struct(*told.columns)), 256)
            numbered = lambda df: df.withColumn("_line", line).withColumn("_nth", F.row_number().over(Window.partitionBy("_line").orderBy("_line")))
            told = numbered(told).join(numbered(there).select("_line", "_nth"), ["_line", "_nth"], "left_anti").drop("_line", "_nth")
        told.write.mode("append").partitionBy("month").parquet(self.path)
