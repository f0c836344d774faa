"""Shared folders, tables and small helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more rows than this, and with over one in MOST_HOT of all rows, are dealt out in blocks.
HOT = 256
MOST_HOT = 10_000
#: Tables of so many small rows at most are sent to every task; larger ones are joined by a shuffle.
SENT = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own where it is unset and all tasks run in this process."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """df written once to the shared folder and read again, and its path: for what is removed once it is used up."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written once to the shared folder and read again: later stages start from files that outlive executors."""
    return held(df, name)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch paths on whatever file system holds them."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside send Python so many rows at a time at most: texts and sets of a batch stay small beside an executor's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def plain_text(docs: DataFrame) -> Column:
    """The text of docs as a string, null as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) alone, so that extra or clashing columns never reach an operator."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def wrapped(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs as one struct column `row`, beside columns of our own: no name of the caller's can clash with these. select("row.*") gives docs back."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def spread(rows: int, each: int) -> int:
    """Number of partitions that hold `each` rows on average."""
    return max(1, -(-rows // each))


def sent(df: DataFrame) -> DataFrame:
    """df, marked to be sent to every task if it has SENT rows at most; it should be read from files."""
    return F.broadcast(df) if df.count() <= SENT else df


def meet(rows: DataFrame, keyed: DataFrame, on: list[str], salt: Column | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """rows joined with keyed, which has one row for each key.

    The rows of a hot key (over HOT rows and one in MOST_HOT of all) are dealt out in blocks, and its row
    of keyed is given to each block. There are fewer than MOST_HOT hot keys, whatever the tables' size, so
    these alone are sent to all tasks. salt tells how the rows of a key are dealt; without it they are dealt by their order,
    so rows should then be read from files. sizes, if the caller has them: the keys with _rows, read from files.
    """
    if sizes is None:
        sizes = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
        total = rows.select(F.lit(1)).count()
    else:
        total = sizes.agg(F.sum("_rows")).first()[0] or 0
    bound = max(HOT, total // MOST_HOT)
    hot = cut(sizes.filter(F.col("_rows") > bound).select(*on, F.ceil(F.col("_rows") / bound).alias("_blocks")), "hot-keys")
    if hot.isEmpty():
        return rows.join(keyed, on)
    dealt = rows.withColumn("_nth", F.monotonically_increasing_id() if salt is None else salt).join(F.broadcast(hot), on, "left")
    dealt = dealt.withColumn("_block", F.when(F.col("_blocks").isNull(), 0).otherwise(F.pmod("_nth", "_blocks"))).drop("_nth", "_blocks")
    given = keyed.join(F.broadcast(hot), on, "left").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_blocks", F.lit(1)) - 1))).drop("_blocks")
    return dealt.join(given, [*on, "_block"]).drop("_block")
