"""Token counts through a digest cache.

A cache row is (content digest, tokenizer version digest, n_tokens), in a Parquet table of the
shared folder. Contents are joined to it by both digests; only distinct contents without a row are
encoded, and their counts are appended. The normal form of a content is its UTF-8 bytes, nulls as
empty: any further normalisation would change counts that have to be the tokenizer's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import byte_bpe, tokenizer_version
from palimpsest.llm.common import documents, meet

CACHE = "digest string, version string, n_tokens long"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table, or an empty one where nothing was ever written."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def _first_of_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Drops what this task has already passed on, so that a hot content leaves each task once."""
    seen: set[str] = set()
    for pdf in batches:
        fresh = [not (d in seen or seen.add(d)) for d in pdf["digest"]]
        yield pdf[fresh]


def _counts(tokenizer: str, version: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(tokenizer)
        for pdf in _first_of_each(batches):
            yield pd.DataFrame({"digest": pdf["digest"], "version": version, "n_tokens": [bpe.count(x) for x in pdf["text"]]})

    return run


def fill_cache(docs: DataFrame, tokenizer: str, cache_path: str) -> DataFrame:
    """Encodes the distinct contents of docs that the cache lacks, appends their counts, and returns the cache of this tokenizer version.

    A rerun after a loss adds no wrong rows: a count depends on its digests alone, and readers take one row a digest.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    held = read_cache(spark, cache_path).filter(F.col("version") == version)
    texts = documents(docs).select(F.sha2("text", 256).alias("digest"), "text")
    missing = texts.mapInPandas(_first_of_each, texts.schema).repartition("digest").join(held, "digest", "left_anti")
    missing.mapInPandas(_counts(tokenizer, version), CACHE).write.mode("append").parquet(cache_path)
    return read_cache(spark, cache_path).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs, repeated rows and null ids included.

    cache_path holds the cache from run to run: contents counted before are not encoded again. Null
    texts count as empty (0 bytes, 0 tokens). An empty table gives an empty result. Other columns of
    docs are ignored.
    """
    counts = fill_cache(docs, tokenizer, cache_path)
    keyed = documents(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest"))
    return meet(keyed, counts, ["digest"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
