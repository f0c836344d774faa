"""Feeds of nested entries, as XML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is read of an entry; all else in it is skipped. Attributes have an underscore in front.
ENTRY = "id string, title string, summary string, published string, primary_category struct<_term:string>, category array<struct<_term:string>>, author array<struct<name:string,affiliation:string>>, _bad string"


def _clean(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def read_feed(spark: SparkSession, *paths: str, tag: str = "entry") -> DataFrame:
    """(entry, title, abstract, published, category, categories, authors, file, bad) of every entry of some files or folders.

    The schema is declared, so files are read once and namespaces play no part. entry is the last part of the id; white space is collapsed;
    authors are (name, affiliation), those without a name left out. An entry that isn't well formed, or a date that is none, ends no
    job: `bad` holds the entry as it stands, the date is null.
    """
    raw = spark.read.format("xml").schema(ENTRY).option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("ignoreNamespace", True).load(list(paths))
    authors = F.filter(F.transform("author", lambda a: F.struct(_clean(a["name"]).alias("name"), _clean(a["affiliation"]).alias("affiliation"))), lambda a: a["name"].isNotNull())
    terms = F.filter(F.transform("category", lambda c: _clean(c["_term"])), lambda c: c.isNotNull())
    return raw.select(
        F.regexp_replace(_clean(F.col("id")), "^.*/abs/", "").alias("entry"), _clean(F.col("title")).alias("title"), F.coalesce(_clean(F.col("summary")), F.lit("")).alias("abstract"), F.col("published").try_cast("timestamp").cast("timestamp_ntz").alias("published"),
        _clean(F.col("primary_category._term")).alias("category"), F.coalesce(terms, F.array().cast("array<string>")).alias("categories"), F.coalesce(authors, F.array().cast("array<struct<name:string,affiliation:string>>")).alias("authors"), F.col("_metadata.file_path").alias("file"), F.col("_bad").alias("bad"),
    )


def first_entries(feed: DataFrame) -> DataFrame:
    """The entries that can be observations: those with an id, a date and an author. Of a repeated id the one of the first file counts (then of the earliest date, then the least abstract)."""
    whole = feed.filter(F.col("bad").isNull() & F.col("entry").isNotNull() & F.col("published").isNotNull() & (F.size("authors") > 0))
    names = [c for c in whole.columns if c not in ("entry", "bad")]
    return whole.groupBy("entry").agg(F.min_by(F.struct(*names), F.struct("file", "published", "abstract", "title")).alias("_e")).select("entry", "_e.*")
