"""A corpus pipeline: each stage takes all documents that the one before kept.

Order: language ID, near duplicates, benchmark decontamination, secrets, packing. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import scratch, table
from palimpsest.llm.decontaminate import drop_contaminated
from palimpsest.llm.langid import held_out, keep_told, public_pieces, train
from palimpsest.llm.near_text import drop_near_duplicates
from palimpsest.llm.packing import pack_documents
from palimpsest.llm.queries import tokenizer_file
from palimpsest.llm.secret_scan import redact_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows without letters and those whose language stays open: null and empty texts go, each row is judged by its own text, whatever its id."""
    return keep_told(docs, train(docs, public_pieces(tokenizer_file("piece_bpe_32k.model")), ~held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share 0.8 or more of their five-word shingles, that of the least id: rows of one id and different texts are judged apart, null ids come last."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows whose text holds a benchmark item, whole or edited; null and empty texts stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with the secrets in its text replaced; null and empty texts stay as they are."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in their windows; a null or empty text is a document of the end id alone."""
    return pack_documents(docs, tokenizer_file())


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        path = scratch(spark, f"stage-{i}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    raise ValueError("no stages")
