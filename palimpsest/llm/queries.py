"""The thin queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import scratch, table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.simhash_dedup import simhash_components

    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.langid import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.pii import scan_pii

    return scan_pii(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.token_counts import count_tokens

    # a cluster names the lasting cache in this setting; each run without it fills one of its own
    cache = spark.conf.get("spark.palimpsest.token.cache", None) or scratch(spark, "token-cache")
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(), cache)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.negatives import hard_negatives, scored_rows

    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(scored_rows(rows.withColumn("label", moved)), F.col("vec_id") % 100 == 0)


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.chat import format_turns, read_back

    own = [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(turns.unionByName(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.periods import run_report, with_planted_runs

    return run_report(with_planted_runs(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash_near_dedup, op2_language_id, op3_pii_sanitisation, op4_token_counts, op5_suffix_dedup, op6_benchmark_decontamination, op7_license_scan, op8_document_fingerprints, op9_retrieval_packing, op10_secret_scan, op11_hard_negatives, op12_chat_formatting, op13_periodic_runs)}

ORACLES: dict[str, str] = {
    "op11_hard_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
            p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5""",
    "op12_chat_formatting": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(text) + len(regexp_extract_all(text, '[\[<]\\*((/?INST|/?ROLE|TEXT)\]|/?s>)')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE length(role) + len(regexp_extract_all(role, '[\[<]\\*((/?INST|/?ROLE|TEXT)\]|/?s>)')) + 19 END) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
}
