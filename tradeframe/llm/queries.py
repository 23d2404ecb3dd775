"""The queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradeframe.llm import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The public byte-level vocabulary; its package must be installed on all machines."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fractions import Fraction

    from tradeframe.llm.ngram_jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), width=3, threshold=Fraction(9, 10))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradeframe.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradeframe.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradeframe.llm.shared import scratch
    from tradeframe.llm.token_files import read_tokens, write_tokens

    path = scratch(spark, "tokens")
    manifest = write_tokens(table(spark, sf_dir, "documents"), path, vocabulary())
    return read_tokens(spark, path, manifest)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradeframe.llm.lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradeframe.llm.warc import derivative_records, responses

    return derivative_records(responses(table(spark, sf_dir, "pages"))).withColumnRenamed("page", "page_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradeframe.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradeframe.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradeframe.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradeframe.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradeframe.llm.licenses import document_licenses

    return document_licenses(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradeframe.llm.turn_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradeframe.llm.merkle import document_proofs

    return document_proofs(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_fingerprints": op2_fingerprints,
    "op3_token_counts": op3_token_counts,
    "op4_token_files": op4_token_files,
    "op5_lm_scores": op5_lm_scores,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_license_scan": op11_license_scan,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: The other queries are beyond SQL, and are tested against brute force.
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
