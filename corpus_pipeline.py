"""A corpus put through five stages: toxic documents go, one of each group of near copies stays, repeated passages are cut, documents with benchmark items go, and the rest is packed into sequences."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeframe.llm import queries
from tradeframe.llm.decontaminate import contaminated
from tradeframe.llm.ngram_jaccard import jaccard_components
from tradeframe.llm.packing import pack_documents
from tradeframe.llm.passages import cut_passages, repeated_passages
from tradeframe.llm.shared import remove, saved, scratch
from tradeframe.llm.toxicity import toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic: of a score of one half, which all have where there
    are no labels, or less. Of repeated ids all rows go if one is toxic; rows of null id stay; null and empty texts are
    scored as texts without known words."""
    scored = toxicity(docs, queries.table(spark, sf_dir, "labels"), held_out=None)
    rejected = scored.where("score > 0.5").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group that links of five-word Jaccard similarity 0.8 or more connect; of a document
    that links with none, itself. Ties don't occur, as ids tell documents apart: rows of one id stay or go together. Null and
    empty texts and rows of null id link with nothing and stay."""
    found = jaccard_components(docs, width=5, threshold=Fraction(8, 10))
    copies = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages that an earlier one, by id, has too are cut from their texts, and n_chars is that of what is
    left. Null and empty texts and rows of null id stay as they are; rows of one id are one document and keep what they
    share; of a passage in several documents the first keeps it."""
    passages = saved(repeated_passages(docs), "passages")
    cut = cut_passages(docs, passages)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items. Of repeated ids all rows go if one has an item; rows of null id, null texts and empty
    ones stay; without items all stay."""
    leaks = contaminated(docs, queries.table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens. Null texts are empty: a document of one end token. Repeated rows and
    rows of null id are packed as documents of their own."""
    return pack_documents(docs, queries.vocabulary())


#: Each takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can't express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the whole of documents."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
