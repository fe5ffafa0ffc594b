"""Registered queries of this package: name -> callable(spark, sf_dir) -> DataFrame.

Each reads its whole table and runs its operator with production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.llm import (collocations, decontaminate, jaccard, lexical, licenses, neighbours,
                           packing, pii, pivots, quality, recompression, toxicity, wordpiece)
from scoreline.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


BATCH_ROWS = 2000    # rows of whole texts that pass to a Python worker at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def site(docs: DataFrame) -> tuple[Column, Column]:
    """Host and path of a document: its source, and its language within the source."""
    return docs["source"], docs["lang"]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs, model, *site(docs))


FOLDS = 5


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), where=fold != 0)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=3, num=90, den=100,
                                   lower=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).withColumnRenamed("row", "doc_id")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), k=10,
                             is_query=F.col("vec_id") % 100 == 0)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), top=2000)


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(table(spark, sf_dir, "embeddings"), k=5,
                         is_query=F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_counts": op4_token_counts,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_packing": op6_packing,
    "op7_decontamination": op7_decontamination,
    "op8_neighbours": op8_neighbours,
    "op9_licenses": op9_licenses,
    "op10_pii": op10_pii,
    "op11_lexical_search": op11_lexical_search,
    "op12_collocations": op12_collocations,
    "op13_topk": op13_topk,
}
