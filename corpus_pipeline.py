"""Corpus pipeline: quality -> near duplicates -> decontamination -> personal data -> packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes every stage's result as Parquet in the cluster's
shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoreline.llm import decontaminate, jaccard, packing, pii, quality
from scoreline.llm.queries import site, table, tokenizer_path
from scoreline.llm.tables import Tables

SHINGLE, NUM, DEN = 5, 80, 100     # near duplicates: five words, similarity of 0.8 or more


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, *site(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return jaccard.keep_one(docs, SHINGLE, NUM, DEN)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the new text."""
    return pii.mask(docs, size_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in packed sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal),
    ("packing", pack),
]

# trained model and tokenizer: not SQL
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    tables = Tables(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    done: tuple[DataFrame, ...] = ()
    for _, stage in STAGES:
        docs = tables.put(stage(spark, docs, sf_dir), *done)
        done = (docs,)
    return docs
