"""Corpus pipeline: quality, boilerplate lines, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of ``documents``. Where a stage changes texts, ``n_chars`` is counted anew. Null texts count as empty and are
no near duplicates of anything; null ids are kept by all stages but near_dedup, which keeps them where their texts
stay. Repeated rows are one group of near duplicates; ties go to the smallest id. Other columns are dropped by the
first stage, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import lines, neardup, packing, pii, quality
from cohortry.llm.common import saved, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Five-word shingles, similarity 0.8.
NEAR = {"size": 5, "percent": 80}


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_scores(docs, labels).where("good").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source.

    A group of near duplicates, as the next stage forms them, is one page of its source: else the lines that its
    copies share would pass for boilerplate, and nothing of the text would be left. A null id is a group of its own.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    groups = neardup.near_duplicates(docs, **NEAR).groupBy(F.col("doc_id").alias("id")).agg(F.min("component_id").alias("page"))
    return _counted(lines.drop_boilerplate_lines(docs, pages=saved(groups)))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    small_batches(spark)
    return neardup.drop_near_duplicates(docs, **NEAR).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return _counted(pii.redact(pii.find_pii(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, each with its place in a sequence of 4096."""
    small_batches(spark)
    import public_tokenizers

    pieces = packing.document_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packing.assign_sequences(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
#: A fitted classifier and greedy packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole of documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs)
    return docs
