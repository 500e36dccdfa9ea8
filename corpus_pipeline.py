"""The corpus pipeline: from raw documents to packed training sequences.

Every stage reads all that its predecessor kept, as Parquet, and all but the
last return the columns of ``documents``.  Results are whole: nothing but what
a stage's own decision rejects is left out.  Ids may be null or shared by many
rows, so rows are known by their place in the files that a stage reads, and
its decisions, the rows to go, are joined back by that.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import exact_dedup, packing, pii, quality, simhash
from pagemill.llm.common import anti_join, small_batches
from pagemill.session import written

ORACLE_SQL = None  # a fitted classifier, fingerprints and packing are no SQL; tests hold the stages against brute force


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that no column has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key for each row, and the key's name.

    The key is the file and the place in it, the same in every scan, so
    nothing need be written.  Rows that come from no files are written first.
    """
    row = _free(docs, "_row")
    try:
        place = docs.select(F.xxhash64("_metadata.file_path").alias("file"), "_metadata.row_index", F.col("_metadata.file_path").alias("path"))
    except AnalysisException:
        return written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row
    files, hashes = place.select("path", "file").distinct().agg(F.count(F.lit(1)), F.count_distinct("file")).first()
    if files != hashes:
        return written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row
    return docs.withColumn(row, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))), row


def _without(numbered: DataFrame, row: str, rejected: DataFrame) -> DataFrame:
    """The documents that are not among ``rejected``, with their own columns."""
    return anti_join(numbered, written(rejected.select(row), "pipeline-rejected"), row).drop(row)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer keeps (operator 7), each row by its own text."""
    numbered, row = _numbered(docs)
    with small_batches(spark):
        return _without(numbered, row, quality.quality_scores(numbered, row_col=row).filter("NOT kept"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (operator 9, where a null id counts as smallest)."""
    numbered, row = _numbered(docs)
    key = _free(numbered, "_key")
    keyed = numbered.select("text", F.struct("doc_id", row).alias(key))
    return _without(numbered, row, exact_dedup.exact_duplicates(keyed, key).filter("NOT kept").select(F.col(key)[row].alias(row)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row with the smallest id (operator 10), and one with a null id only where there is no other."""
    numbered, row = _numbered(docs)
    key = _free(numbered, "_key")
    keyed = numbered.select("text", F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", row).alias(key))
    with small_batches(spark):
        groups = simhash.near_duplicates(keyed, key)
        return _without(numbered, row, groups.filter(F.col(key)[row] != F.col("component_id")[row]).select(F.col(key)[row].alias(row)))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and ``n_chars`` of the new text (operator 1)."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens (operator 4)."""
    with small_batches(spark):
        return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", drop_low_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("pii", mask_private), ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each one returns is written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
