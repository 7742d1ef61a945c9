"""The corpus pipeline: language identification, line dedup, near-dedup, personal data, packing.

Each stage takes the documents that its predecessor kept, and its decisions take effect. ``run`` writes every stage's
result as a table beside the checkpoints and reads it again, so a lost executor costs no earlier stage.
"""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_explore.llm import byte_gru, line_dedup, minhash, packing, pii_crf
from spark_explore.sizing import checkpoint_dir


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language."""
    return byte_gru.reject_unknown(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that nearly repeat an earlier line, and the documents of which no words are left."""
    return _recounted(line_dedup.dedup_lines(docs)).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates; documents without an id stay."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"))
    return rows.join(gone, "id", "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts."""
    return _recounted(pii_crf.mask(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token sequences of the documents."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", pack),
]

# SQL can express neither the models nor the tokenizers; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
