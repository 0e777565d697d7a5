"""The corpus pipeline: quality filter, near-duplicate removal, repeated-passage removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.minhash import near_duplicates
from tidebook.llm.packing import packed
from tidebook.llm.quality import accepted
from tidebook.llm.runtime import written
from tidebook.llm.suffix_dedup import without_repeats
from tidebook.llm.vocab import file_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest doc_id. Rows of one doc_id with
    different texts go or stay by their own text's group."""
    surplus = near_duplicates(docs, text_hash=True).where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    mine = (docs["doc_id"] == surplus["doc_id"]) & (F.xxhash64(docs["text"]) == surplus["text_hash"])
    return docs.join(surplus, mine, "left_anti").select(docs.columns)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the later documents; a document of which nothing is left goes too."""
    cut = without_repeats(docs).where((F.col("n_removed") == 0) | (F.length("text") > 0))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, best-fit packed into sequences of 4096."""
    return packed(docs, file_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_removal),
    ("best_fit_packing", sequence_packing),
]

#: Trained weights, byte-level suffix arrays and BPE are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
