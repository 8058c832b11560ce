"""The corpus pipeline: each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, line_dedup, near_copies, packing, toxicity
from tallyspark.llm.common import scratch, shared_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier chain, fitted on the labelled ones among them, finds toxic."""
    return toxicity.clean(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that at least three documents hold, save in the document of the largest id; n_chars follows the text. Documents left without text stay."""
    done = line_dedup.drop_repeated_lines(docs.select(COLUMNS))
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (similarity of five-word shingles 0.8 or more): that of the smallest doc_id. Rows that repeat a doc_id are judged each by its text; rows without one stay."""
    return near_copies.one_of_each(docs.select(COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", without_toxic), ("line dedup", dedup_lines), ("SimHash near-dedup", near_dedup), ("decontamination", decontaminated), ("packing", packed)]
#: Neither XXH64 fingerprints nor tokenizer ids can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
