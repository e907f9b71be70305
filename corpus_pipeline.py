"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's result as Parquet in
the shared folder and reads it again for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import bpe, decontaminate, language_id, line_dedup, near_dup
from tesserae.llm.common import read_table, shared_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the boilerplate lines of their source; n_chars follows."""
    from pyspark.sql import functions as F

    cleaned = line_dedup.clean(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return near_dup.deduplicate(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, and digests of them and of the text that they decode to."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", identify_language), ("line_dedup", drop_boilerplate_lines), ("near_dup", drop_near_duplicates), ("decontamination", drop_contaminated), ("bpe", encode)]

#: The classifier, and the tokenizer, are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(spark, stage(spark, docs, sf_dir), name)
    return docs
