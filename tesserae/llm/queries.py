"""One query for each operator of this folder, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.sources.workspace import shared_dir

from . import bpe, decontaminate, language_id, line_dedup, near_dup, pii, substring_dedup, token_store, topk, url_filter
from .common import read_table


def _vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; all operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(read_table(spark, sf_dir, "documents"), window=20)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return language_id.predict(documents, language_id.train(documents))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    token_store.write(read_table(spark, sf_dir, "documents"), path, _vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_store.document_index(spark, path)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), url_filter.RULES, url_filter.labelled_urls(spark))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(read_table(spark, sf_dir, "documents"), percent=85)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("longest_match")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_line_dedup, op4_token_store, op5_pii, op6_url_filter, op7_near_dup, op8_bpe, op9_decontamination, op10_topk)}

ORACLES: dict[str, str] = {"op1_substring_dedup": substring_dedup.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op7_near_dup": near_dup.ORACLE, "op9_decontamination": decontaminate.ORACLE, "op10_topk": topk.ORACLE}
