"""The logical tables as views of the bundled parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import estimate_tokens

#: Time zero of derived timestamps, and the moment at which ages are taken.
BASE, AS_OF = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minutes(n: str):
    return F.timestamp_seconds(F.unix_timestamp(F.lit(BASE).cast("timestamp")) + F.col(n) * 60)


def buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier 0: conversations' turns."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("content"), estimate_tokens(F.col("text")).alias("tokens"), _minutes("turn").alias("timestamp"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as summaries of the session that is their source."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"), (F.col("doc_id") % 4).cast("int").alias("tier"), F.col("text").alias("content"), F.ceil(F.col("n_chars") / 4).cast("long").alias("token_count"), _minutes("doc_id").alias("created_at"), F.col("source").alias("session_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("seq"), F.concat(F.lit("type"), F.col("label").cast("string")).alias("source_type"), F.col("embedding"), _minutes("vec_id").alias("created_at"), (F.lit(1.0) - (F.col("vec_id") % 10) / F.lit(20.0)).alias("confidence"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("memory_id"), F.col("event_type").alias("memory_type"), F.col("ts").cast("timestamp").alias("accessed_at"))


def relation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in the order in which they are stored."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject_id"), F.col("event_type").alias("predicate"), F.get_json_object("props", "$.k").alias("object_id"), F.col("ts").cast("timestamp").alias("temporal_start"), F.lit(1.0).alias("confidence"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("ended_at"))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities and active relations: customers and suppliers located_in nations, nations part_of regions."""
    tables = {"c": ("customer", "c_custkey", "c_name", "customer"), "s": ("supplier", "s_suppkey", "s_name", "supplier"), "n": ("nation", "n_nationkey", "n_name", "nation"), "r": ("region", "r_regionkey", "r_name", "region")}
    links = (("c", "c_nationkey", "located_in", "n"), ("s", "s_nationkey", "located_in", "n"), ("n", "n_regionkey", "part_of", "r"))
    entities = relations = None
    for p, (name, key, label, kind) in tables.items():
        t = read(spark, sf_dir, name)
        e = t.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.col(label).alias("label"), F.lit(kind).alias("entity_type"), (F.lit(1.0) - (F.col(key) % 5) / F.lit(10.0)).alias("confidence"), _minutes(key).alias("updated_at"))
        entities = e if entities is None else entities.unionByName(e)
    for p, target, predicate, q in links:
        name, key, _, _ = tables[p]
        t = read(spark, sf_dir, name)
        r = t.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("subject_id"), F.lit(predicate).alias("predicate"), F.concat(F.lit(q), F.col(target).cast("string")).alias("object_id"), (F.lit(1.0) - (F.col(key) % 4) / F.lit(10.0)).alias("confidence"), F.lit(None).cast("timestamp").alias("temporal_end"))
        relations = r if relations is None else relations.unionByName(r)
    return entities, relations
