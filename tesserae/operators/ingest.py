"""Ingest: defaults, quality gate, and the routing of memory types to tiers, graph and vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import estimate_tokens, infer_predicate, quality, word_count

# Tier of each type's row; other types store nothing.
TIERS = {"core": 3, "fact": 1, "preference": 2, "event": 0, "summary": 1}


@dataclass
class Stored:
    summaries: DataFrame  # id, seq, tier, content, token_count, session_id, entities
    buffer: DataFrame  # id, seq, session_id, content, tokens
    entities: DataFrame  # seq, label, entity_type, confidence: a log for graph.entity_state
    relations: DataFrame  # seq, subject, predicate, object, confidence: by label
    vectors: DataFrame  # source_id, source_type, confidence, content
    results: DataFrame  # id, quality, tier, facts_stored


def place(n: Column, seq: Column | None = None) -> Column:
    """The order of what a request stores: by request, then within it, however much it stores."""
    return F.struct((F.col("seq") if seq is None else seq).cast("long").alias("seq"), n.cast("long").alias("n"))


def gate(requests: DataFrame) -> DataFrame:
    """Defaults for what's missing, and the quality class; empty content is rejected too."""
    filled = requests.withColumns({"memory_type": F.coalesce("memory_type", F.lit("event")), "confidence": F.coalesce("confidence", F.lit(1.0)), "entities": F.coalesce("entities", F.array().cast("array<string>"))})
    return filled.withColumns({"n_words": word_count(F.coalesce("content", F.lit(""))), "quality": F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "rejected").otherwise(quality(F.col("content")))})


def store(requests: DataFrame) -> Stored:
    """requests: id, seq (order), session_id, content, memory_type, confidence, entities."""
    ok = gate(requests)
    taken = ok.where("quality != 'rejected'").withColumns({"tier": F.coalesce(*[F.when(F.col("memory_type") == k, F.lit(v)) for k, v in TIERS.items()]), "tokens": estimate_tokens(F.col("content"))})
    routed = taken.where("tier is not null")
    rows = routed.where("tier > 0").select("id", "seq", "tier", "content", F.col("tokens").alias("token_count"), "session_id", "entities")
    buffer = routed.where("tier = 0").select("id", "seq", "session_id", "content", "tokens")
    named = routed.where(F.col("memory_type").isin("fact", "preference", "event")).select("seq", "memory_type", "confidence", F.posexplode("entities").alias("n", "label"))
    unknown = named.where("memory_type != 'preference'").select(place(F.col("n")).alias("seq"), "label", F.lit("unknown").alias("entity_type"), "confidence")
    user = routed.where("memory_type = 'preference'").select(place(F.lit(0)).alias("seq"), F.lit("User").alias("label"), F.lit("person").alias("entity_type"), F.lit(1.0).alias("confidence"))
    liked = named.where("memory_type = 'preference'").select(place(F.col("n") + 1).alias("seq"), "label", F.lit("unknown").alias("entity_type"), "confidence")
    fact = routed.where((F.col("memory_type") == "fact") & (F.size("entities") >= 2)).select("seq", "confidence", F.get("entities", F.lit(0)).alias("subject"), infer_predicate(F.col("content")).alias("predicate"), F.posexplode(F.slice("entities", 2, F.greatest(F.size("entities") - 1, F.lit(0)))).alias("n", "object"))
    prefers = routed.where("memory_type = 'preference'").select("seq", "confidence", F.lit("User").alias("subject"), F.lit("prefers").alias("predicate"), F.posexplode("entities").alias("n", "object"))
    relations = fact.unionByName(prefers).select(place(F.col("n")).alias("seq"), "subject", "predicate", "object", "confidence")
    vectors = routed.select(F.col("id").alias("source_id"), F.col("memory_type").alias("source_type"), "confidence", "content")
    facts = F.when((F.col("memory_type") == "fact") & (F.size("entities") >= 2), F.size("entities") - 1).when(F.col("memory_type") == "preference", F.size("entities")).otherwise(0)
    results = ok.select("id", "quality", F.when(F.col("quality") != "rejected", F.coalesce(*[F.when(F.col("memory_type") == k, F.lit(v)) for k, v in TIERS.items()], F.lit(0))).cast("long").alias("tier"), F.when(F.col("quality") != "rejected", facts).otherwise(0).cast("long").alias("facts_stored"))
    return Stored(rows, buffer, unknown.unionByName(user).unionByName(liked), relations, vectors, results)
