"""Counts, access statistics, status and confidence decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.scans import active


def tier_counts(summaries: DataFrame) -> DataFrame:
    """(tier, n, tokens) for tiers 0 to 3 at least, and any others there are."""
    counted = summaries.groupBy(F.col("tier").cast("long").alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"))
    dense = summaries.sparkSession.range(4).withColumnRenamed("id", "tier")
    return dense.join(counted, "tier", "full").select("tier", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def total_tokens(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"))


def access_frequency(access_log: DataFrame) -> DataFrame:
    return access_log.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))


def top_accessed(access_log: DataFrame, limit: int = 20) -> DataFrame:
    """The most accessed ids; ties to the smaller id."""
    return access_frequency(access_log).orderBy(F.desc("n"), "memory_id").limit(limit)


def status(buffer: DataFrame, summaries: DataFrame, entities: DataFrame, relations: DataFrame, vectors: DataFrame, session: str | None = None) -> DataFrame:
    """One row: entries and tokens of all tiers (the buffer of one session, or all), graph and vector counts, total tokens."""
    own = buffer if session is None else buffer.where(F.col("session_id") == session)
    t0 = own.agg(F.count(F.lit(1)).alias("tier0_count"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tier0_tokens"))
    tiers = summaries.agg(*[x for t in (1, 2, 3) for x in (F.count_if(F.col("tier") == t).alias(f"tier{t}_count"), F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("token_count"))), F.lit(0)).cast("long").alias(f"tier{t}_tokens"))])
    out = t0.crossJoin(tiers).crossJoin(entities.agg(F.count(F.lit(1)).alias("entities"))).crossJoin(active(relations).agg(F.count(F.lit(1)).alias("relations"))).crossJoin(vectors.agg(F.count(F.lit(1)).alias("vectors")))  # single rows
    return out.withColumn("total_tokens", F.col("tier0_tokens") + F.col("tier1_tokens") + F.col("tier2_tokens") + F.col("tier3_tokens"))


def database_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def decayed(confidence: Column, rate: float = 0.01, rounds: int = 1) -> Column:
    """Less by the rate, while above 0.1, as often as there are rounds."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), confidence.cast("double"), lambda c, _: F.when(c > 0.1, c * (1 - rate)).otherwise(c)) if rounds else confidence


def apply_decay(entities: DataFrame, relations: DataFrame, vectors: DataFrame, rate: float = 0.01) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, active relations and vectors, each above 0.1 less sure by the rate; closed relations stay as they are."""
    less = decayed(F.col("confidence"), rate)
    open_only = F.when(F.col("temporal_end").isNull(), less).otherwise(F.col("confidence"))
    return entities.withColumn("confidence", less), relations.withColumn("confidence", open_only), vectors.withColumn("confidence", less)


def status_text(status_row: DataFrame, session: str, started_at: str) -> DataFrame:
    tiers = [("0", "Working"), ("1", "Session"), ("2", "Epoch"), ("3", "Core")]
    lines = [F.lit("=== Memory Status ==="), F.lit(f"Session: {session[:8]}... (started {started_at})" if session else "Session: No active session — call session_start first!"), F.lit("")]
    lines += [F.format_string(f"{f'Tier {t} ({name}):':<19}%d entries, ~%d tokens", f"tier{t}_count", f"tier{t}_tokens") for t, name in tiers]
    lines += [F.format_string("Knowledge Graph:   %d entities, %d relations", "entities", "relations"), F.format_string("Vector Store:      %d vectors", "vectors"), F.format_string("Total Tokens:      ~%d", "total_tokens")]
    return status_row.select(F.concat_ws("\n", *lines).alias("text"))


def empty_like(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([], df.schema)
