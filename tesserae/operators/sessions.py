"""Session lifecycle: start, end, information, isolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.compression import archive


def session_id(as_of: str, previous: str | None = None) -> str:
    """Milliseconds and a digest; the same call gives the same id."""
    import datetime
    import hashlib

    at = datetime.datetime.fromisoformat(as_of).replace(tzinfo=datetime.timezone.utc)
    return f"{int(at.timestamp() * 1000)}-{hashlib.sha256(f'{as_of}|{previous}'.encode()).hexdigest()[:32]}"


def start(spark: SparkSession, sessions: DataFrame, buffer: DataFrame, as_of: str, current: str | None = None) -> tuple[str, DataFrame, DataFrame, DataFrame]:
    """New id; sessions with the current one ended and the new one begun; archive summaries; the emptied buffer."""
    new = session_id(as_of, current)
    ended = end(sessions, current, as_of) if current else sessions
    row = spark.range(1).select(F.lit(new).alias("id"), F.lit(as_of).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"), F.to_json(F.struct(F.lit(current).alias("previousSessionId"))).alias("metadata"))
    archived = archive(buffer.where(F.col("session_id") == current)) if current else archive(buffer.limit(0))
    return new, ended.unionByName(row, allowMissingColumns=True), archived, buffer.limit(0)


def end(sessions: DataFrame, session: str, as_of: str) -> DataFrame:
    return sessions.withColumn("ended_at", F.when(F.col("id") == session, F.lit(as_of).cast("timestamp")).otherwise(F.col("ended_at")))


def info(sessions: DataFrame, session: str) -> DataFrame:
    """id, started_at, is_active; no row if there's no such session."""
    return sessions.where(F.col("id") == session).select("id", "started_at", F.col("ended_at").isNull().alias("is_active"))


def without_session(buffer: DataFrame, session: str | None = None) -> DataFrame:
    """The buffer without a session's entries, or empty."""
    return buffer.limit(0) if session is None else buffer.where(~F.col("session_id").eqNullSafe(session))
