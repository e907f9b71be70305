"""Getters over the logical tables; ties in an order are broken by id (or seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import fold_ascii


def by_id(df: DataFrame, key: str, column: str = "id") -> DataFrame:
    return df.where(F.col(column) == key)


def entity_by_label(entities: DataFrame, label: str) -> DataFrame:
    """The first entity of a label, ASCII letters compared without case."""
    return entities.where(fold_ascii(F.col("label")) == fold_ascii(F.lit(label))).orderBy("created_at" if "created_at" in entities.columns else "updated_at", "id").limit(1)


def search_entities(entities: DataFrame, text: str) -> DataFrame:
    """Labels that contain the text without case; % and _ in it are wildcards, a backslash is not special."""
    return entities.where(F.like(fold_ascii(F.col("label")), fold_ascii(F.lit(f"%{text}%")), F.lit("\u0001"))).orderBy(F.desc("confidence"), "id")


def all_entities(entities: DataFrame) -> DataFrame:
    return entities.orderBy(F.desc("updated_at"), "id")


def active(relations: DataFrame) -> DataFrame:
    return relations.where(F.col("temporal_end").isNull())


def relations_by(relations: DataFrame, column: str, value: str) -> DataFrame:
    """Active relations of a subject_id, an object_id, or a predicate (without ASCII case)."""
    same = fold_ascii(F.col(column)) == fold_ascii(F.lit(value)) if column == "predicate" else F.col(column) == value
    return active(relations).where(same).orderBy(F.desc("confidence"), "subject_id", "object_id")


def summaries_by_tier(summaries: DataFrame, tier: int, session: str | None = None, exclude: str | None = None) -> DataFrame:
    """A tier, newest first; of one session, or of all but one (rows without a session stay)."""
    out = summaries.where(F.col("tier") == tier)
    if session is not None:
        out = out.where(F.col("session_id") == session)
    if exclude is not None:
        out = out.where(~F.col("session_id").eqNullSafe(exclude))
    return out.orderBy(F.desc("created_at"), "id")


def summaries_by_session(summaries: DataFrame, session: str) -> DataFrame:
    return summaries.where(F.col("session_id") == session).orderBy(F.desc("created_at"), "id")


def vectors_by_type(vectors: DataFrame, source_type: str | None = None) -> DataFrame:
    out = vectors if source_type is None else vectors.where(F.col("source_type") == source_type)
    return out.orderBy(F.desc("created_at"), "id")


def recent_sessions(sessions: DataFrame, limit: int = 10) -> DataFrame:
    if limit < 0:
        raise ValueError("the limit can't be negative")
    return sessions.orderBy(F.desc("started_at"), F.desc("seq")).limit(limit)


def active_session(sessions: DataFrame) -> DataFrame:
    """The newest session that hasn't ended."""
    return sessions.where(F.col("ended_at").isNull()).orderBy(F.desc("started_at"), F.desc("seq")).limit(1)


# What is shown where nothing is stored.
NO_CORE, NO_WORKING = "No core memories stored yet.", "No working memory entries for this session."


def working_memory(buffer: DataFrame, session: str | None = None) -> DataFrame:
    """A session's entries, or all; by session and order of arrival."""
    own = buffer if session is None else buffer.where(F.col("session_id") == session)
    return own.orderBy("session_id", "seq")


def working_count(buffer: DataFrame, session: str | None = None) -> DataFrame:
    own = buffer if session is None else buffer.where(F.col("session_id") == session)
    return own.agg(F.count(F.lit(1)).alias("n"))


def core_memory(summaries: DataFrame) -> DataFrame:
    """One row: the contents of tier 3, newest first, or what is shown without any."""
    lines = summaries.where("tier = 3").agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("o"), "id", "content"))).alias("xs"))
    return lines.select(F.when(F.size("xs") == 0, NO_CORE).otherwise(F.array_join(F.transform("xs", lambda x: x["content"]), "\n")).alias("text"))
