"""Logical tables as StructTypes."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _ts, _d, _n = T.StringType(), T.TimestampType(), T.DoubleType(), T.LongType()


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


ENTITIES = _table(("id", _s, False), ("label", _s, False), ("entity_type", _s, False), ("properties", T.MapType(_s, _s), False), ("created_at", _ts, False), ("updated_at", _ts, False), ("confidence", _d, False), ("source_summary_id", _s, True))
RELATIONS = _table(("id", _s, False), ("subject_id", _s, False), ("predicate", _s, False), ("object_id", _s, False), ("properties", T.MapType(_s, _s), False), ("temporal_start", _ts, True), ("temporal_end", _ts, True), ("confidence", _d, False), ("source_summary_id", _s, True))
SUMMARIES = _table(("id", _s, False), ("tier", T.IntegerType(), False), ("content", _s, False), ("token_count", _n, False), ("created_at", _ts, False), ("updated_at", _ts, False), ("session_id", _s, True), ("source_ids", T.ArrayType(_s), False), ("metadata", _s, False))
VECTORS = _table(("id", _s, False), ("source_id", _s, False), ("source_type", _s, False), ("content_preview", _s, False), ("embedding", T.ArrayType(T.FloatType()), False), ("dimensions", T.IntegerType(), False), ("metadata", _s, False), ("created_at", _ts, False), ("confidence", _d, False))
ACCESS_LOG = _table(("memory_id", _s, False), ("memory_type", _s, False), ("accessed_at", _ts, False))
SESSIONS = _table(("id", _s, False), ("started_at", _ts, False), ("ended_at", _ts, True), ("metadata", _s, False))
BUFFER = _table(("id", _s, False), ("session_id", _s, True), ("seq", _n, False), ("content", _s, False), ("tokens", _n, False), ("timestamp", _ts, False))

TABLES = {"entities": ENTITIES, "relations": RELATIONS, "summaries": SUMMARIES, "vectors": VECTORS, "access_log": ACCESS_LOG, "sessions": SESSIONS, "buffer": BUFFER}
