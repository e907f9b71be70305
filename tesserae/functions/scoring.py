"""Column functions for ranking and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.config import DEFAULTS

#: Hours after which recency has fallen to 1/e.
RECENCY_HOURS = 168
# Weight of a candidate's source; others have OTHER.
PRIORITIES = {"core": 1.0, "working": 0.95, "current_session": 0.9, "graph": 0.8, "long_term": 0.65, "past_sessions": 0.5, "vector": 0.4}
OTHER = 0.3


def recency(at: Column, as_of: Column) -> Column:
    """exp(-age in hours / 168); beyond 1 for the future."""
    return F.exp(-((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(3.6e9)) / F.lit(float(RECENCY_HOURS)))


def source_priority(source: Column) -> Column:
    first, *rest = PRIORITIES.items()
    return reduce(lambda c, x: c.when(source == x[0], x[1]), rest, F.when(source == first[0], first[1])).otherwise(OTHER)


def frequency(accesses: Column) -> Column:
    return F.least(F.coalesce(accesses, F.lit(0)) / F.lit(10.0), F.lit(1.0))


def composite(similarity: Column, recent: Column, priority: Column, frequent: Column, weights: dict | None = None) -> Column:
    w = weights or DEFAULTS["ranking"]
    return similarity * w["semantic"] + recent * w["recency"] + priority * w["priority"] + frequent * w["frequency"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if lengths differ or either norm is 0; in double."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def encode_vector(values: list[float]) -> bytes:
    """Little-endian 32-bit floats."""
    import struct

    return struct.pack(f"<{len(values)}f", *values)


def decode_vector(raw: bytes) -> list[float]:
    import struct

    return list(struct.unpack(f"<{len(raw) // 4}f", raw))


def encode_column(vector: Column) -> Column:
    """Vectors as little-endian 32-bit floats, one after the other; null stays null."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("binary")
    def encode(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return encode(vector)


def decode_column(raw: Column) -> Column:
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<float>")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return decode(raw)
