"""The working buffer as a stateful stream: entries come in, runs that overflow go out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesserae.config import DEFAULTS
from tesserae.functions.text import estimate_tokens

OUTPUT = "session_id string, run long, n_entries long, original_tokens long, ids array<string>, content string"
STATE = "ids array<string>, contents array<string>, tokens array<long>, run long"


def _step(threshold: int, keep: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, contents, tokens, count = state.get if state.exists else ([], [], [], 0)
        ids, contents, tokens = list(ids), list(contents), list(tokens)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for entry in rows.itertuples():
            ids.append(entry.id)
            contents.append(entry.content)
            tokens.append(int(entry.tokens))
            half = len(ids) // 2
            if sum(tokens) > threshold and half:
                out.append((key[0], count, half, sum(tokens[:half]), ids[:half], "\n".join(contents[:half])[: 4 * keep]))
                ids, contents, tokens, count = ids[half:], contents[half:], tokens[half:], count + 1
        state.update((ids, contents, tokens, count))
        yield pd.DataFrame(out, columns=["session_id", "run", "n_entries", "original_tokens", "ids", "content"])

    return run


def overflow_stream(entries: DataFrame, threshold: int = DEFAULTS["compression"]["overflow_threshold"], keep: int = DEFAULTS["token_budgets"]["session"]) -> DataFrame:
    """entries: session_id, seq, id, content, streaming. The state of a session is its buffer, whose tokens the threshold bounds."""
    sized = entries.where("session_id is not null").select("session_id", "seq", "id", "content", estimate_tokens(F.col("content")).alias("tokens"))
    return sized.groupBy("session_id").applyInPandasWithState(_step(threshold, keep), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def access_counts_stream(access_log: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Accesses by memory and window of event time; late rows beyond the watermark are left out."""
    return access_log.withWatermark("accessed_at", watermark).groupBy(F.window("accessed_at", window), "memory_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "memory_id", "n")
