"""Tiered compression: overflow of working buffers, compression of buffers, sessions and epochs, with lineage.

What a summary keeps is a prefix of the joined texts, so rows that begin beyond the token cap, as do the separators before them, aren't gathered:
running lengths find them, and a session's text stays within the cap however long the session is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.config import DEFAULTS
from tesserae.functions.text import estimate_tokens, to_fixed, truncate_tokens
from tesserae.sources.store import new_id

#: Shares in which lengths are placed, each by a task.
SHARES = 64
_B, _C = DEFAULTS["token_budgets"], DEFAULTS["compression"]


def _joined_prefix(rows: DataFrame, keys: list[str], order: list[Column], separator: str, budget: int) -> DataFrame:
    """By keys: the texts joined in order, cut to the budget; counts and tokens of all rows."""
    w = W.partitionBy(*keys).orderBy(*order)
    before = F.sum(F.length("content") + len(separator)).over(w.rowsBetween(W.unboundedPreceding, -1))
    placed = rows.withColumns({"_before": F.coalesce(before, F.lit(0)), "_k": F.row_number().over(w)})
    near = F.col("_before") < 4 * budget + len(separator)  # the cap may fall on the separator before a row
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(near, F.struct("_k", "content")))), lambda x: x["content"]), separator)
    return placed.groupBy(*keys).agg(truncate_tokens(body, budget).alias("content"), F.count(F.lit(1)).alias("original_count"), F.sum("tokens").cast("long").alias("original_tokens"))


def _summary(rows: DataFrame, kind: str, tier: int, confidence: float) -> DataFrame:
    tokens = estimate_tokens(F.col("content"))
    ratio = to_fixed(F.col("original_tokens") / F.greatest(tokens, F.lit(1)), 1)
    return rows.withColumns({"id": new_id(F.lit(kind), F.col("session_id"), F.col("content"), F.col("original_count")), "tier": F.lit(tier), "kind": F.lit(kind), "token_count": tokens, "confidence": F.lit(confidence), "ratio": ratio})


def compress_buffer(buffer: DataFrame, kind: str = "manual_compressed", budget: int = _B["session"]) -> DataFrame:
    """A tier-1 summary for each session of the buffer, oldest entries first."""
    return _summary(_joined_prefix(buffer, ["session_id"], [F.col("seq")], "\n", budget), kind, 1, 0.9)


def archive(buffer: DataFrame, budget: int = _B["session"]) -> DataFrame:
    """At a session's end: like compress_buffer; the caller drops the archived rows."""
    return compress_buffer(buffer, "session_archive", budget)


def _newest(summaries: DataFrame, budget: int, separator: str, per_session: bool) -> DataFrame:
    tier1 = summaries.where("tier = 1").withColumn("tokens", F.col("token_count"))
    newest = [F.desc("created_at"), F.col("id")]
    keys = ["session_id"] if per_session else []
    # what can't reach the cap within a share of the rows can't among all: lengths are placed by share first, then those left by key
    light = tier1.select(*keys, "id", "created_at", (F.length("content") + len(separator)).alias("_n")).withColumn("_share", F.pmod(F.xxhash64("id"), F.lit(SHARES)))
    for by in ([*keys, "_share"], keys or [F.lit(1)]):
        before = F.sum("_n").over(W.partitionBy(*by).orderBy(*newest).rowsBetween(W.unboundedPreceding, -1))
        light = light.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < 4 * budget + len(separator))
    reached = light.select("id").distinct()
    texts = tier1.join(reached if per_session else F.broadcast(reached), "id", "left_semi").withColumn("_all", F.lit(1))
    counts = tier1.groupBy(*keys).agg(F.count(F.lit(1)).alias("original_count"), F.sum("tokens").cast("long").alias("original_tokens"))
    joined = _joined_prefix(texts, keys or ["_all"], newest, separator, budget).select(*keys, "content")
    if per_session:
        return joined.withColumnRenamed("session_id", "_session").join(counts, F.col("_session").eqNullSafe(F.col("session_id"))).drop("_session")
    return joined.crossJoin(F.broadcast(counts)).withColumn("session_id", F.lit(None).cast("string"))


def compress_session(summaries: DataFrame, per_session: bool = False, budget: int = 2 * _B["session"]) -> DataFrame:
    """All tier-1 summaries into one, newest first (of all sessions, or of each); fewer than two give none."""
    return _summary(_newest(summaries, budget, "\n\n", per_session).where("original_count >= 2"), "session_consolidated", 1, 0.85)


def compress_epoch(summaries: DataFrame, per_session: bool = False, least: int = _C["consolidation_count"], budget: int = _B["epoch"]) -> DataFrame:
    """All tier-1 summaries into a tier-2 one, if there are enough."""
    return _summary(_newest(summaries, budget, "\n\n", per_session).where(F.col("original_count") >= least), "epoch_summary", 2, 0.8)


def lineage(compressed: DataFrame, sources: DataFrame) -> DataFrame:
    """(summary_id, source_id) for what went into each summary: by session, or all where it has none."""
    ids = sources.select(F.col("session_id").alias("s"), F.col("id").alias("source_id"))
    heads = compressed.select(F.col("id").alias("summary_id"), "session_id")
    own = ids.join(heads.where("session_id is not null"), F.col("s") == F.col("session_id")).select("summary_id", "source_id")
    return own.unionByName(ids.crossJoin(heads.where("session_id is null")).select("summary_id", "source_id"))  # a summary of everything names everything


def overflow_runs(buffer: DataFrame, threshold: int = _C["overflow_threshold"]) -> DataFrame:
    """(session_id, run, id): entries that leave the buffer, run by run, as entries come in one by one.

    When a session's tokens exceed the threshold after an entry, the older half of its entries (rounded
    down) becomes a run, once an entry. The buffer is always the list's last entries, so a fold over token counts carries only where it begins.
    """
    running = F.sum("tokens").over(W.partitionBy("session_id").orderBy("seq", "id"))
    xs = buffer.where("session_id is not null").withColumn("upto", running).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "id", "upto"))).alias("xs"))
    zero = F.struct(F.lit(0).alias("head"), F.array().cast("array<int>").alias("cuts"))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("xs"), i - 1)["upto"])

    def step(acc: Column, i: Column) -> Column:
        total = F.get(F.col("xs"), i)["upto"] - before(acc["head"])
        half = F.floor((i + 1 - acc["head"]) / 2).cast("int")
        leaves = (total > threshold) & (half > 0)
        return F.struct(F.when(leaves, acc["head"] + half).otherwise(acc["head"]).alias("head"), F.when(leaves, F.concat(acc["cuts"], F.array(acc["head"] + half))).otherwise(acc["cuts"]).alias("cuts"))

    cuts = xs.select("session_id", "xs", F.aggregate(F.sequence(F.lit(0), F.size("xs") - 1), zero, step)["cuts"].alias("cuts")).where(F.size("cuts") > 0)
    runs = cuts.select("session_id", "xs", "cuts", F.posexplode("cuts").alias("run", "end"))
    begin = F.when(F.col("run") == 0, 0).otherwise(F.get(F.col("cuts"), F.col("run") - 1))
    return runs.select("session_id", F.col("run").cast("long").alias("run"), F.explode(F.slice(F.col("xs"), begin + 1, F.col("end") - begin)).alias("x")).select("session_id", "run", F.col("x.id").alias("id"))


def compress_overflow(buffer: DataFrame, threshold: int = _C["overflow_threshold"], budget: int = _B["session"]) -> tuple[DataFrame, DataFrame]:
    """Tier-1 summaries of the runs that left, and what stays in the buffer."""
    gone = overflow_runs(buffer, threshold)
    rows = buffer.join(gone, ["session_id", "id"])
    return _summary(_joined_prefix(rows, ["session_id", "run"], [F.col("seq")], "\n", budget), "auto_compressed", 1, 0.9), buffer.join(gone.select("id"), "id", "left_anti")


def report(compressed: DataFrame) -> DataFrame:
    """The line that tells what was compressed."""
    n, t, c, r = (F.col(x).cast("string") for x in ("original_count", "original_tokens", "token_count", "ratio"))
    into = F.when(F.col("kind") == "epoch_summary", F.concat(F.lit("Promoted "), n, F.lit(" Tier 1 summaries ("), t, F.lit(" tokens) into Tier 2 epoch summary ("))).when(F.col("kind") == "session_consolidated", F.concat(F.lit("Consolidated "), n, F.lit(" Tier 1 summaries ("), t, F.lit(" tokens) into 1 summary ("))).otherwise(F.concat(F.lit("Compressed "), n, F.lit(" working memory entries ("), t, F.lit(" tokens) into Tier 1 summary (")))
    return compressed.withColumn("message", F.concat(into, c, F.lit(" tokens). Compression ratio: "), r, F.lit("x")))
