"""Exact set-similarity join within groups: Jaccard of word sets at or above a threshold, by prefix filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import jaccard
from tesserae.sources.workspace import shared_table


def word_classes(df: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, set_id) for rows with a non-empty `words`: rows of a group with equal word sets share the smallest key."""
    sized = df.where(F.size("words") > 0).select(group, key, F.sort_array("words").alias("words"))
    digest = F.sha2(F.array_join("words", "\u0001"), 256)
    marked = shared_table(sized.select(group, key, digest.alias("digest")), "digests")
    return marked.join(marked.groupBy(group, "digest").agg(F.min(key).alias("set_id")), [group, "digest"]).select(group, key, "set_id")


def similar_pairs(df: DataFrame, group: str, key: str, threshold: float) -> DataFrame:
    """(group, a, b, similarity), a < b, of rows with `words` in a group; each row should be another set.

    Words are numbered and each set is ordered from rare to frequent words. Two sets as similar as the threshold share a word among the first
    n - ceil(threshold * n) + 1 of both, so only those are joined, and sizes that can't match are left out. What a pair shares there, with what
    can follow its last shared place, bounds its overlap; the sets themselves, as numbers, go only to pairs that can still reach the threshold.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    words = shared_table(df.where(F.size("words") > 0).select(group, F.col(key).alias("k"), F.explode("words").alias("word")), "words")
    often = shared_table(words.groupBy("word").agg(F.count(F.lit(1)).alias("freq")).withColumn("w", F.monotonically_increasing_id()), "word-numbers")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("freq", "w"))), lambda x: x["w"])
    sets = shared_table(words.join(often, "word").groupBy(group, "k").agg(ordered.alias("ws")), "word-sets")
    n = F.size("ws")
    short = (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")
    prefix = shared_table(sets.select(group, "k", n.alias("n"), F.posexplode(F.slice("ws", 1, short)).alias("at", "w")), "prefixes")
    a, b = (prefix.select(group, "w", *[F.col(c).alias(f"{c}_{x}") for c in ("k", "n", "at")]) for x in "ab")
    sized = (F.col("k_a") < F.col("k_b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9)
    shared = a.join(b, [group, "w"]).where(sized).groupBy(group, F.col("k_a").alias("a"), F.col("k_b").alias("b"), "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"), F.max("at_a").alias("last_a"), F.max("at_b").alias("last_b"))
    most = F.col("shared") + F.least(F.col("n_a") - F.col("last_a"), F.col("n_b") - F.col("last_b")) - 1
    met = shared.where(most >= (F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-6).select(group, "a", "b")
    left, right = (sets.select(group, F.col("k").alias(x), F.col("ws").alias(f"w{x}")) for x in "ab")
    return met.join(left, [group, "a"]).join(right, [group, "b"]).withColumn("similarity", jaccard(F.col("wa"), F.col("wb"))).where(F.col("similarity") >= threshold).select(group, "a", "b", "similarity")
