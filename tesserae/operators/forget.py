"""Forgetting: delete, deprecate or correct summaries and buffer entries, many requests at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import estimate_tokens


@dataclass
class Forgotten:
    summaries: DataFrame
    buffer: DataFrame
    vectors: DataFrame
    reembed: DataFrame  # id, content, source_type, confidence
    messages: DataFrame  # memory_id, message


#: What a deprecation puts before the text, and the tokens it adds.
MARK, MARK_TOKENS = "[DEPRECATED] ", 15


def forget(summaries: DataFrame, buffer: DataFrame, vectors: DataFrame, requests: DataFrame) -> Forgotten:
    """requests: memory_id, action (null: deprecate), correction; one for each memory. Summaries come before buffer entries.

    Deleting a summary drops its vectors, correcting it has them made anew; the buffer's vectors stay. Sessions don't matter.
    """
    asked = requests.select("memory_id", F.coalesce("action", F.lit("deprecate")).alias("action"), F.nullif("correction", F.lit("")).alias("correction"))
    s = summaries.join(asked, F.col("id") == F.col("memory_id"), "left")
    hit, action, text = F.col("memory_id").isNotNull(), F.col("action"), F.col("correction")
    deprecated, corrected = hit & (action == "deprecate"), hit & (action == "correct") & text.isNotNull()
    kept = s.where(~F.coalesce(hit & (action == "delete"), F.lit(False)))
    changed = kept.withColumns({"content": F.when(deprecated, F.concat(F.lit(MARK), F.col("content"))).when(corrected, text).otherwise(F.col("content")), "token_count": F.when(deprecated, F.col("token_count") + MARK_TOKENS).when(corrected, estimate_tokens(text)).otherwise(F.col("token_count"))})
    ids = summaries.select(F.col("id").alias("memory_id"), "tier")
    on_summary = asked.join(ids, "memory_id")
    known = F.when(action == "delete", F.concat(F.lit("Deleted memory "), "memory_id", F.lit(" (was Tier "), F.col("tier").cast("string"), F.lit(" summary)."))).when(action == "deprecate", F.concat(F.lit("Deprecated memory "), "memory_id", F.lit("."))).when((action == "correct") & text.isNull(), F.lit("Correction text required for 'correct' action.")).when(action == "correct", F.concat(F.lit("Corrected memory "), "memory_id", F.lit(" with new content.")))
    elsewhere = asked.join(ids, "memory_id", "left_anti")
    b = buffer.join(elsewhere, F.col("id") == F.col("memory_id"), "left")
    gone, fixed = F.coalesce(hit & (action == "delete"), F.lit(False)), hit & (action == "correct") & text.isNotNull()
    entries = b.where(~gone).withColumns({"content": F.when(fixed, text).otherwise(F.col("content")), "tokens": F.when(fixed, estimate_tokens(text)).otherwise(F.col("tokens"))})
    in_buffer = elsewhere.join(buffer.select(F.col("id").alias("memory_id")).distinct().withColumn("there", F.lit(True)), "memory_id", "left")
    other = F.when(F.col("there") & (action == "delete"), F.concat(F.lit("Deleted working memory entry "), "memory_id", F.lit("."))).when(F.col("there") & (action == "correct") & text.isNotNull(), F.concat(F.lit("Corrected working memory entry "), "memory_id", F.lit("."))).otherwise(F.concat(F.lit("Memory "), "memory_id", F.lit(" not found.")))
    dropped = on_summary.where((action == "delete") | ((action == "correct") & text.isNotNull())).select(F.col("memory_id").alias("source_id"))
    reembed = on_summary.where((action == "correct") & text.isNotNull()).select(F.col("memory_id").alias("id"), text.alias("content"), F.when(F.col("tier") == 3, "core").otherwise("summary").alias("source_type"), F.lit(0.9).alias("confidence"))
    messages = on_summary.select("memory_id", F.coalesce(known, F.concat(F.lit("Memory "), "memory_id", F.lit(" not found."))).alias("message")).unionByName(in_buffer.select("memory_id", other.alias("message")))
    return Forgotten(changed.select(*summaries.columns), entries.select(*buffer.columns), vectors.join(dropped, "source_id", "left_anti"), reembed, messages)
