"""A façade with the operations, resources and prompts by name, over a store on disk.

Each call reads current tables from the store and appends what it changes; no state is kept in the process but the
session's id. Results are text, as a caller reads them; tables are at hand through `store`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.config import DEFAULTS
from tesserae.functions import text
from tesserae.operators import compression, forget, graph, ingest, retrieval, scans, sessions, stats, vectors
from tesserae.sources.store import Store, new_id


class Memory:
    #: The operations by name.
    OPERATIONS = ("session_start", "memory_store", "memory_retrieve", "memory_compress", "memory_forget", "memory_status")

    def __init__(self, spark: SparkSession, path: str, config: dict | None = None, embedder: Callable[[Column], Column] | None = None):
        """embedder: text to array<float> of the configured number of dimensions; vectors are zero without one."""
        self.spark, self.store, self.config, self.embedder = spark, Store(spark, path), config or DEFAULTS, embedder
        self.session: str | None = None
        self.embedding_error: str | None = None if embedder else "no embedder was given"

    @property
    def embedding_ready(self) -> bool:
        return self.embedder is not None

    def call(self, name: str, arguments: dict | None = None) -> tuple[str, bool]:
        """An operation by name: its text, and whether it failed."""
        if name not in self.OPERATIONS:
            return f"Unknown tool: {name}", True
        try:
            return getattr(self, name)(**(arguments or {})), False
        except Exception as e:  # noqa: BLE001  whatever went wrong is told to the caller as text
            return f"Error: {e}", True

    def search(self, query: str, k: int = 10, types: list[str] | None = None) -> DataFrame:
        """The k vectors most similar to the query's."""
        asked = self.spark.range(1).select(F.lit("query").alias("query_id"), self._embed(F.lit(query)).alias("q"))
        rows = self._table("vectors").withColumn("seq", F.col("id"))
        return vectors.search_many(vectors.matching(rows, types) if types else rows, asked, k)

    # --- tables ---

    def _table(self, name: str) -> DataFrame:
        return self.store.table(name, None if name == "access_log" else "id")

    def _summaries(self) -> DataFrame:
        return self._table("summaries").withColumn("seq", F.unix_micros("created_at"))

    def _embed(self, content: Column) -> Column:
        return self.embedder(content) if self.embedder else vectors.zero_embedding(self.config["embedding"]["dimensions"])

    def _put_vectors(self, rows: DataFrame, as_of: str) -> None:
        """rows: source_id, source_type, content, confidence."""
        new = rows.select(new_id(F.lit("vector"), F.col("source_id")).alias("id"), "source_id", "source_type", "content", "confidence")
        self.store.put("vectors", vectors.with_vectors(self._table("vectors").limit(0), new, self._embed(F.col("content")), as_of))

    def _put_summaries(self, rows: DataFrame, as_of: str) -> None:
        at = F.lit(as_of).cast("timestamp")
        self.store.put("summaries", rows.withColumns({"created_at": at, "updated_at": at}))

    # --- operations ---

    def session_start(self, as_of: str) -> str:
        """End the current session, archive its buffer, begin a new one with an empty buffer."""
        new, ended, archived, _ = sessions.start(self.spark, self._table("sessions"), self._table("buffer"), as_of, self.session)
        if self.session:
            rows = archived.select("id", "tier", "content", "token_count", "session_id", F.to_json(F.struct(F.col("kind").alias("type"), F.col("original_count").alias("originalCount"), F.col("original_tokens").alias("originalTokens"))).alias("metadata"))
            self._put_summaries(rows, as_of)
            self._put_vectors(archived.select(F.col("id").alias("source_id"), F.lit("summary").alias("source_type"), "content", "confidence"), as_of)
        self.store.delete("buffer", self._table("buffer"))
        self.store.put("sessions", ended)
        self.session = new
        return f"New session started: {new}\nStarted at: {as_of}"

    def memory_store(self, content: str, memory_type: str | None = None, confidence: float | None = None, entities: list[str] | None = None, as_of: str = "") -> str:
        if not content:
            return "Error: 'content' is required."
        last = self._table("buffer").agg(F.max("seq")).first()[0]
        seq = int(self.spark.sql("select unix_micros(timestamp'" + as_of + "')").first()[0])
        row = self.spark.createDataFrame([(seq if last is None or seq > last else last + 1, self.session, content, memory_type, confidence, entities)], "seq long, session_id string, content string, memory_type string, confidence double, entities array<string>")
        row = row.withColumn("id", new_id(F.lit("memory"), F.col("seq"), F.col("content")))
        stored = ingest.store(row)
        result = stored.results.first()
        if result["quality"] == "rejected":
            return f"REJECTED: Memory too short ({ingest.gate(row).first()['n_words']} words)."
        self._put_summaries(stored.summaries.select("id", "tier", "content", "token_count", "session_id", F.col("entities").alias("source_ids"), F.to_json(F.struct("entities", F.col("session_id").alias("sessionId"))).alias("metadata")), as_of)
        self.store.put("buffer", stored.buffer.withColumn("timestamp", F.lit(as_of).cast("timestamp")))
        self._put_graph(stored, as_of)
        self._put_vectors(stored.vectors, as_of)
        self._overflow(as_of)
        note = "\nEntry is brief. Consider adding more context." if result["quality"] == "brief" else ""
        return f"Stored as {memory_type or 'event'} (Tier {result['tier']})\nID: {result['id']}" + (f"\nFacts stored: {result['facts_stored']}" if result["facts_stored"] else "") + note

    def _put_graph(self, stored: ingest.Stored, as_of: str) -> None:
        at = F.lit(as_of).cast("timestamp")
        known = self._table("entities").select(ingest.place(F.lit(0), F.unix_micros("created_at") - F.lit(1 << 62)).alias("seq"), "label", "entity_type", "confidence")
        old = self._table("entities").select("id", text.fold_ascii(F.col("label")).alias("label_key"), "created_at")
        state = graph.entity_state(known.unionByName(stored.entities)).join(stored.entities.select(text.fold_ascii(F.col("label")).alias("label_key")).distinct(), "label_key", "left_semi")
        rows = state.join(old, "label_key", "left").select(F.coalesce("id", new_id(F.lit("entity"), F.col("label_key"))).alias("id"), "label", "entity_type", F.coalesce("created_at", at).alias("created_at"), at.alias("updated_at"), "confidence")
        self.store.put("entities", rows)
        ids = self._table("entities").select("id", text.fold_ascii(F.col("label")).alias("k"))
        new = stored.relations.withColumns({"sk": text.fold_ascii(F.col("subject")), "ok": text.fold_ascii(F.col("object"))}).join(ids.select(F.col("id").alias("subject_id"), F.col("k").alias("sk")), "sk").join(ids.select(F.col("id").alias("object_id"), F.col("k").alias("ok")), "ok").select("seq", "subject_id", "predicate", "object_id", at.alias("temporal_start"), "confidence")
        active = scans.active(self._table("relations")).select(ingest.place(F.lit(0), F.unix_micros("temporal_start")).alias("seq"), "subject_id", "predicate", "object_id", "temporal_start", "confidence", F.col("id").alias("old")).join(new.select("subject_id", "predicate").distinct(), ["subject_id", "predicate"], "left_semi")
        both = active.unionByName(new, allowMissingColumns=True)
        after = graph.relation_state(both).withColumn("id", F.coalesce("old", new_id(F.lit("relation"), F.col("seq"), F.col("subject_id"), F.col("predicate"), F.col("object_id"))))
        self.store.put("relations", after)

    def _overflow(self, as_of: str) -> None:
        made, _ = compression.compress_overflow(self._table("buffer"), self.config["compression"]["overflow_threshold"], self.config["token_budgets"]["session"])
        gone = compression.overflow_runs(self._table("buffer"), self.config["compression"]["overflow_threshold"]).select("id")
        if not gone.isEmpty():
            self._put_summaries(made.select("id", "tier", "content", "token_count", "session_id", F.to_json(F.struct(F.col("kind").alias("type"))).alias("metadata")), as_of)
            self.store.delete("buffer", gone)

    def memory_retrieve(self, query: str, token_budget: int | None = None, filters: dict | None = None, as_of: str = "") -> str:
        """Query and filters are taken and not used: what is retrieved depends on the session alone."""
        if not query:
            return "Error: 'query' is required."
        context, log = retrieval.assemble(self._table("buffer").where(F.col("session_id") == self.session), self._summaries().where(F.col("session_id") == self.session), self._table("access_log"), as_of, token_budget, self.config)
        row = context.first()
        self.store.put("access_log", log)
        return row["text"] if row else retrieval.EMPTY

    def memory_compress(self, scope: str = "working", as_of: str = "") -> str:
        own = self._table("buffer").where(F.col("session_id") == self.session)
        tier1 = self._summaries().where("tier = 1")
        if scope == "working":
            made, gone, table, empty = compression.compress_buffer(own, budget=self.config["token_budgets"]["session"]), own, "buffer", "Working memory is empty, nothing to compress."
        elif scope == "session":
            made, gone, table, empty = compression.compress_session(tier1), tier1, "summaries", "Not enough Tier 1 summaries to consolidate."
        elif scope == "epoch":
            least = self.config["compression"]["consolidation_count"]
            made, gone, table, empty = compression.compress_epoch(tier1, least=least), tier1, "summaries", f"Need at least {least} Tier 1 summaries for epoch consolidation (have {tier1.count()})."
        else:
            return f"Unknown compression scope: {scope}"
        row = compression.report(made).first()
        if row is None:
            return empty
        new = self.spark.createDataFrame([(row["id"], row["tier"], row["content"], row["token_count"], self.session, row["confidence"])], "id string, tier int, content string, token_count long, session_id string, confidence double")
        self.store.delete(table, gone)
        self._put_summaries(new, as_of)
        self._put_vectors(new.select(F.col("id").alias("source_id"), F.lit("epoch" if scope == "epoch" else "summary").alias("source_type"), "content", "confidence"), as_of)
        return row["message"]

    def memory_forget(self, memory_id: str, action: str = "deprecate", correction: str | None = None, as_of: str = "") -> str:
        if not memory_id:
            return "Error: 'memory_id' is required."
        asked = self.spark.createDataFrame([(memory_id, action, correction)], "memory_id string, action string, correction string")
        done = forget.forget(self._table("summaries"), self._table("buffer"), self._table("vectors"), asked)
        message = done.messages.first()["message"]
        for name, rows in (("summaries", done.summaries), ("buffer", done.buffer), ("vectors", done.vectors)):
            before = self._table(name)
            if action == "delete" or name == "vectors":
                self.store.delete(name, before.join(rows.select("id"), "id", "left_anti"))
            else:
                self.store.put(name, rows.where(F.col("id") == memory_id))
        if not done.reembed.isEmpty():
            self._put_vectors(done.reembed.select(F.col("id").alias("source_id"), "source_type", "content", "confidence"), as_of)
        return message

    def memory_status(self, started_at: str = "") -> str:
        return stats.status_text(self._status(), self.session or "", started_at).first()["text"]

    def _status(self) -> DataFrame:
        return stats.status(self._table("buffer"), self._table("summaries"), self._table("entities"), self._table("relations"), self._table("vectors"), self.session)

    # --- resources and prompts ---

    def resource(self, uri: str) -> str:
        if uri == "memory://core":
            return scans.core_memory(self._table("summaries")).first()["text"]
        if uri == "memory://session/current":
            rows = self._table("buffer").where(F.col("session_id") == self.session).select("seq", F.concat(F.lit("["), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("] "), "content").alias("line"))
            return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("t")).first()["t"] or scans.NO_WORKING
        if uri == "memory://graph/schema":
            rows = graph.schema(self._table("entities"), self._table("relations"))
            return rows.agg(F.to_json(F.struct(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("position", "name")))), lambda x: x["name"]).alias(n) for k, n in (("entity_type", "entityTypes"), ("predicate", "predicates"))])).alias("t")).first()["t"]
        if uri == "memory://stats":
            return self._status().select(F.to_json(F.struct("*")).alias("t")).first()["t"]
        raise ValueError(f"Unknown resource: {uri}")

    def prompt(self, name: str, argument: str = "") -> str:
        return self.spark.range(1).select(text.prompt(name, F.lit(argument)).alias("t")).first()["t"]
