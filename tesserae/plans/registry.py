"""All registered queries over the fixtures, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import scoring, text
from tesserae.operators import compression, forget, graph, ingest, retrieval, scans, sessions, similarity, stats, vectors
from tesserae.plans import sql as S
from tesserae.sources import fixtures as X
from tesserae.sources.workspace import shared_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Small budgets, as the fixtures are far below the production thresholds.
FILL, OVERFLOW, KEEP, CHUNK = 400, 300, 100, 50


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# --- text -----------------------------------------------------------------------------------


@query(S.TOKEN_ESTIMATE)
def token_estimate(spark, d):
    t = X.read(spark, d, "documents")
    return t.select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"), F.length(text.truncate_tokens(F.col("text"), KEEP)).cast("long").alias("kept_chars"))


@query(S.QUALITY_GATE)
def quality_gate(spark, d):
    t = X.read(spark, d, "documents")
    return t.select("doc_id", text.word_count(F.col("text")).cast("long").alias("n_words"), text.quality(F.col("text")).alias("quality"), text.sentence_count(F.col("text")).cast("long").alias("n_sentences"))


@query(S.INFER_PREDICATE)
def infer_predicate(spark, d):
    c = X.read(spark, d, "conversations")
    return c.select("conv_id", "turn", text.infer_predicate(F.col("text")).alias("predicate"))


@query(S.ENTITY_MENTIONS)
def entity_mentions(spark, d):
    c = X.read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.array_join(F.array_sort(text.entity_mentions(F.col("text"))), "|").alias("mentions"))


@query(S.SENTENCE_CHUNKS)
def sentence_chunks(spark, d):
    c = X.read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.posexplode(text.sentence_chunks(F.col("text"), CHUNK)).alias("n", "chunk")).select("conv_id", "turn", F.col("n").cast("long").alias("n"), "chunk")


@query(S.CONTENT_PREVIEW)
def content_preview(spark, d):
    return X.read(spark, d, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query(S.FITS_IN_BUDGET)
def fits_in_budget(spark, d):
    return X.read(spark, d, "documents").select("doc_id", text.fits_in_budget(F.col("text"), FILL).alias("fits"))


@query(S.WORD_JACCARD_PAIRS)
def word_jaccard_pairs(spark, d):
    """Pairs of class representatives, and each further member of a class with its representative."""
    t = shared_table(X.read(spark, d, "documents").select("source", "doc_id", text.word_set(F.col("text")).alias("words")), "word-lists")
    classes = shared_table(similarity.word_classes(t, "source", "doc_id"), "word-classes")
    first = classes.where("doc_id = set_id").select("source", "doc_id")
    pairs = similarity.similar_pairs(t.join(first, ["source", "doc_id"], "left_semi"), "source", "doc_id", 0.85)
    members = classes.where("doc_id != set_id").select("source", F.col("set_id").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.select("source", "a", "b", F.round("similarity", 6).alias("similarity")).unionByName(members)


@query(S.PROMPTS)
def prompts(spark, d):
    c = X.read(spark, d, "conversations")
    return c.select("conv_id", "turn", *[F.md5(text.prompt(name, F.col("text")).cast("binary")).alias(name) for name in text.PROMPTS])


# --- retrieval ------------------------------------------------------------------------------


def _scored(spark, d):
    s = retrieval.summary_candidates(X.summaries(spark, d), X.access_log(spark, d), X.AS_OF)
    return retrieval.score(s)


@query(S.COMPOSITE_SCORE)
def composite_score(spark, d):
    return _scored(spark, d).select("session_id", "id", "tokens", F.round("recency", 6).alias("recency"), F.round("frequency", 6).alias("frequency"), F.round("score", 6).alias("score"))


@query(S.RECENCY_SCORE)
def recency_score(spark, d):
    return X.summaries(spark, d).select("id", F.round(scoring.recency(F.col("created_at"), F.lit(X.AS_OF)), 6).alias("recency"))


@query(S.SOURCE_PRIORITY)
def source_priority(spark, d):
    c = X.read(spark, d, "conversations")
    kind = F.element_at(F.array(*map(F.lit, [*scoring.PRIORITIES, "elsewhere"])), (F.col("turn") % 8 + 1).cast("int"))
    return c.select("conv_id", "turn", kind.alias("kind"), scoring.source_priority(kind).alias("priority"))


@query(S.DEDUP_GREEDY)
def dedup_greedy(spark, d):
    scored, s = _scored(spark, d), X.summaries(spark, d)
    words = s.where("tier = 1").select("session_id", "id", text.word_set(F.col("content")).alias("words"))
    return retrieval.dedup_greedy(scored, words, 0.7).select("session_id", "id")


@query(S.BUDGET_FILL)
def budget_fill(spark, d):
    filled = retrieval.fill(_scored(spark, d), 2 * FILL)
    return filled.select("session_id", "considered", "budget_used", F.array_join(F.transform("selected", lambda s: s["id"]), ",").alias("ids"))


def _context(spark, d):
    c = retrieval.score(retrieval.working_candidates(X.buffer(spark, d)))
    return retrieval.render(retrieval.fill(c, FILL), X.buffer(spark, d), X.summaries(spark, d))


@query(S.CONTEXT_SUMMARY)
def context_summary(spark, d):
    """Working memory of every conversation within a small budget: what `entry` runs."""
    return _context(spark, d).select("session_id", "considered", "n_selected", "budget_used", "budget_remaining", "sources", "total_tokens")


@query(S.CONTEXT_RENDER)
def context_render(spark, d):
    return _context(spark, d).select("session_id", "text")


@query(S.CONTEXT_ASSEMBLED)
def context_assembled(spark, d):
    """The whole retrieval over buffers and tier-1 notes, near-duplicates removed."""
    out, _ = retrieval.assemble(X.buffer(spark, d), X.summaries(spark, d), X.access_log(spark, d), X.AS_OF, 2 * FILL)
    return out


# --- graph ----------------------------------------------------------------------------------


@query(S.ENTITY_UPSERT)
def entity_upsert(spark, d):
    e = X.read(spark, d, "events")
    label = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    log = e.select(F.col("event_id").alias("seq"), F.concat(label, F.lit("-"), (F.col("user_id") % 20).cast("string")).alias("label"), F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("entity_type"), ((F.col("event_id") % 7) / 10.0).alias("confidence"))
    return graph.entity_state(log)


@query(S.RELATION_FIFO)
def relation_fifo(spark, d):
    state = graph.relation_state(X.relation_log(spark, d))
    return state.select("seq", "subject_id", "predicate", "object_id", F.col("temporal_end").isNull().alias("active"), _time("temporal_end").alias("ended"), "confidence")


@query(S.ALL_FACTS)
def all_facts(spark, d):
    return graph.facts(*X.graph(spark, d)).select("subject", "subject_type", "predicate", "object", "object_type", "confidence")


@query(S.FACTS_BY_PREDICATE)
def facts_by_predicate(spark, d):
    return graph.facts(*X.graph(spark, d), "PART_OF").select("subject", "predicate", "object", "confidence")


def _nations(spark, d):
    return X.graph(spark, d)[0].where("entity_type = 'nation'").select("id")


@query(S.NEIGHBORS_1HOP)
def neighbors_1hop(spark, d):
    return graph.neighbours(_nations(spark, d), X.graph(spark, d)[1], 1).select("root", "id")


@query(S.NEIGHBORS_2HOP)
def neighbors_2hop(spark, d):
    return graph.neighbours(_nations(spark, d), X.graph(spark, d)[1], 2).select("root", "id", F.col("hop").cast("long").alias("hop"))


@query(S.GRAPH_SCHEMA)
def graph_schema(spark, d):
    return graph.schema(*X.graph(spark, d))


@query(S.GRAPH_STATS)
def graph_stats(spark, d):
    return graph.stats(*X.graph(spark, d))


@query(S.GRAPH_TEXT)
def graph_text(spark, d):
    e, r = X.graph(spark, d)
    return graph.serialize_entity(e.where("entity_type = 'region'"), e, r)


@query(S.FACT_LINES)
def fact_lines(spark, d):
    return graph.serialize_facts(graph.facts(*X.graph(spark, d))).select("subject_id", "line")


@query(S.ENTITY_SEARCH)
def entity_search(spark, d):
    return scans.search_entities(X.graph(spark, d)[0], "oN_1").select("id", "label", "confidence")


@query(S.ENTITY_BY_LABEL)
def entity_by_label(spark, d):
    e = X.graph(spark, d)[0]
    return graph.find_entity(e, "aSiA").select("id", "label").unionByName(graph.find_entity(e, "tion_1").select("id", "label"))


@query(S.REMOVE_ENTITY)
def remove_entity(spark, d):
    e, r = X.graph(spark, d)
    labels = e.where("entity_type = 'nation' and id in ('n1', 'n2', 'n3')").select(F.upper("label").alias("label"))
    left_e, left_r = graph.remove_entities(e, r, labels)
    return left_e.select(F.col("id").alias("subject"), F.lit("").alias("object")).unionByName(left_r.select(F.col("subject_id").alias("subject"), F.col("object_id").alias("object")))


@query(S.DEPRECATE_RELATION)
def deprecate_relation(spark, d):
    r = graph.deprecate_relations(X.graph(spark, d)[1], F.col("object_id") == "n3", X.AS_OF)
    return r.select("subject_id", "predicate", "object_id", "confidence", _time("temporal_end").alias("ended"))


# --- vectors --------------------------------------------------------------------------------


def _vector_queries(spark, d):
    return X.vectors(spark, d).where("seq % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))


@query(S.COSINE_TOPK)
def cosine_topk(spark, d):
    return vectors.search_many(X.vectors(spark, d), _vector_queries(spark, d), 20).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query(S.COSINE_TOPK_FILTERED)
def cosine_topk_filtered(spark, d):
    v = vectors.matching(X.vectors(spark, d), ["type1", "type2", "type3"], "2024-01-01 00:30:00", "2024-01-01 08:00:00", 0.6)
    return vectors.search_many(v, _vector_queries(spark, d), 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query(S.VECTOR_COUNT)
def vector_count(spark, d):
    return X.vectors(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query(S.VECTORS_BY_TYPE)
def vectors_by_type(spark, d):
    return scans.vectors_by_type(X.vectors(spark, d), "type3").select("id", "source_type", _time("created_at").alias("created"), F.round("confidence", 6).alias("confidence"))


# --- compression ----------------------------------------------------------------------------


@query(S.OVERFLOW_RUNS)
def overflow_runs(spark, d):
    return compression.overflow_runs(X.buffer(spark, d), OVERFLOW)


@query(S.COMPRESS_WORKING)
def compress_working(spark, d):
    return compression.compress_buffer(X.buffer(spark, d), budget=KEEP).select("session_id", "content", "original_count", "original_tokens", "token_count")


@query(S.COMPRESS_SESSION)
def compress_session(spark, d):
    return compression.compress_session(X.summaries(spark, d)).select("content", "original_count", "original_tokens", "token_count")


@query(S.COMPRESS_EPOCH)
def compress_epoch(spark, d):
    return compression.compress_epoch(X.summaries(spark, d), per_session=True, budget=KEEP).select("session_id", "content", "original_count", "original_tokens", "token_count")


@query(S.ARCHIVE_SESSION)
def archive_session(spark, d):
    return compression.archive(X.buffer(spark, d)).select("session_id", "kind", "content", "original_count", "original_tokens", "token_count")


@query(S.LINEAGE)
def compression_lineage(spark, d):
    b = X.buffer(spark, d)
    return compression.lineage(compression.compress_buffer(b, budget=KEEP).select(F.col("session_id").alias("id"), "session_id"), b)


# --- statistics and sessions ----------------------------------------------------------------


@query(S.TIER_COUNTS)
def tier_counts_dense(spark, d):
    return stats.tier_counts(X.summaries(spark, d).where("tier != 2"))


@query(S.TOTAL_TOKENS)
def total_tokens(spark, d):
    return stats.total_tokens(X.summaries(spark, d))


@query(S.STATUS)
def status(spark, d):
    e, r = X.graph(spark, d)
    return stats.status(X.buffer(spark, d), X.summaries(spark, d), e, r, X.vectors(spark, d), "1")


@query(S.ACCESS_FREQUENCY)
def access_frequency(spark, d):
    return stats.access_frequency(X.access_log(spark, d))


@query(S.TOP_ACCESSED)
def top_accessed(spark, d):
    return stats.top_accessed(X.access_log(spark, d))


@query(S.RECENT_SESSIONS)
def recent_sessions(spark, d):
    return scans.recent_sessions(X.sessions(spark, d)).select("id", _time("started_at").alias("started"))


@query(S.ACTIVE_SESSION)
def active_session(spark, d):
    return scans.active_session(X.sessions(spark, d)).select("id", _time("started_at").alias("started"))


@query(S.CONFIDENCE_DECAY)
def confidence_decay(spark, d):
    return X.vectors(spark, d).select("id", F.round(stats.decayed(F.col("confidence") - 0.5, 0.2, 5), 6).alias("confidence"))


@query(S.DATABASE_STATS)
def database_stats(spark, d):
    e, r = X.graph(spark, d)
    return stats.database_stats({"access_log": X.access_log(spark, d), "entities": e, "relations": r, "sessions": X.sessions(spark, d), "summaries": X.summaries(spark, d), "vectors": X.vectors(spark, d)})


# --- scans ----------------------------------------------------------------------------------


@query(S.SUMMARIES_BY_TIER)
def summaries_by_tier(spark, d):
    return scans.summaries_by_tier(X.summaries(spark, d), 1, session="src1").select("id", "token_count")


@query(S.EXCLUDE_SESSION)
def exclude_session(spark, d):
    return scans.summaries_by_tier(X.summaries(spark, d), 1, exclude="src1").select("id", "session_id")


@query(S.SESSION_MEMORY)
def session_memory(spark, d):
    b = X.buffer(spark, d).select("session_id", "seq", F.concat(F.lit("["), _time("timestamp"), F.lit("] "), "content").alias("line"))
    return b.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("text"))


# --- forget and ingest ----------------------------------------------------------------------


def _forget(spark, d, action, remainder, correction=None):
    s, b = X.summaries(spark, d), X.buffer(spark, d)
    asked = s.where(F.col("seq") % 7 == remainder).select(F.col("id").alias("memory_id")).unionByName(b.where("seq = 1").select(F.col("id").alias("memory_id"))).select("memory_id", F.lit(action).alias("action"), F.lit(correction).cast("string").alias("correction"))
    v = X.vectors(spark, d).withColumn("source_id", F.col("id"))
    return forget.forget(s, b, v, asked)


def _rows(f):
    return f.summaries.select("id", "content", F.col("token_count").alias("tokens")).unionByName(f.buffer.select("id", "content", "tokens"))


@query(S.FORGET_DELETE)
def forget_delete(spark, d):
    return _rows(_forget(spark, d, "delete", 0))


@query(S.FORGET_DEPRECATE)
def forget_deprecate(spark, d):
    return _rows(_forget(spark, d, "deprecate", 1))


@query(S.FORGET_CORRECT)
def forget_correct(spark, d):
    return _rows(_forget(spark, d, "correct", 2, "This was wrong before."))


@query(S.FORGET_MESSAGES)
def forget_messages(spark, d):
    return _forget(spark, d, "delete", 3).messages


def _requests(spark, d):
    c = X.read(spark, d, "conversations")
    kind = F.element_at(F.array(*map(F.lit, [*ingest.TIERS, "rumour"])), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("content"), kind.alias("memory_type"), F.lit(None).cast("double").alias("confidence"), F.array(F.col("role"), F.concat(F.lit("conv"), F.col("conv_id").cast("string"))).alias("entities"))


@query(S.STORE_ROUTING)
def store_routing(spark, d):
    s = ingest.store(_requests(spark, d))
    return s.results


@query(S.STORE_RELATIONS)
def store_relations(spark, d):
    s = ingest.store(_requests(spark, d))
    state = graph.relation_state(s.relations.select("seq", F.col("subject").alias("subject_id"), "predicate", F.col("object").alias("object_id"), F.timestamp_seconds(F.col("seq.seq")).alias("temporal_start"), "confidence"))
    return state.select("seq.seq", "seq.n", "subject_id", "predicate", "object_id", F.col("temporal_end").isNull().alias("active"), "confidence")


# --- further getters and changes ------------------------------------------------------------


def _relations(spark, d, column, value):
    return scans.relations_by(X.graph(spark, d)[1], column, value).select("subject_id", "predicate", "object_id", "confidence")


@query(S.RELATIONS_BY_SUBJECT)
def relations_by_subject(spark, d):
    return _relations(spark, d, "subject_id", "n3")


@query(S.RELATIONS_BY_OBJECT)
def relations_by_object(spark, d):
    return _relations(spark, d, "object_id", "n3")


@query(S.RELATIONS_BY_PREDICATE)
def relations_by_predicate(spark, d):
    return _relations(spark, d, "predicate", "PART_of")


@query(S.ENTITY_BY_ID)
def entity_by_id(spark, d):
    return scans.by_id(X.graph(spark, d)[0], "n3").select("id", "label", "entity_type")


@query(S.ALL_ENTITIES)
def all_entities(spark, d):
    return scans.all_entities(X.graph(spark, d)[0]).select("id", "label", _time("updated_at").alias("updated"))


@query(S.SUMMARY_BY_ID)
def summary_by_id(spark, d):
    return scans.by_id(X.summaries(spark, d), "7").select("id", "tier", "token_count")


@query(S.SUMMARIES_BY_SESSION)
def summaries_by_session(spark, d):
    return scans.summaries_by_session(X.summaries(spark, d), "src2").select("id", "tier", _time("created_at").alias("created"))


@query(S.CORE_MEMORY)
def core_memory(spark, d):
    """Tier 3, newest first, by session."""
    core = X.summaries(spark, d).where("tier = 3").select("session_id", F.struct((-F.col("seq")).alias("o"), F.col("content").alias("c")).alias("x"))
    return core.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]), "\n").alias("text"))


@query(S.SESSION_INFO)
def session_info(spark, d):
    s = sessions.end(X.sessions(spark, d), "1", X.AS_OF)
    return sessions.info(s, "1").unionByName(sessions.info(s, "2")).select("id", _time("started_at").alias("started"), "is_active")


@query(S.NEIGHBORS_REACH)
def neighbors_reach(spark, d):
    """Breadth-first to four hops from the regions."""
    e, r = X.graph(spark, d)
    return graph.reach(e.where("id = 'r1'"), r, 4).select("id", F.col("hop").cast("long").alias("hop"))


@query(S.VECTORS_CHANGED)
def vectors_changed(spark, d):
    """Some vectors removed, some replaced by new ones of other content."""
    v = X.vectors(spark, d).withColumn("source_id", F.col("id"))
    kept = vectors.without(v, v.where("seq % 5 = 0").select("id"))
    new = X.summaries(spark, d).where("seq < 20").select("id", F.col("id").alias("source_id"), F.lit("summary").alias("source_type"), "content", F.lit(0.9).alias("confidence"))
    out = vectors.with_vectors(kept, new, vectors.zero_embedding(4), X.AS_OF)
    return out.select("id", "source_type", F.size("embedding").cast("long").alias("dimensions"), F.coalesce("content_preview", F.lit("")).alias("preview"))


@query(S.ACCESS_APPENDED)
def access_appended(spark, d):
    """The access log after a retrieval has added what it selected."""
    c = retrieval.score(retrieval.working_candidates(X.buffer(spark, d)))
    chosen = retrieval.selected_rows(retrieval.fill(c, FILL)).select(F.col("id").alias("memory_id"), F.col("source").alias("memory_type"), F.lit(X.AS_OF).cast("timestamp").alias("accessed_at"))
    return stats.access_frequency(X.access_log(spark, d).unionByName(chosen))


@query(S.CLEAR_SESSION)
def clear_session(spark, d):
    return sessions.without_session(X.buffer(spark, d), "1").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query(S.STATUS_TEXT)
def status_text(spark, d):
    return stats.status_text(status(spark, d), "1", X.AS_OF)


# --- whole-table getters, decay, upsert by id -------------------------------------------------


def _regions(spark, d):
    return X.graph(spark, d)[0].where("entity_type = 'region'").select("id")


@query(S.NEIGHBOR_RELATIONS)
def neighbor_relations(spark, d):
    out = graph.relations_around(_regions(spark, d), *X.graph(spark, d), depth=2)
    return out.withColumn("hop", F.col("hop").cast("long"))


@query(S.GRAPH_TEXT_2HOP)
def graph_text_2hop(spark, d):
    return graph.serialize_entity(_regions(spark, d), *X.graph(spark, d), depth=2)


@query(S.DECAY_ALL)
def decay_all(spark, d):
    e, r = X.graph(spark, d)
    r = r.withColumn("temporal_end", F.when(F.col("predicate") == "part_of", F.lit(X.AS_OF).cast("timestamp")))
    e, r, v = stats.apply_decay(e, r, X.vectors(spark, d), 0.2)
    rows = [e.select(F.lit("entity").alias("kind"), "id", "confidence"), r.select(F.lit("relation").alias("kind"), F.concat_ws(" ", "subject_id", "object_id").alias("id"), "confidence"), v.select(F.lit("vector").alias("kind"), "id", "confidence")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("confidence", F.round("confidence", 9))


@query(S.UPSERT_BY_ID)
def entity_upsert_by_id(spark, d):
    e = X.graph(spark, d)[0].withColumn("created_at", F.col("updated_at"))
    new = e.where("entity_type = 'nation'").select("id", F.upper("label").alias("label"), "entity_type", "confidence").unionByName(spark.sql("SELECT 'new' AS id, 'New' AS label, 'unknown' AS entity_type, 1.0D AS confidence"))
    return graph.upsert_by_id(e, new, X.AS_OF).select("id", "label", _time("created_at").alias("created"), _time("updated_at").alias("updated"))


@query(S.VECTOR_BY_ID)
def vector_by_id(spark, d):
    return scans.by_id(X.vectors(spark, d), "7").select("id", "source_type", F.size("embedding").cast("long").alias("dimensions"))


@query(S.ALL_VECTORS)
def all_vectors(spark, d):
    return scans.vectors_by_type(X.vectors(spark, d)).select("id", "source_type", F.round("confidence", 6).alias("confidence"))


@query(S.ALL_RELATIONS)
def all_relations(spark, d):
    return scans.active(X.graph(spark, d)[1]).orderBy(F.desc("confidence"), "subject_id", "object_id").select("subject_id", "predicate", "object_id", "confidence")


@query(S.WORKING_MEMORY)
def working_memory(spark, d):
    return scans.working_memory(X.buffer(spark, d)).select("id", "session_id", "seq", "content", "tokens")


@query(S.WORKING_COUNT)
def working_count(spark, d):
    b = X.buffer(spark, d)
    one = lambda s: scans.working_count(b, s).select(F.lit(s).alias("session_id"), "n")
    return one("1").unionByName(one("none"))


@query(S.CORE_MEMORY_ALL)
def core_memory_all(spark, d):
    s = X.summaries(spark, d)
    return scans.core_memory(s).select(F.lit("all").alias("scope"), "text").unionByName(scans.core_memory(s.limit(0)).select(F.lit("none").alias("scope"), "text"))


@query(S.COMPRESS_EPOCH_ALL)
def compress_epoch_all(spark, d):
    return compression.compress_epoch(X.summaries(spark, d)).select("content", "original_count", "original_tokens", "token_count")
