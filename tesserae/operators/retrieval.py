"""Budgeted context retrieval for all sessions at once: candidates, score, near-duplicates, fill, rendered text.

Texts stay out of the way: candidates are ids, token counts and scores until the fill has chosen; what is
rendered is bounded by the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.config import DEFAULTS
from tesserae.functions.scoring import composite, frequency, recency, source_priority
from tesserae.functions.text import estimate_tokens, word_set
from tesserae.operators.similarity import similar_pairs, word_classes
from tesserae.sources.workspace import shared_table

#: Similarity of every candidate, as nothing is searched for; id of a session's whole buffer.
SIMILARITY, WORKING = 0.6, "working-memory"
LABELS = {"working": "Current Session", "current_session": "Current Session Notes"}
# Fixed value: the text of a session without anything to show.
EMPTY = "No memories stored in this session yet. This is a fresh session — use memory_store to save important information as you go."


def effective_budget(budget: Column | int | None) -> Column:
    """The default for null and 0; a negative budget stays, and nothing fits it."""
    column = budget if isinstance(budget, Column) else F.lit(budget).cast("long")
    return F.coalesce(F.nullif(column, F.lit(0).cast("long")), F.lit(DEFAULTS["token_budgets"]["default_retrieve"]).cast("long"))


def working_candidates(buffer: DataFrame) -> DataFrame:
    """A session's whole buffer is one candidate; its tokens are those of the joined text."""
    text = F.sum(F.length("content")) + F.count(F.lit(1)) - 1
    return buffer.where("session_id is not null").groupBy("session_id").agg(F.ceil(text / 4).cast("long").alias("tokens")).select("session_id", F.lit(WORKING).alias("id"), F.lit("working").alias("source"), F.lit(0).cast("long").alias("ord"), "tokens", F.lit(1.0).alias("recency"), F.lit(1.0).alias("frequency"))


def access_counts(access_log: DataFrame) -> DataFrame:
    return access_log.groupBy(F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).alias("accesses"))


def summary_candidates(summaries: DataFrame, access_log: DataFrame, as_of: str) -> DataFrame:
    """Tier 1 of each session, newest first; ord follows that order."""
    s = summaries.where("tier = 1 and session_id is not null").join(access_counts(access_log), "id", "left")
    return s.select("session_id", "id", F.lit("current_session").alias("source"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("ord"), F.col("token_count").alias("tokens"), recency(F.col("created_at"), F.lit(as_of)).alias("recency"), frequency(F.col("accesses")).alias("frequency"))


def score(candidates: DataFrame, weights: dict | None = None) -> DataFrame:
    return candidates.withColumn("score", composite(F.lit(SIMILARITY), F.col("recency"), source_priority(F.col("source")), F.col("frequency"), weights))


def dedup_greedy(scored: DataFrame, words: DataFrame, threshold: float = DEFAULTS["ranking"]["dedup_threshold"]) -> DataFrame:
    """The scored candidates (session_id, id, ord, score, ...) that a greedy pass keeps.

    In order, a candidate is compared with those kept; the first similar one decides: a lower-scored one is
    replaced in place, else the candidate is dropped. words: session_id, id, words. Only candidates that are similar to
    any other, as word sets of their session, are gathered for the pass, as ids; copies share one set.
    """
    keyed = shared_table(words.join(scored.select("session_id", "id"), ["session_id", "id"]), "words")
    classes = shared_table(word_classes(keyed, "session_id", "id"), "classes")
    sets = keyed.join(classes.where("id = set_id").select("session_id", "id"), ["session_id", "id"], "left_semi")
    pairs = similar_pairs(sets, "session_id", "id", threshold)
    both = pairs.select("session_id", F.col("a").alias("set_id"), F.col("b").alias("near")).unionByName(pairs.select("session_id", F.col("b").alias("set_id"), F.col("a").alias("near")))
    near = both.groupBy("session_id", "set_id").agg(F.collect_set("near").alias("near"))
    copies = classes.groupBy("session_id", "set_id").agg(F.count(F.lit(1)).alias("n"))
    linked = classes.join(copies, ["session_id", "set_id"]).join(near, ["session_id", "set_id"], "left").where("n > 1 or near is not null").select("session_id", "id", "set_id", F.coalesce("near", F.array().cast("array<string>")).alias("near"))
    linked = shared_table(linked, "linked")
    rows = linked.join(scored.select("session_id", "id", "ord", "score"), ["session_id", "id"])
    ordered = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "score", "set_id", "near"))).alias("xs"))
    kept_type = "array<struct<id:string,score:double,set_id:string>>"

    def step(acc: Column, x: Column) -> Column:
        one = F.array(F.struct(x["id"].alias("id"), x["score"].alias("score"), x["set_id"].alias("set_id")))
        similar = F.transform(acc, lambda k: (k["set_id"] == x["set_id"]) | F.array_contains(x["near"], k["set_id"]))
        # an aggregate over one element binds the position, which would be found anew for each element else
        placed = lambda _, at: F.when(at == 0, F.concat(acc, one)).otherwise(F.transform(acc, lambda k, i: F.when((i == at - 1) & (x["score"] > k["score"]), one[0]).otherwise(k)))
        return F.aggregate(F.array(F.array_position(similar, True)), acc, placed)

    passed = ordered.select("session_id", F.explode(F.aggregate("xs", F.array().cast(kept_type), step)).alias("k")).select("session_id", F.col("k.id").alias("id"))
    gone = linked.select("session_id", "id").join(passed, ["session_id", "id"], "left_anti")
    return scored.join(gone, ["session_id", "id"], "left_anti")


def fill(scored: DataFrame, budget: Column | int | None = None) -> DataFrame:
    """One row a session: effective budget, candidates considered, those selected by score, budget used; a candidate that doesn't fit is skipped, not the end."""
    limit = effective_budget(budget)
    # a candidate beyond the budget can't be taken, so only its rank would be lost: it isn't gathered
    grouped = scored.withColumn("budget", limit).groupBy("session_id").agg(F.max("budget").alias("budget"), F.count(F.lit(1)).alias("considered"), F.array_sort(F.collect_list(F.when(F.col("tokens") <= F.col("budget"), F.struct((-F.col("score")).alias("neg"), "ord", "id", "source", "tokens")))).alias("xs"))
    zero = F.struct(F.col("budget").alias("rem"), F.array().cast("array<struct<id:string,source:string,tokens:bigint>>").alias("sel"))
    step = lambda acc, x: F.when(x["tokens"] <= acc["rem"], F.struct((acc["rem"] - x["tokens"]).alias("rem"), F.concat(acc["sel"], F.array(F.struct(x["id"].alias("id"), x["source"].alias("source"), x["tokens"].alias("tokens")))).alias("sel"))).otherwise(acc)
    return grouped.select("session_id", "budget", "considered", F.aggregate("xs", zero, step).alias("f")).select("session_id", "budget", "considered", F.col("f.sel").alias("selected"), (F.col("budget") - F.col("f.rem")).alias("budget_used"))


def selected_rows(filled: DataFrame) -> DataFrame:
    """One row for each selected candidate, for the access log: session_id, rank, id, source, tokens."""
    return filled.select("session_id", F.posexplode("selected").alias("rank", "s")).select("session_id", F.col("rank").cast("long").alias("rank"), F.col("s.id").alias("id"), F.col("s.source").alias("source"), F.col("s.tokens").alias("tokens"))


def render(filled: DataFrame, buffer: DataFrame, summaries: DataFrame) -> DataFrame:
    """Adds sources, text and total_tokens to what `fill` returns."""
    rows = selected_rows(filled)
    working = buffer.join(rows.where(F.col("source") == "working").select("session_id", "rank"), "session_id").groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "\n").alias("body")).withColumn("source", F.lit("working"))
    notes = rows.where(F.col("source") == "current_session").join(summaries.select("id", "content"), "id").groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n").alias("body")).withColumn("source", F.lit("current_session"))
    label = F.when(F.col("source") == "working", LABELS["working"]).otherwise(LABELS["current_session"])
    order = F.when(F.col("source") == "working", 0).otherwise(1)
    sections = working.unionByName(notes).select("session_id", F.struct(order.alias("o"), F.concat(F.lit("["), label, F.lit("] "), F.col("body")).alias("t")).alias("s")).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n\n").alias("body"))
    counts = rows.groupBy("session_id", "source").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "source", "n"))), lambda x: F.concat(x["source"], F.lit(":"), x["n"].cast("string"))), ", ").alias("sources"))
    footer = F.concat(F.lit("\n\n--- Session: "), F.substring("session_id", 1, 20), F.lit(" | Sources: "), F.col("sources"), F.lit(" | Tokens: "), F.col("budget_used").cast("string"), F.lit("/"), F.col("budget").cast("string"), F.lit(" ---"))
    out = filled.join(sections, "session_id", "left").join(counts, "session_id", "left")
    out = out.withColumn("text", F.when(F.col("body").isNotNull(), F.concat("body", footer)).otherwise(EMPTY))
    return out.select("session_id", "considered", F.size("selected").cast("long").alias("n_selected"), "budget_used", (F.col("budget") - F.col("budget_used")).alias("budget_remaining"), F.coalesce("sources", F.lit("")).alias("sources"), "text", estimate_tokens(F.col("text")).alias("total_tokens"))


def candidate_words(candidates: DataFrame, buffer: DataFrame, summaries: DataFrame) -> DataFrame:
    """Word sets of candidates; a buffer's only where its session has other candidates to be similar to."""
    notes = candidates.where(F.col("source") == "current_session").select("session_id", "id")
    of_notes = notes.join(summaries.select("id", word_set(F.col("content")).alias("words")), "id")
    mixed = candidates.where(F.col("source") == "working").select("session_id").join(notes.select("session_id").distinct(), "session_id", "left_semi")
    of_buffer = buffer.join(mixed, "session_id", "left_semi").select("session_id", F.explode(word_set(F.col("content"))).alias("w")).groupBy("session_id").agg(F.collect_set("w").alias("words")).select("session_id", F.lit(WORKING).alias("id"), "words")
    return of_notes.select("session_id", "id", "words").unionByName(of_buffer)


def assemble(buffer: DataFrame, summaries: DataFrame, access_log: DataFrame, as_of: str, budget: Column | int | None = None, config: dict = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """One row of context for each session, and the rows that the read adds to the access log."""
    ranking = config["ranking"]
    candidates = shared_table(score(working_candidates(buffer).unionByName(summary_candidates(summaries, access_log, as_of)), ranking), "candidates")
    unique = dedup_greedy(candidates, candidate_words(candidates, buffer, summaries), ranking["dedup_threshold"])
    considered = candidates.groupBy("session_id").agg(F.count(F.lit(1)).alias("all"))
    filled = shared_table(fill(unique, budget).join(considered, "session_id").withColumn("considered", F.col("all")).drop("all"), "filled")
    log = selected_rows(filled).select(F.col("id").alias("memory_id"), F.col("source").alias("memory_type"), F.lit(as_of).cast("timestamp").alias("accessed_at"))
    return render(filled, buffer, summaries), log
