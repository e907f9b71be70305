"""Folds against plain models on random inputs, edge cases, golden texts, the store, the façade and the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tesserae import config
from tesserae.api import Memory
from tesserae.functions import scoring, text
from tesserae.operators import compression, forget, graph, ingest, retrieval, scans, sessions, similarity, stats, vectors
from tesserae.sources.store import Store
from tesserae.streaming.buffer import access_counts_stream, overflow_stream

AS_OF = "2024-02-01 00:00:00"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_config(tmp_path):
    bad, good = tmp_path / "bad.json", tmp_path / "good.json"
    bad.write_text("{")
    good.write_text(json.dumps({"ranking": {"recency": 0.5, "semantic": None}, "x": [1]}))
    got = config.load([str(tmp_path / "none.json"), str(bad), str(good)])
    assert got["ranking"]["recency"] == 0.5 and got["ranking"]["semantic"] == 0.4 and got["x"] == [1]
    assert config.load() == config.DEFAULTS and config.merge({"a": [1, 2]}, {"a": [3]}) == {"a": [3]}


@pytest.mark.parametrize("value, count, label", [("a b c d e f g h i", 9, "rejected"), ("a b c d e f g h i j", 10, "brief"), (" ".join("x" * 24), 24, "brief"), (" ".join("x" * 25), 25, "ok"), ("   ", 1, "rejected"), ("a b", 2, "rejected"), ("　a b﻿", 2, "rejected")])
def test_quality(spark, value, count, label):
    assert one(spark, text.word_count, value) == count and one(spark, text.quality, value) == label


def test_text_functions(spark):
    assert [one(spark, text.estimate_tokens, v) for v in (None, "", "a", "abcd", "abcde")] == [0, 0, 1, 1, 2]
    assert [one(spark, lambda c: text.to_fixed(c, 2), v, "double") for v in (1.005, 0.125, 0.375, 1234.5, 0.1, -0.125)] == ["1.00", "0.13", "0.38", "1234.50", "0.10", "-0.13"]
    assert one(spark, lambda c: text.to_fixed(c, 1), 0.25, "double") == "0.3"
    assert one(spark, text.infer_predicate, "She knows about it") == "knows" and one(spark, text.infer_predicate, "éhas it") == "has" and one(spark, text.infer_predicate, "xhas") == "related_to"
    assert one(spark, text.entity_mentions, 'The Foo met "x y" and Bar Baz. The') == ["The Foo", "Bar Baz", "x y"]
    assert one(spark, lambda c: text.sentence_chunks(c, 3), "...Hello there. Bye now! ok") == ["Hello there.", "Bye now!", "ok"]
    assert one(spark, lambda c: text.sentence_chunks(c, 3), "") == [] and one(spark, lambda c: text.sentence_chunks(c, 3), "short") == ["short"]
    assert one(spark, text.preview, "x" * 201) == "x" * 200 + "..." and one(spark, text.preview, "x" * 200) == "x" * 200
    assert "the text" in one(spark, lambda c: text.prompt("extract_facts", c), "the text")
    with pytest.raises(ValueError):
        text.prompt("nothing", F.lit(""))
    assert scoring.decode_vector(scoring.encode_vector([1.5, -2.0])) == [1.5, -2.0]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r["c"] for r in v.select(scoring.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0]


def test_relation_queue(spark):
    r = random.Random(1)
    log, expected, seq = [], {}, 0
    for key in range(40):
        queue = []
        for _ in range(r.randint(1, 9)):
            obj = r.choice("ABC")
            if queue and queue[0][1] != obj:
                expected[queue.pop(0)[0]] = seq
            queue.append((seq, obj))
            log.append((seq, f"s{key}", "p", obj, 1.0))
            seq += 1
    df = spark.createDataFrame(log, "seq long, subject_id string, predicate string, object_id string, confidence double").withColumn("temporal_start", F.timestamp_seconds("seq"))
    got = {x["seq"]: x for x in graph.relation_state(df).withColumn("e", F.unix_timestamp("temporal_end")).collect()}
    assert {s: x["e"] for s, x in got.items() if x["e"] is not None} == expected
    assert all(x["confidence"] == (0.5 if s in expected else 1.0) for s, x in got.items())


def test_entity_state(spark):
    log = spark.createDataFrame([(1, "Ann", "t1", 0.5), (2, "ANN", "t2", 0.5), (3, "ann", "t3", 0.7), (4, "Ann", "t4", 0.6), (5, "Àn", "x", 1.0), (6, "àn", "y", 1.0)], "seq long, label string, entity_type string, confidence double")
    got = {(x["label"], x["entity_type"], x["confidence"], x["created_seq"]) for x in graph.entity_state(log).collect()}
    assert got == {("ann", "t3", 0.7, 1), ("Àn", "x", 1.0, 5), ("àn", "y", 1.0, 6)}


def plain_dedup(xs, near):
    kept = []
    for i, score in xs:
        at = next((n for n, (k, _) in enumerate(kept) if frozenset((i, k)) in near), None)
        if at is None:
            kept.append((i, score))
        elif score > kept[at][1]:
            kept[at] = (i, score)
    return {i for i, _ in kept}


def test_dedup_and_fill(spark):
    r = random.Random(2)
    rows, sets = [], {}
    for s in range(4):
        for n in range(14):
            words = sorted({r.choice("abcdefgh") * 3 for _ in range(r.randint(1, 6))})
            i = f"{s}-{n:02}"
            sets[i] = set(words)
            rows.append((f"s{s}", i, n, r.choice([0.1, 0.2, 0.3]), words, r.randint(1, 40)))
    df = spark.createDataFrame(rows, "session_id string, id string, ord long, score double, words array<string>, tokens long").withColumn("source", F.lit("current_session"))
    for t in (0.4, 0.6, 1.0):
        near = {frozenset((a, b)) for a in sets for b in sets if a < b and a[0] == b[0] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        expected = set().union(*(plain_dedup([(x[1], x[3]) for x in rows if x[0] == f"s{s}"], near) for s in range(4)))
        got = {x["id"] for x in retrieval.dedup_greedy(df.drop("words"), df.select("session_id", "id", "words"), t).collect()}
        assert got == expected, t
    for budget in (0, None, -5, 1, 60):
        got = {x["session_id"]: (x["considered"], [y["id"] for y in x["selected"]], x["budget_used"]) for x in retrieval.fill(df, budget).collect()}
        for s in range(4):
            left, chosen = budget or 8000, []
            for x in sorted((x for x in rows if x[0] == f"s{s}"), key=lambda x: (-x[3], x[2])):
                if x[5] <= left:
                    left, chosen = left - x[5], [*chosen, x[1]]
            assert got[f"s{s}"] == (14, chosen, (budget or 8000) - left)


def test_similar_pairs_threshold(spark):
    with pytest.raises(ValueError):
        similarity.similar_pairs(spark.range(1).select(F.lit("g").alias("g"), "id", F.array().cast("array<string>").alias("words")), "g", "id", 0)


def test_overflow(spark):
    r = random.Random(3)
    rows = [(f"s{s}", n, f"{s}-{n}", r.randint(1, 30), "x") for s in range(10) for n in range(r.randint(1, 12))]
    df = spark.createDataFrame(rows, "session_id string, seq long, id string, tokens long, content string")
    expected = set()
    for s in range(10):
        held, run = [], 0
        for x in (x for x in rows if x[0] == f"s{s}"):
            held.append(x)
            if sum(y[3] for y in held) > 50 and len(held) >= 2:
                half = len(held) // 2
                expected |= {(x[0], run, y[2]) for y in held[:half]}
                held, run = held[half:], run + 1
    assert {tuple(x) for x in compression.overflow_runs(df, 50).collect()} == expected
    made, left = compression.compress_overflow(df, 50)
    assert left.count() + len(expected) == len(rows) and made.count() == len({x[:2] for x in expected})


def test_compression_cuts(spark):
    df = spark.createDataFrame([("s", n, f"i{n}", "abcdefgh", 2) for n in range(30)], "session_id string, seq long, id string, content string, tokens long")
    got = compression.report(compression.compress_buffer(df, budget=5)).first()
    assert got["content"] == "\n".join(["abcdefgh"] * 30)[:20] and (got["original_count"], got["original_tokens"], got["token_count"]) == (30, 60, 5)
    assert got["message"] == "Compressed 30 working memory entries (60 tokens) into Tier 1 summary (5 tokens). Compression ratio: 12.0x"
    assert compression.compress_buffer(df.limit(0)).count() == 0


def test_graph_reads(spark):
    e = spark.createDataFrame([(x, x.upper(), "t", 1.0, 0) for x in "abcd"], "id string, label string, entity_type string, confidence double, updated_at int").withColumn("updated_at", F.timestamp_seconds("updated_at"))
    r = spark.createDataFrame([("a", "p", "b", 0.5), ("b", "p", "c", 1.0), ("c", "q", "d", 1.0), ("a", "p", "a", 1.0), ("a", "p", "zz", 1.0)], "subject_id string, predicate string, object_id string, confidence double").withColumn("temporal_end", F.lit(None).cast("timestamp"))
    roots = e.where("id = 'a'")
    assert {(x["id"], x["hop"]) for x in graph.neighbours(roots, r, 5).collect()} == {("b", 1), ("zz", 1), ("c", 2)}
    assert {(x["id"], x["hop"]) for x in graph.reach(roots, r, 3).collect()} == {("b", 1), ("zz", 1), ("c", 2), ("d", 3)}
    assert graph.facts(e, r).count() == 4
    assert graph.serialize_entity(roots, e, r).first()["text"] == "Entity: A (t)\n  → p → A\n  → p → B [conf:0.50]\n  ← A → p"  # a relation to itself shows on both sides
    left_e, left_r = graph.remove_entities(e, r, spark.createDataFrame([("B",)], "label string"))
    assert left_e.count() == 3 and left_r.count() == 3
    labels = spark.createDataFrame([("1", "50%_x", 1.0), ("2", "a\\b", 1.0)], "id string, label string, confidence double")
    assert [x["id"] for x in scans.search_entities(labels, "%_X").collect()] == ["1"] and [x["id"] for x in scans.search_entities(labels, "a\\B").collect()] == ["2"]


def test_vectors(spark):
    v = spark.createDataFrame([("1", 1, "a", [1.0, 0.0], 0.9), ("2", 2, "b", [0.0, 1.0], 0.2), ("3", 3, "a", [0.0, 0.0], 0.9), ("4", 4, "a", [1.0], 0.9)], "id string, seq long, source_type string, embedding array<double>, confidence double").withColumn("created_at", F.timestamp_seconds(F.col("seq")))
    assert [x["id"] for x in vectors.search(v, [1.0, 0.0], 3).collect()] == ["1", "4", "3"]
    assert [x["id"] for x in vectors.search(v, [0.0, 0.0], 2).collect()] == ["4", "3"]
    assert [x["id"] for x in vectors.search(v, [1.0, 0.0], 9, source_types=["a"], min_confidence=0.5, after="1970-01-01 00:00:03", before="").collect()] == ["4", "3"]
    with pytest.raises(ValueError):
        vectors.search(v, [1.0], -1)


def test_ingest_and_forget(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [("1", 1, "s", long, "fact", 0.5, ["S", "A", "B"]), ("2", 2, "s", long, "preference", None, ["Tea"]), ("3", 3, "s", long, "rumour", None, None), ("4", 4, "s", "too short", "core", None, None), ("5", 5, "s", long, None, None, ["S"]), ("6", 6, "s", None, "core", None, None)]
    stored = ingest.store(spark.createDataFrame(rows, "id string, seq long, session_id string, content string, memory_type string, confidence double, entities array<string>"))
    assert {tuple(x) for x in stored.results.select("id", "tier", "facts_stored").collect()} == {("1", 1, 2), ("2", 2, 1), ("3", 0, 0), ("4", None, 0), ("5", 0, 0), ("6", None, 0)}
    assert {(x["subject"], x["predicate"], x["object"]) for x in stored.relations.collect()} == {("S", "related_to", "A"), ("S", "related_to", "B"), ("User", "prefers", "Tea")}
    assert [x["id"] for x in stored.buffer.collect()] == ["5"] and stored.vectors.count() == 3
    s = stored.summaries.select("id", "tier", "content", "token_count", "session_id")
    v = spark.createDataFrame([("v", "1")], "id string, source_id string")
    ask = lambda *x: spark.createDataFrame([x], "memory_id string, action string, correction string")
    say = lambda *x: forget.forget(s, stored.buffer, v, ask(*x)).messages.first()["message"]
    assert say("1", "delete", None) == "Deleted memory 1 (was Tier 1 summary)." and say("1", None, None) == "Deprecated memory 1." and say("1", "correct", "") == "Correction text required for 'correct' action."
    assert say("5", "deprecate", None) == "Memory 5 not found." and say("5", "correct", "x") == "Corrected working memory entry 5." and say("9", "delete", None) == "Memory 9 not found."
    done = forget.forget(s, stored.buffer, v, ask("1", "correct", "new"))
    assert done.vectors.count() == 0 and done.reembed.first()["source_type"] == "summary" and done.summaries.where("content = 'new' and token_count = 1").count() == 1


def test_stats_and_sessions(spark):
    assert one(spark, lambda c: F.round(stats.decayed(c, 0.5, 4), 6), 0.5, "double") == 0.0625 and one(spark, lambda c: stats.decayed(c, 0.5, 2), 0.1, "double") == 0.1
    buffer = spark.createDataFrame([("a", "s1", 1, "text", 1)], "id string, session_id string, seq long, content string, tokens long")
    table = spark.createDataFrame([("s1", None, None, "{}")], "id string, started_at timestamp, ended_at timestamp, metadata string")
    new, after, archived, empty = sessions.start(spark, table, buffer, AS_OF, "s1")
    assert after.where("id = 's1' and ended_at is not null").count() == 1 and sessions.info(after, new).first()["is_active"] and archived.first()["content"] == "text" and empty.count() == 0


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.table("sessions").count() == 0
    store.put("sessions", spark.createDataFrame([("a", "{}"), ("b", "{}")], "id string, metadata string"))
    store.put("sessions", spark.createDataFrame([("a", "{1}")], "id string, metadata string"))
    store.delete("sessions", spark.createDataFrame([("b",)], "id string"))
    assert [tuple(x) for x in store.table("sessions").select("id", "metadata").collect()] == [("a", "{1}")]
    assert store.snapshot().table("sessions").count() == 1
    assert store.query("SELECT id FROM sessions WHERE id = :x", {"x": "a"}).count() == 1


def test_api(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "m"))
    memory.session_start("2024-01-01 00:00:00")
    long = "Ann works at the harbour office since spring and likes it there very much."
    assert memory.memory_store("short", as_of=AS_OF).startswith("REJECTED: Memory too short (1 words)")
    assert "Tier 0" in memory.memory_store(long, as_of="2024-01-01 00:01:00")
    assert "Facts stored: 1" in memory.memory_store(long, "fact", 0.9, ["Ann", "Harbour"], "2024-01-01 00:02:00")
    memory.memory_store(long, "fact", 0.9, ["ann", "Office"], "2024-01-01 00:03:00")
    memory.memory_store(long, "core", as_of="2024-01-01 00:04:00")
    seen = memory.memory_retrieve("anything", as_of="2024-01-01 01:00:00")
    assert seen.startswith("[Current Session] " + long) and "Sources: working:1" in seen
    assert memory.resource("memory://core") == long and long in memory.resource("memory://session/current")
    relations = memory.store.table("relations")
    assert relations.count() == 2 and relations.where("temporal_end is null").count() == 1
    assert json.loads(memory.resource("memory://graph/schema"))["predicates"] == ["works_at"]
    assert json.loads(memory.resource("memory://stats"))["tier0_count"] == 1 and "Tier 3 (Core):     1 entries" in memory.memory_status("2024-01-01")
    assert memory.memory_compress("working", "2024-01-01 02:00:00").startswith("Compressed 1 working memory entries")
    assert memory.memory_compress("working", AS_OF) == "Working memory is empty, nothing to compress." and memory.memory_compress("x") == "Unknown compression scope: x"
    assert memory.memory_forget("nothing", "delete", as_of=AS_OF) == "Memory nothing not found."
    memory.session_start("2024-01-03 00:00:00")
    assert memory.memory_retrieve("anything", as_of=AS_OF) == retrieval.EMPTY
    with pytest.raises(ValueError):
        memory.resource("memory://none")


def test_streams(spark, tmp_path):
    rows = [(f"s{n % 2}", n, f"i{n}", "x" * 40) for n in range(12)]
    schema = "session_id string, seq long, id string, content string"
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    q = overflow_stream(spark.readStream.schema(schema).parquet(src), 25).writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["session_id"], r["run"], i) for r in spark.table("runs").collect() for i in r["ids"]}
    batch = spark.createDataFrame([(*r, 10) for r in rows], schema + ", tokens long")
    assert got == {tuple(x) for x in compression.overflow_runs(batch, 25).collect()} and got
    log = str(tmp_path / "log")
    spark.createDataFrame([("m", n * 3600) for n in range(60)], "memory_id string, t long").select("memory_id", F.timestamp_seconds("t").alias("accessed_at")).write.parquet(log)
    q = access_counts_stream(spark.readStream.schema("memory_id string, accessed_at timestamp").parquet(log)).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["n"] for r in spark.table("counts").collect()) == 60


def test_large_requests_keep_their_order(spark):
    """What one request stores never mixes with the next's, however much it is."""
    text = " ".join(f"word{i}" for i in range(12))
    names = ["Ann", *[f"e{i}" for i in range(2000)]]
    rows = spark.createDataFrame([("a", 1, "s", text, "fact", 1.0, names), ("b", 2, "s", text, "fact", 1.0, ["Ann", "x", "y"])], "id string, seq long, session_id string, content string, memory_type string, confidence double, entities array<string>")
    log = ingest.store(rows).relations
    assert log.count() == 2002 and log.select("seq").distinct().count() == 2002
    last = log.orderBy(F.desc("seq")).limit(2).collect()
    assert [r["object"] for r in last] == ["y", "x"]
