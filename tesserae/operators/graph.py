"""Temporal entity-relation graph: entity upserts, relation supersession, triples, neighbourhoods, schema, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import fold_ascii, to_fixed
from tesserae.operators.scans import active
from tesserae.sources.workspace import shared_table, ship

# --- folds of logs --------------------------------------------------------------------------


def entity_state(log: DataFrame) -> DataFrame:
    """Entities after a log of (seq, label, entity_type, confidence): one row for each label without ASCII case.

    The first row creates; a later one overwrites label, type and confidence only with a strictly higher
    confidence. So the state is the earliest row of the highest confidence, with the first row's
    time of creation: two aggregates with a partial stage, and no fold.
    """
    best = F.min_by(F.struct("label", "entity_type", "confidence", "seq"), F.struct(-F.col("confidence"), "seq"))
    return log.groupBy(fold_ascii(F.col("label")).alias("label_key")).agg(best.alias("b"), F.min("seq").alias("created_seq")).select("label_key", F.col("b.label").alias("label"), F.col("b.entity_type").alias("entity_type"), F.col("b.confidence").alias("confidence"), "created_seq", F.col("b.seq").alias("updated_seq"))


def relation_state(log: DataFrame) -> DataFrame:
    """Relations after a log of (seq, subject_id, predicate, object_id, temporal_start, confidence).

    A new relation closes the oldest active one of its subject and predicate, if that has another object: its
    end is then the new one's start and its confidence halves. With the same object nothing is closed and both stay.
    As a queue: push always, pop the head exactly if its object differs. A key's relations are streamed in order, and
    only what is still in its queue is held, as ids; a null object closes nothing and isn't closed.
    """
    ship(log.sparkSession)
    log = shared_table(log, "relations")  # read twice
    kind = log.schema["seq"].dataType.simpleString()
    rows = log.select("subject_id", "predicate", "seq", "object_id", F.col("temporal_start").cast("timestamp").alias("at"))
    sorted_rows = rows.repartition("subject_id", "predicate").sortWithinPartitions("subject_id", "predicate", "seq")
    closed = sorted_rows.mapInArrow(_closed, f"seq {kind}, temporal_end timestamp")
    return log.join(closed, "seq", "left").withColumn("confidence", F.when(F.col("temporal_end").isNotNull(), F.col("confidence") * 0.5).otherwise(F.col("confidence")))


def _closed(batches):
    """Of rows in order of subject, predicate and seq: each one that a later one closes, with the start of that one."""
    from collections import deque

    import pyarrow as pa

    key, queue = None, deque()
    for batch in batches:
        columns = [batch.column(k) for k in range(5)]
        seqs, ends = [], []
        for subject, predicate, seq, other, at in zip(*(c.to_pylist() if k < 4 else range(len(c)) for k, c in enumerate(columns)), strict=True):
            if (subject, predicate) != key:
                key, queue = (subject, predicate), deque()
            if queue and None not in (queue[0][0], other) and queue[0][0] != other:
                seqs.append(queue.popleft()[1])
                ends.append(at)
            queue.append((other, seq))
        ended = columns[4].take(pa.array(ends, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(seqs, columns[2].type), ended], names=["seq", "temporal_end"])


# --- reads ----------------------------------------------------------------------------------


def facts(entities: DataFrame, relations: DataFrame, predicate: str | None = None) -> DataFrame:
    """Active triples by label; a relation with an unknown end is left out."""
    rel = active(relations)
    if predicate is not None:
        rel = rel.where(fold_ascii(F.col("predicate")) == fold_ascii(F.lit(predicate)))
    end = lambda p: entities.select(F.col("id").alias(f"{p}_id"), F.col("label").alias(p), F.col("entity_type").alias(f"{p}_type"))
    return rel.join(end("subject"), "subject_id").join(end("object"), "object_id").select("subject_id", "subject", "subject_type", "predicate", "object_id", "object", "object_type", "confidence")


def _edges(relations: DataFrame) -> DataFrame:
    """Active relations from both ends: at, other, outgoing."""
    rel = active(relations)
    return rel.select(F.col("subject_id").alias("at"), F.col("object_id").alias("other"), F.lit(True).alias("outgoing"), "predicate", "confidence").unionByName(rel.select(F.col("object_id").alias("at"), F.col("subject_id").alias("other"), F.lit(False).alias("outgoing"), "predicate", "confidence"))


def neighbours(roots: DataFrame, relations: DataFrame, hops: int = 1) -> DataFrame:
    """(root, id, hop): entities at one hop of each root (column id), and at two hops that are neither root nor at one.

    More than two hops give two; `reach` goes further.
    """
    edges = _edges(relations).select("at", "other").distinct()
    first = roots.select(F.col("id").alias("root")).distinct().join(edges, F.col("root") == F.col("at")).select("root", F.col("other").alias("id")).where("id != root").distinct()
    out = first.withColumn("hop", F.lit(1))
    if hops > 1:
        second = first.join(edges, F.col("id") == F.col("at")).select("root", F.col("other").alias("id")).where("id != root").distinct().join(first, ["root", "id"], "left_anti")
        out = out.unionByName(second.withColumn("hop", F.lit(2)))
    return out


def reach(roots: DataFrame, relations: DataFrame, hops: int) -> DataFrame:
    """Breadth-first over any number of hops: each further entity at its least distance. Every hop is written, so none is computed again."""
    edges = shared_table(_edges(relations).select("at", "other").distinct(), "edges")
    seen = roots.select(F.col("id").alias("root")).distinct().withColumns({"id": F.col("root"), "hop": F.lit(0)})
    edge = seen
    for hop in range(1, hops + 1):
        edge = edge.join(edges, F.col("id") == F.col("at")).select("root", F.col("other").alias("id")).distinct().join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("hop", F.lit(hop))
        edge = shared_table(edge, "hop")
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen.where("hop > 0")


def find_entity(entities: DataFrame, label: str) -> DataFrame:
    """By label without ASCII case, else the most confident label that contains it; at most one row."""
    key, name = fold_ascii(F.lit(label)), fold_ascii(F.col("label"))
    exact = F.when(name == key, 0).when(F.like(name, F.concat(F.lit("%"), key, F.lit("%")), F.lit("\u0001")), 1)
    return entities.withColumn("_rank", exact).where("_rank is not null").orderBy("_rank", F.when(F.col("_rank") == 1, -F.col("confidence")), "id").limit(1).drop("_rank")


def schema(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entity types by last update and active predicates by highest confidence: kind, name, position."""
    from pyspark.sql import Window as W

    types = entities.groupBy(F.col("entity_type").alias("name")).agg(F.max(F.unix_micros(F.col("updated_at").cast("timestamp"))).cast("double").alias("k")).withColumn("kind", F.lit("entity_type"))
    predicates = active(relations).groupBy(F.col("predicate").alias("name")).agg(F.max("confidence").alias("k")).withColumn("kind", F.lit("predicate"))
    return types.unionByName(predicates).select("kind", "name", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("k"), "name")).cast("long").alias("position"))


def stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Counts of entities and of active relations."""
    return entities.agg(F.count(F.lit(1)).alias("entities")).crossJoin(active(relations).agg(F.count(F.lit(1)).alias("relations")))


def _percent(confidence: Column) -> Column:
    # Fixed value: how a confidence below 1 is shown.
    return F.when(confidence < 1, F.concat(F.lit(" [conf:"), to_fixed(confidence, 2), F.lit("]"))).otherwise("")


def serialize_facts(triples: DataFrame) -> DataFrame:
    """A line for each triple."""
    return triples.withColumn("line", F.concat("subject", F.lit(" → "), "predicate", F.lit(" → "), "object", _percent(F.col("confidence"))))


def relations_around(roots: DataFrame, entities: DataFrame, relations: DataFrame, depth: int = 1) -> DataFrame:
    """(root, hop, via, other, outgoing, predicate, confidence): active relations of each root, and, beyond depth 1, those of its known
    neighbours that lead to what is neither the root nor at one hop. outgoing: from `via`, which is the root or a neighbour."""
    edges = _edges(relations)
    first = roots.select(F.col("id").alias("root")).distinct().join(edges, F.col("root") == F.col("at")).withColumn("hop", F.lit(1))
    out = first
    if depth > 1:
        near = first.select("root", F.col("other").alias("n")).distinct()
        known = near.join(entities.select(F.col("id").alias("n")).distinct(), "n", "left_semi").where("n != root")
        second = known.join(edges, F.col("n") == F.col("at")).where("other != root").join(near.withColumnRenamed("n", "other"), ["root", "other"], "left_anti").drop("n")
        out = out.unionByName(second.withColumn("hop", F.lit(2)))
    return out.select("root", "hop", F.col("at").alias("via"), "other", "outgoing", "predicate", "confidence")


def serialize_entity(roots: DataFrame, entities: DataFrame, relations: DataFrame, depth: int = 1) -> DataFrame:
    """(id, text): a header and a line for each relation whose other end is known: outgoing first, nearer first, surer first."""
    named = entities.select(F.col("id").alias("other"), F.col("label").alias("other_label"))
    lines = relations_around(roots, entities, relations, depth).join(named, "other")
    forth = F.concat(F.lit("  → "), "predicate", F.lit(" → "), "other_label", _percent(F.col("confidence")))
    back = F.concat(F.lit("  ← "), "other_label", F.lit(" → "), "predicate", _percent(F.col("confidence")))
    place = F.struct((~F.col("outgoing")).alias("o"), "hop", F.when(F.col("hop") > 1, F.col("via")).otherwise("").alias("v"), (-F.col("confidence")).alias("c"), "other", F.when(F.col("outgoing"), forth).otherwise(back).alias("line"))
    grouped = lines.groupBy(F.col("root").alias("id")).agg(F.array_sort(F.collect_list(place)).alias("xs"))
    head = F.concat(F.lit("Entity: "), F.col("label"), F.lit(" ("), F.col("entity_type"), F.lit(")"))
    body = F.array_join(F.transform("xs", lambda x: x["line"]), "\n")
    return roots.select("id").join(entities.select("id", "label", "entity_type"), "id").join(grouped, "id", "left").select("id", F.concat(head, F.coalesce(F.concat(F.lit("\n"), body), F.lit(""))).alias("text"))


# --- changes --------------------------------------------------------------------------------


def remove_entities(entities: DataFrame, relations: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the entities of the given labels (column label, ASCII case ignored) and the active relations that touch them.

    Closed relations stay, dangling.
    """
    keys = labels.select(fold_ascii(F.col("label")).alias("k")).distinct()
    gone = entities.join(keys, fold_ascii(entities["label"]) == F.col("k"), "left_semi").select(F.col("id").alias("gone")).distinct()
    ended = relations.where(F.col("temporal_end").isNotNull())
    touched = active(relations).join(gone, F.col("subject_id") == F.col("gone"), "left_anti").join(gone, F.col("object_id") == F.col("gone"), "left_anti")
    return entities.join(gone, entities["id"] == F.col("gone"), "left_anti"), touched.unionByName(ended)


def deprecate_relations(relations: DataFrame, chosen: Column, as_of: str, confidence: float = 0.1) -> DataFrame:
    """Chosen relations end now, with little confidence."""
    return relations.withColumns({"confidence": F.when(chosen, confidence).otherwise(F.col("confidence")), "temporal_end": F.when(chosen, F.lit(as_of).cast("timestamp")).otherwise(F.col("temporal_end"))})


def upsert_by_id(entities: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """Entities after rows of (id, label, entity_type, confidence, ...) replace those of their ids: the time of creation stays, the update's is now.

    An id should come once in new.
    """
    at = F.lit(as_of).cast("timestamp")
    made = entities.select("id", F.col("created_at").alias("_made"))
    rows = new.join(made, "id", "left").withColumns({"created_at": F.coalesce("_made", at), "updated_at": at}).drop("_made")
    return entities.join(new.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True)
