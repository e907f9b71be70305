"""Substring dedup by level-wise doubling: windows repeated at one length are extended to twice it.

Each level begins with windows of half its length. Of all half windows inside a window, the one of
smallest hash (leftmost among equals) stands for it, so equal windows have equal representatives, at
the same place within them, and about two positions in as many words as a half window has are representatives. A representative that
occurs once in the corpus ends all windows that it stands for; the others are extended to the full length.
A representative and the run of windows that it stands for cover a region; where
regions are equal throughout, so are all their windows, and only the first of a class
of equal regions needs a closer look: the windows of all others start earlier elsewhere. First regions
whose representative occurs in another class too are cut into windows, and each window's first
place is found. No window survives the full length's own comparison without being exact: keys are pairs of 64-bit hashes
of the half and of the whole.

The level that ends at the window's length decides what is removed, so `dedup` stops there. `longest_repeats` goes on: documents that
hold a repeated window pass to the next level, which ends at twice that length, and so on until no document does; that gives the length of
each document's longest repeat, in doublings of the window.

All counts are sums or minima with a partial stage on the mappers' side, and joins go back by key only, so a
passage that a third of the documents share doesn't gather in one task.

Defined results: null and wordless text have no words and keep the empty text; a document of fewer words than the window
is kept whole; a null doc_id's row is never an earlier place and is kept whole; rows that
repeat a doc_id are one document (its longest repeat is that of any of them): none of them is earlier than another at the same place, and what is removed of
one is removed of all of them, as far as they are long; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Windows, byte_classes, hash_words, mix, scratch, shared_table, ship, signed, slices, text_bytes

#: Words of a window.
WINDOW = 20
_CLASSES = byte_classes("space", lower=False)
_PLACE = np.uint64((1 << 26) - 1)
#: Bits of a place for how many windows follow the first of a run; longer runs are cut.
_MORE = 20


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    step, out = 1, x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(out) - (width - step)], out[width - step :]) if width > step else out


def leftmost_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of each width values in a row is. Compares the top 38 bits; places are told in pieces that fit the other 26."""
    piece, out = int(_PLACE) + 1 - width, []
    for a in range(0, max(1, len(x) - width + 1), piece):
        some = x[a : a + piece + width - 1]
        order = (some & ~_PLACE) | np.arange(len(some), dtype=np.uint64)
        out.append((sliding_minimum(order, width) & _PLACE).astype(np.int64) + a)
    return np.concatenate(out)


class Anchors:
    """Representatives of all windows of some texts: hash, region's hash, text, and where its windows start."""

    def __init__(self, column: pa.Array, window: int):
        words, first = hash_words(*text_bytes(column), _CLASSES)
        half, n = window // 2, len(words)
        sizes = np.diff(first)
        starts = np.arange(max(0, n - window + 1))
        end = np.repeat(first[1:], sizes)
        starts = starts[starts + window <= end[: len(starts)]]
        if not len(starts):
            self.hash = self.region = np.zeros(0, np.uint64)
            self.text = self.first = self.at = self.last = np.zeros(0, np.int64)
            return
        runs = Windows(words)
        at = np.arange(n - half + 1)
        grams = runs.of(at, at + half)
        chosen = leftmost_minima(mix(grams), window - half + 1)[starts]
        new = np.ones(len(starts), bool)
        new[1:] = chosen[1:] != chosen[:-1]
        new |= (chosen - starts + 1) % (1 << _MORE) == 0  # a place tells so many windows at most; offsets in a run fall to 0
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(starts)) - 1
        a, b, p = starts[head], starts[tail], chosen[head]
        self.hash = grams[p]
        self.region = runs.of(a, b + window) ^ mix((p - a).astype(np.uint64))
        self.text = np.searchsorted(first, a, "right") - 1
        base = first[self.text]
        self.first, self.at, self.last = a - base, p - base, b - base


def _count(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            found, n = np.unique(Anchors(batch.column("text"), window).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(found), pa.array(n, pa.int64())], ["half", "n"])

    return run


def _places(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = Anchors(batch.column("text"), window)
            # the first window's start, and how many more follow
            place = x.first << _MORE | (x.last - x.first)
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[x.text]
            yield pa.RecordBatch.from_arrays([signed(x.hash), signed(x.region), pa.array(doc, pa.int64()), pa.array(place, pa.int64())], ["half", "region", "doc_id", "place"])

    return run


def _windows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Full windows of the asked places: (half, whole, doc_id, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, first = hash_words(*text_bytes(batch.column("text")), _CLASSES)
            runs = Windows(words)
            asked = batch.column("places")
            n = np.diff(asked.offsets.to_numpy())
            flat = asked.flatten()
            half, place = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            text = np.repeat(np.arange(batch.num_rows), n)
            more = (place & ((1 << _MORE) - 1)) + 1
            row = np.repeat(np.arange(len(place)), more)
            start = (place >> _MORE)[row] + np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more)
            base = first[text[row]]
            fits = base + start + window <= first[text[row] + 1]  # rows that repeat a doc_id may be shorter
            row, start, base = row[fits], start[fits], base[fits]
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[text[row]]
            yield pa.RecordBatch.from_arrays([pa.array(half[row], pa.int64()), signed(runs.of(base + start, base + start + window)), pa.array(doc, pa.int64()), pa.array(start, pa.int64())], ["half", "whole", "doc_id", "start"])

    return run


_DONE_SQL = "doc_id long, kept string, n_words long, n_removed long"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        kept, n_words, n_removed = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = (text.as_py() or "").encode().split()
            n_words.append(len(words))
            if spans.is_valid:
                flat = spans.values
                edge = np.zeros(len(words) + 1, np.int64)
                for i, step in ((0, 1), (1, -1)):
                    np.add.at(edge, np.minimum(flat.field(i).to_numpy(), len(words)), step)
                words = [w for w, gone in zip(words, (np.cumsum(edge) > 0).tolist(), strict=False) if not gone]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["doc_id", "kept", "n_words", "n_removed"])


def _repeats(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """One level. docs: doc_id (not null), text. Runs of windows and single windows that occur more than once, as written tables
    (doc_id, start, end, later): spans of words, and whether all their windows start earlier elsewhere."""
    spark = docs.sparkSession
    # counts are written before they are joined: a join with a side that is dealt by an aggregate can't split a hot key
    repeated = docs.select("text").mapInArrow(_count(window), "half long, n long").groupBy("half").agg(F.sum("n").alias("n")).where("n > 1").select("half")
    repeated = shared_table(spark, repeated, "repeated")
    places = docs.mapInArrow(_places(window), "half long, region long, doc_id long, place long")
    places = shared_table(spark, places.join(repeated, "half", "left_semi"), "repeated-halves")
    # classes of equal regions: all but the first are repeated throughout
    classes = places.groupBy("half", "region").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = shared_table(spark, classes, "classes")
    start = F.shiftright("place", _MORE)
    runs = places.join(classes.where("n > 1").drop("n"), ["half", "region"]).select("doc_id", start.alias("start"), (start + F.col("place").bitwiseAND(F.lit((1 << _MORE) - 1)) + window).alias("end"), (F.struct("doc_id", "place") > F.col("first")).alias("later"))
    # windows of the first regions that may have a window in common with another class
    several = classes.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    asked = classes.select("half", "first.doc_id", "first.place").join(several, "half", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("half", "place")).alias("places"))
    windows = docs.join(asked, "doc_id").select("doc_id", "text", "places").mapInArrow(_windows(window), "half long, whole long, doc_id long, start long")
    windows = shared_table(spark, windows, "windows")
    first = windows.groupBy("half", "whole").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = shared_table(spark, first, "first-windows")
    single = windows.join(first, ["half", "whole"]).select("doc_id", "start", (F.col("start") + window).alias("end"), (F.struct("doc_id", "start") > F.col("first")).alias("later"))
    return runs, single


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, spans): spans (start, end) of words under windows that start earlier elsewhere. docs: doc_id (not null), text."""
    runs, single = _repeats(docs, window)
    return runs.unionByName(single).where("later").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def longest_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, longest_repeat), of documents that hold a window that occurs more than once: the largest of window, 2 * window, 4 * window, ... of
    which they do. Documents without one at a length don't go on to the next. docs: doc_id (not null), text."""
    spark = docs.sparkSession
    levels, length = [], window
    while True:
        with scratch(spark) as keep:
            runs, single = _repeats(docs, length)
            found = keep(runs.unionByName(single).select("doc_id").distinct(), "longer")
        if found.isEmpty():
            break
        levels.append(found.withColumn("longest_repeat", F.lit(length).cast("long")))
        docs = shared_table(spark, docs.join(found, "doc_id", "left_semi"), "survivors")
        length *= 2
    none = docs.select("doc_id", F.lit(0).cast("long").alias("longest_repeat")).limit(0)
    return reduce(DataFrame.unionAll, levels, none).groupBy("doc_id").agg(F.max("longest_repeat").alias("longest_repeat"))


def dedup(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, kept (words joined by a space), n_words, n_removed."""
    if window < 2 or window % 2:
        raise ValueError("the window is twice the first level's length, so an even number")
    ship(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named, unnamed = docs.where("doc_id is not null"), docs.where("doc_id is null")
    marked = named.join(repeated_spans(named, window), "doc_id", "left").select("doc_id", "text", "spans")
    return marked.unionByName(unnamed, allowMissingColumns=True).mapInArrow(_remove, _DONE_SQL)


def digests(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    done = dedup(documents, window)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i : i + 19], ' ')))) AS h
  FROM words WHERE len(w) >= 20),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM placed WHERE n > 1),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM words),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.k) AS t
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k WHERE g.k IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""
