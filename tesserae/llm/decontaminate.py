"""Benchmark decontamination by suffix arrays over shards of the training documents.

Each task cuts its documents into shards. A shard's suffix array orders the positions of its words
by the words that follow, down to the window's length; every suffix of every benchmark item is found
in it by binary search. From each hit that no longer one contains, the match is followed to its
end, which gives the longest verbatim matches with their places. No shuffle is needed: a
document lies whole in one shard. The benchmark's words go to the tasks, in blocks of a bounded number of words; a task looks
for one block after the other in each shard and merges what it finds row by row, so the number of blocks makes no difference to the result.

Only positions whose words all occur in the block can match, so the array leaves the others out.

Defined results: a null or wordless text has no words, no hits and is clean; a null item or one
without words has no windows; equal items each count; items with a null item_id hit like any others and count as one item, whose null
stands last in `items` and not in a digest of them; a repeated or null doc_id is an ordinary row with a row of its own in the
result; an empty benchmark leaves all clean; extra columns of either table are ignored by `contamination`, and those of the documents are kept by
`decontaminate`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_classes, hash_words, ship, slices, text_bytes

#: Words of a window; words of benchmark items that one broadcast block holds; bytes of text in a shard, and in one if there are several blocks.
WINDOW, BLOCK_WORDS, SHARD, LARGE_SHARD = 10, 2_000_000, 4 << 20, 16 << 20
_CLASSES = byte_classes("alnum", lower=True)


class TestSet:
    """The words of a block of items as small integers, and the windows to look for."""

    def __init__(self, ids: list, texts: list[str], window: int):
        words, first = hash_words(*text_bytes(pa.array(texts, pa.string())), _CLASSES)
        self.vocabulary, codes = np.unique(words, return_inverse=True)
        self.window, self.ids = window, ids
        self.codes = codes.astype(np.int64) + 1  # 0: a word that no item has
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per_key = max(1, 63 // self.bits)
        sizes = np.diff(first)
        self.end = np.repeat(first[1:], sizes)
        self.item = np.repeat(np.arange(len(ids)), sizes)
        self.begin = np.repeat(first[:-1], sizes)
        length = np.minimum(window, np.repeat(sizes, sizes))
        at = np.arange(len(self.codes))
        kept = at + length <= self.end
        self.at, self.length = at[kept], length[kept]
        # hash buckets of the vocabulary: its top 16 bits point at the first word of the bucket
        self.bucket = np.searchsorted(self.vocabulary, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
        self.deepest = int(np.diff(np.append(self.bucket, len(self.vocabulary))).max(initial=0))

    def code(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        if not len(self.vocabulary):
            return out
        place = self.bucket[(words >> np.uint64(48)).astype(np.int64)]
        for step in range(self.deepest):
            at = np.minimum(place + step, len(self.vocabulary) - 1)
            same = self.vocabulary[at] == words
            out[same] = at[same] + 1
        return out

    def packed(self, codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """length words from each place of at in one integer, the first word highest; 0 past the end."""
        key = np.zeros(len(at), np.int64)
        for j in range(length):
            key = (key << self.bits) | codes[at + j]
        return key << (self.bits * (self.per_key - length))


def suffix_array(test: TestSet, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places that begin with a word of the block, ordered by the words after them; their sort keys."""
    n, w = len(codes), test.window
    padded = np.concatenate([codes, np.zeros(w + test.per_key, np.int64)])
    at = np.flatnonzero(codes)
    if len(test.length) and test.length.min() >= 2:  # no window can begin where the next word isn't the benchmark's
        at = at[padded[at + 1] > 0]
        if test.length.min() >= 3:
            at = at[padded[at + 2] > 0]
    rest = end[at] - at
    keys = []
    for j in range(0, w, test.per_key):
        key = np.zeros(len(at), np.int64)
        for k in range(j, j + test.per_key):
            key <<= test.bits
            if k < w:
                key |= np.where(rest > k, padded[np.minimum(at + k, n + w - 1)], 0)
        keys.append(key)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    return at[order], [k[order] for k in keys]


def look_up(test: TestSet, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each occurrence of a window in a shard: its place, the item's place and the window's length."""
    end = np.repeat(first[1:], np.diff(first))
    places, keys = suffix_array(test, codes, end)
    if not len(places) or not len(test.at):
        return (np.zeros(0, np.int64),) * 3
    low, high = np.zeros(len(test.at), np.int64), np.full(len(test.at), len(places))
    parts = range(0, test.window, test.per_key)
    for key, j in zip(keys, parts, strict=True):
        for m in np.unique(test.length):
            mine = np.flatnonzero((test.length == m) & (low < high))
            n = int(min(m - j, test.per_key))
            if n <= 0 or not len(mine):
                continue
            lo = test.packed(test.codes, test.at[mine] + j, n)
            hi = lo + (np.int64(1) << (test.bits * (test.per_key - n))) - 1
            if j == 0:
                low[mine], high[mine] = np.searchsorted(key, lo, "left"), np.searchsorted(key, hi, "right")
            else:
                for i, a, b in zip(mine, lo, hi, strict=True):
                    part = key[low[i] : high[i]]
                    high[i] = low[i] + np.searchsorted(part, b, "right")
                    low[i] += np.searchsorted(part, a, "left")
    count = np.maximum(high - low, 0)
    hit = np.flatnonzero(count)
    which = np.repeat(hit, count[hit])
    if not len(which):
        return (np.zeros(0, np.int64),) * 3
    step = np.arange(len(which)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
    return places[low[which] + step], test.at[which], test.length[which]


def longest(test: TestSet, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Maximal verbatim matches as rows (document, item, start in document, start in item, words)."""
    place, item_at, length = look_up(test, codes, first)
    if not len(place):
        return np.zeros((0, 5), np.int64)
    doc = np.searchsorted(first, place, "right") - 1
    # windows that follow one another on a diagonal are one match; the last window bounds its end
    diagonal = place - item_at
    order = np.lexsort((place, diagonal, test.item[item_at], doc))
    place, item_at, length, doc, diagonal = (x[order] for x in (place, item_at, length, doc, diagonal))
    item = test.item[item_at]
    new = np.ones(len(place), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(place)) - 1
    words = place[tail] + length[tail] - place[head]
    return np.stack([doc[head], item[head], place[head] - first[doc[head]], item_at[head] - test.begin[item_at[head]], words], 1)


def _covered(spans: np.ndarray) -> int:
    """Words under spans (start, words), each counted once."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 0] + spans[:, 1])
    begin = np.maximum(spans[:, 0], np.concatenate([[0], ends[:-1]]))
    return int(np.maximum(spans[:, 0] + spans[:, 1] - begin, 0).sum())


_FOUND = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())])))])
_ROW_SQL = "doc_id long, n_words long, n_hit long, items array<string>, matches array<struct<item_id:string,doc_start:long,item_start:long,n_words:long>>"


def _find(blocks: list, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """Where each text's words begin, the matches in all texts by text, and the items' names."""
    words, first = hash_words(*text_bytes(texts), _CLASSES)
    names: list[str | None] = []
    parts = [np.zeros((0, 5), np.int64)]
    for block in blocks:
        test: TestSet = block.value
        found = longest(test, test.code(words), first)
        found[:, 1] += len(names)
        names += test.ids
        parts.append(found)
        if len(blocks) > 1:  # one of them in memory at a time; it's read again for the next shard
            block.__dict__.pop("_value", None)
    found = np.concatenate(parts)
    return first, found[np.lexsort((found[:, 3], found[:, 1], found[:, 2], found[:, 0]))], names


def _scan(blocks: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD if len(blocks) == 1 else LARGE_SHARD):
            first, found, names = _find(blocks, batch.column("text"))
            cuts = np.searchsorted(found[:, 0], np.arange(batch.num_rows + 1))
            hit, items, matches = [], [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                mine = found[a:b]
                hit.append(_covered(mine[:, [2, 4]]) if b > a else 0)
                items.append(sorted({names[i] for i in mine[:, 1]}, key=lambda x: (x is None, x)))
                matches.append([{"item_id": names[i], "doc_start": s, "item_start": t, "n_words": n} for _, i, s, t, n in mine.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, f.type) for x, f in zip((np.diff(first), hit, items, matches), _FOUND, strict=True))], ["doc_id", *_FOUND.names])

    return run


def _clean(blocks: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows without a match, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD if len(blocks) == 1 else LARGE_SHARD):
            _, found, _ = _find(blocks, batch.column("text"))
            clean = np.ones(batch.num_rows, bool)
            clean[found[:, 0]] = False
            yield batch.filter(pa.array(clean))

    return run


def _blocks(spark: SparkSession, benchmark: DataFrame, window: int, block_words: int) -> list:
    """Broadcast test sets of about block_words words each; one block's rows are in the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") / 5).alias("n")).first()["n"] or 0
    n = max(1, int(np.ceil(total / block_words)))
    out = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = part.collect()
        out.append(spark.sparkContext.broadcast(TestSet([r["item_id"] for r in rows], [r["text"] for r in rows], window)))
    return out


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items, and the longest verbatim matches with their places."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scan(_blocks(spark, benchmark, window, block_words)), _ROW_SQL)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words hit, items found with a digest of their ids, and the verdict."""
    found = matches(documents, benchmark, window)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0).cast("long")).alias("longest_match"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without those that hold any window of the benchmark; columns stay as they are."""
    spark = documents.sparkSession
    ship(spark)
    return documents.mapInArrow(_clean(_blocks(spark, benchmark, window, block_words)), documents.schema)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
sought AS (
  SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS phrase
  FROM items WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM sought),
places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS phrase
  FROM words, lengths WHERE len(w) >= n),
found AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN (SELECT DISTINCT item_id, n, phrase FROM sought) s ON p.n = s.n AND p.phrase = s.phrase),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
