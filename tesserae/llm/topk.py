"""Exact top-k inner products by a bit-sliced index.

A block of candidate vectors is kept as bitmaps: for each attribute, one bitmap for each of the top
bits of its value (offset to be non-negative), a bit for each row. For a query, the attributes are
weighted by the query's own top bits; the weighted slices are added with carry-save adders, which are
and/or/xor on whole bitmaps, into the bit slices of a coarse score. The coarse score differs from
the true one by at most an error that follows from the norms of what the slices leave out. Going from
the most significant slice of the sum downward, rows are split into those surely above, those on the boundary
and those below; the k-th coarse score less twice the error bounds the rows that can still be among the
top k. Those are resolved with full integers. No row is lost: the error bound is a
proof, not an estimate.

Queries go out in blocks of a bounded number of vectors, a pass over the candidates for each; within
a task, k rows a query are kept, and a window over (query, score) finds the final ones.

Components of any size that a double has are exact integers here: rows within +-NARROW go into slices, others are scored
one by one, in 64-bit integers where the product fits and in Python's where not. Ranks follow the exact scores.

Defined results: vectors that are null, empty, hold null or non-finite components, or whose id is null take no part;
vectors of another length than the query's aren't compared with it; ties go to the smaller id; a
repeated id is a row of its own, except that rows of the query's id are never its candidates; a query id that repeats with one and the
same vector counts once, and with several vectors ranks a candidate once for each of them; a score beyond 64 bits is told as the
largest or smallest 64-bit integer, though it ranks as what it is; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship

#: Vectors of a query block; rows of a candidate block; bits of an attribute and of a query weight that the slices keep.
QUERY_BLOCK, ROW_BLOCK, KEPT_BITS, WEIGHT_BITS = 8192, 1 << 16, 5, 4
#: Largest quantised component of a row that goes into slices.
NARROW = 1 << 20


def quantise(x: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly: 64-bit integers if all fit, else Python's."""
    if np.abs(x).max(initial=0) < 2**61 / scale:
        return np.floor(x * scale).astype(np.int64)
    whole = np.abs(x) >= 2**53  # a double of this size has no fraction, and the product may overflow
    out = np.floor(np.where(whole, 0, x) * scale).astype(object)
    out = np.array([int(v) for v in out.reshape(-1)], object).reshape(x.shape)
    out[whole] = [int(v) * scale for v in x[whole]]
    return out


def exact(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of rows with the query: 64-bit integers, or Python's where these might not hold them."""
    if values.dtype != object and query.dtype != object:
        if int(np.abs(values).max(initial=0)) * int(np.abs(query).max(initial=0)) * len(query) < 1 << 62:
            return values @ query
    return values.astype(object) @ query.astype(object)


def order_key(score: int) -> bytes:
    """Bytes that sort as the integers do."""
    size = (abs(score).bit_length() + 7) // 8
    raw = abs(score).to_bytes(size, "big")
    if score >= 0:
        return b"\x01" + size.to_bytes(4, "big") + raw
    return b"\x00" + (0xFFFFFFFF - size).to_bytes(4, "big") + bytes(255 - b for b in raw)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if scores.dtype == object:
        best = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)
    else:
        best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def usable(column: str) -> Column:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True))


class SlicedBlock:
    """Bitmaps of the top bits of a block's attributes; rows are bits of 64-bit words."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        low, high = int(values.min()), int(values.max())
        self.low, span = low, max(1, high - low)
        self.drop = max(0, span.bit_length() - KEPT_BITS)
        coarse = (values - low) >> self.drop
        self.bits = max(1, int(coarse.max()).bit_length())
        # what the slices leave out, as a distance for each row: value = low + coarse << drop + rest
        self.middle = ((1 << self.drop) - 1) / 2
        rest = (values - low - (coarse << self.drop)).astype(np.float64) - self.middle
        self.rest_norm = float(np.sqrt((rest * rest).sum(1).max()))
        kept = (coarse << self.drop) + low + self.middle
        self.kept_norm = float(np.sqrt((kept * kept).sum(1).max()))
        n, pad = len(ids), -len(ids) % 64
        self.rows, self.words = n, (n + pad) // 64
        padded = np.concatenate([coarse, np.zeros((pad, coarse.shape[1]), coarse.dtype)])
        self.slices = np.empty((coarse.shape[1], self.bits, self.words), np.uint64)
        for b in range(self.bits):
            packed = np.packbits(((padded >> b) & 1).astype(bool), axis=0, bitorder="little")
            self.slices[:, b] = np.ascontiguousarray(packed.T).view(np.uint64)
        self.flipped = ~self.slices

    def add(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum of |w| * (coarse if w > 0 else all ones - coarse)."""
        columns: list[list[np.ndarray]] = [[] for _ in range(self.bits + WEIGHT_BITS)]
        for d in np.flatnonzero(weights):
            source, w = (self.slices if weights[d] > 0 else self.flipped)[d], abs(int(weights[d]))
            for shift in range(w.bit_length()):
                if w >> shift & 1:
                    for b in range(self.bits):
                        columns[b + shift].append(source[b])
        out, at = [], 0
        while at < len(columns):
            column = columns[at]
            if at + 1 == len(columns) and len(column) > 1:
                columns.append([])
            while len(column) > 2:  # full adders: three bits of a weight become one of it and one of the next
                x, y, z = column.pop(), column.pop(), column.pop()
                half = x ^ y
                column.insert(0, half ^ z)
                columns[at + 1].append((x & y) | (half & z))
            if len(column) == 2:
                x, y = column
                columns[at + 1].append(x & y)
                column[:] = [x ^ y]
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            at += 1
        return out

    def top(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the block's best k rows other than the query's."""
        largest = int(np.abs(query).max(initial=0))
        cut = max(0, largest.bit_length() - WEIGHT_BITS)
        weights = np.sign(query) * ((np.abs(query) + (1 << cut >> 1)) >> cut)
        left_out = float(np.sqrt(((query - (weights << cut)).astype(np.float64) ** 2).sum()))
        error = float(np.sqrt((query.astype(np.float64) ** 2).sum())) * self.rest_norm + left_out * self.kept_norm
        unit = 1 << (self.drop + cut)  # a step of the coarse score in true scores
        slack = int(np.ceil(2 * error / unit)) + 1
        picked = self.at_least(self.add(weights), k + int((self.ids == query_id).sum()), slack)
        rows = np.flatnonzero(np.unpackbits(picked.view(np.uint8), count=self.rows, bitorder="little"))
        rows = rows[self.ids[rows] != query_id]
        return best_of(self.ids[rows], exact(self.values[rows], query), k)

    def at_least(self, total: list[np.ndarray], k: int, slack: int) -> np.ndarray:
        """Bitmap of the rows whose sum is at least the k-th largest less slack."""
        alive = np.full(self.words, ~np.uint64(0))
        if self.rows % 64:
            alive[-1] = np.uint64((1 << self.rows % 64) - 1)
        every = alive
        if self.rows <= k:
            return every
        need, kth = k, 0
        for level in range(len(total) - 1, -1, -1):  # from the most significant slice downward
            upper = alive & total[level]
            n = int(np.bitwise_count(upper).sum())
            if n >= need:
                alive, kth = upper, kth | 1 << level
            else:
                need -= n
                alive = alive & ~total[level]
        floor = max(0, kth - slack)
        above, equal = np.zeros(self.words, np.uint64), every
        for level in range(len(total) - 1, -1, -1):
            if floor >> level & 1:
                equal = equal & total[level]
            else:
                above |= equal & total[level]
                equal = equal & ~total[level]
        return above | equal


class PlainBlock:
    """Rows whose components are too large for slices: all are scored."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values

    def top(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(self.ids != query_id)
        return best_of(self.ids[rows], exact(self.values[rows], query), k)


def _best(queries, k: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates by length of vector, ROW_BLOCK at a time at most."""
        held: dict[int, list] = {}
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                mine = np.flatnonzero(sizes == d)
                kept = held.setdefault(int(d), [])
                kept.append((ids[mine], flat[(ends[mine] - d)[:, None] + np.arange(d)]))
                if sum(len(x) for x, _ in kept) >= ROW_BLOCK:
                    yield tuple(np.concatenate(x) for x in zip(*held.pop(int(d)), strict=True))
        for kept in held.values():
            yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))

    def made(ids: np.ndarray, x: np.ndarray) -> Iterator[SlicedBlock | PlainBlock]:
        wide = np.abs(x).max(1) * scale >= NARROW
        if not wide.all():
            yield SlicedBlock(ids[~wide], quantise(x[~wide], scale))
        if wide.any():
            yield PlainBlock(ids[wide], quantise(x[wide], scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        asked = queries.value
        for ids, x in blocks(batches):
            for block in made(ids, x):
                for n, (query_id, query) in enumerate(asked):
                    if len(query) != x.shape[1]:
                        continue
                    plain = query.dtype == object or int(np.abs(query).max()) >= 1 << 40  # beyond what bitmaps' weights and norms hold well
                    found = (PlainBlock(block.ids, block.values) if plain else block).top(query, query_id, k)
                    if n in best:
                        found = best_of(*(np.concatenate(x) for x in zip(best[n], found, strict=True)), k)
                    best[n] = found
        for a in range(0, len(asked), 4096):
            some = [n for n in range(a, min(len(asked), a + 4096)) if n in best and len(best[n][0])]
            if some:
                scores = [int(v) for n in some for v in best[n][1]]
                columns = [pa.array(np.repeat([asked[n][0] for n in some], [len(best[n][0]) for n in some]), pa.int64()), pa.array(np.concatenate([best[n][0] for n in some]), pa.int64()), pa.array([max(-(1 << 63), min((1 << 63) - 1, v)) for v in scores], pa.int64()), pa.array(list(map(order_key, scores)), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "key"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: int = 256, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query. Both tables: vec_id, embedding."""
    spark = candidates.sparkSession
    ship(spark)
    take = lambda df: df.select(F.col("vec_id").cast("long").alias("id"), "embedding").where(usable("embedding") & F.col("id").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("v"))
    asked, rows = take(queries).distinct(), take(candidates)
    n = max(1, -(-asked.count() // query_block))
    found = None
    for b in range(n):
        part = (asked if n == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b)).collect()
        block = [(r["id"], quantise(np.array(r["v"], float), scale)) for r in sorted(part)]
        best = rows.mapInArrow(_best(spark.sparkContext.broadcast(block), k, scale), "query_id long, vec_id long, score long, key binary")
        found = best if found is None else found.unionByName(best)
    order = W.partitionBy("query_id").orderBy(F.desc("key"), F.asc("vec_id"))
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
