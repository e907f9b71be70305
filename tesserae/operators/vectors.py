"""Filtered exact cosine top-k, additions and removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.scoring import cosine, dot
from tesserae.functions.text import preview
from tesserae.sources.workspace import shared_table, ship

#: Results of a search by default.
TOP_K = 20


def matching(vectors: DataFrame, source_types: list[str] | None = None, after: str | None = None, before: str | None = None, min_confidence: float | None = None) -> DataFrame:
    """Filters before any scoring; bounds are inclusive, empty lists and strings are no filter."""
    out = vectors
    if source_types:
        out = out.where(F.col("source_type").isin(*source_types))
    if after:
        out = out.where(F.col("created_at") >= F.lit(after).cast("timestamp"))
    if before:
        out = out.where(F.col("created_at") <= F.lit(before).cast("timestamp"))
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    return out


def search(vectors: DataFrame, query: list[float], top_k: int = TOP_K, **filters) -> DataFrame:
    """One query: the k nearest by cosine, ties to the newest, then the smaller id. One pass and a bounded top-k."""
    if top_k < 0:
        raise ValueError("top_k can't be negative")
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = matching(vectors, **filters).withColumn("similarity", cosine(F.col("embedding"), q))
    return scored.orderBy(F.desc("similarity"), F.desc("created_at"), "seq").limit(top_k)


#: Bytes of the queries that one pass over the vectors takes; products that a worker holds at a time; vectors of a slice.
PASS_BYTES, PRODUCTS, SLICE = 32 << 20, 1 << 22, 4096


def search_many(vectors: DataFrame, queries: DataFrame, top_k: int = TOP_K, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """A stated set of queries (query_id, q): query_id, id, similarity, rank; it is 0 where a vector is null or holds a null, and to
    a vector without a direction, whatever the other holds.

    Every vector meets every query, as products of matrices in single precision; what comes within their error bound of the k-th best so far
    is computed again in double, as `cosine` does. Queries go to the workers in passes of bounded size; of a task, at most k rows a query are
    dealt out by query.
    """
    spark = vectors.sparkSession
    ship(spark)
    asked = shared_table(queries.select("query_id", F.col("q").cast("array<double>").alias("q")), "queries")
    kind = asked.schema["query_id"].dataType.simpleString()
    rows = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"), "id", "seq", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))
    rows = rows.repartition(max(2, 2 * spark.sparkContext.defaultParallelism))
    out = f"query_id {kind}, id {rows.schema['id'].dataType.simpleString()}, seq {rows.schema['seq'].dataType.simpleString()}, at long, similarity double"
    size = asked.agg(F.coalesce(F.sum(8 * F.size(F.coalesce("q", F.array().cast("array<double>"))) + 200), F.lit(0))).first()[0]
    n = max(1, -(-size // pass_bytes))
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("at"), "seq")
    parts = None
    for k in range(n):
        some = asked if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k)
        sent = spark.sparkContext.broadcast(some.toArrow())
        met = rows.mapInArrow(lambda batches, sent=sent: _nearest(batches, sent.value, top_k), out)
        top = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "id", "similarity", F.col("rank").cast("long").alias("rank"))
        parts = top if parts is None else parts.unionByName(top)
    return parts


def _matrices(column) -> dict:
    """Vectors by their number of elements: (rows, matrix by element, norms), and under None the rows whose similarity to all is 0."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    flat = pc.list_flatten(column)
    inner = np.asarray(pc.fill_null(flat, 0.0), dtype=np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    odd = sizes == 0
    if flat.null_count:
        holes = np.concatenate([[0], np.cumsum(np.asarray(flat.is_null()))])
        odd |= holes[starts[1:]] > holes[starts[:-1]]
    out, none = {}, [np.flatnonzero(odd)]
    for d in np.unique(sizes[~odd]):
        rows = np.flatnonzero((sizes == d) & ~odd)
        m = np.ascontiguousarray(inner[starts[rows][:, None] + np.arange(d)].T)
        with np.errstate(all="ignore"):
            norms = np.sqrt(_sums(m, m))
        none.append(rows[norms == 0])
        out[int(d)] = rows[norms != 0], np.ascontiguousarray(m[:, norms != 0]), norms[norms != 0]
    return out | {None: np.sort(np.concatenate(none))}


def _sums(a, b):
    """Sums of products element by element, in the elements' order."""
    import numpy as np

    total = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def _nearest(batches, asked, k: int):
    """The k nearest of the batches' rows to each query: (query_id, id, seq, at, similarity)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n, ids = asked.num_rows, asked.column("query_id").combine_chunks()
    groups = _matrices(asked.column("q").combine_chunks()) if n and k else {}
    best = [np.zeros(0, t) for t in (np.int64, np.float64, np.int64)]  # of all queries: the query's row, similarity, the vector's row in `kept`
    least = np.full(n, -np.inf)  # what is below can't be among the k best of a query
    kept = None
    for batch in batches if groups else []:
        for begin in range(0, batch.num_rows, SLICE):
            part = pa.Table.from_batches([batch.slice(begin, SLICE)]).sort_by([("at", "descending"), ("seq", "ascending")]).combine_chunks()
            part = part.take(_first_copies(part.column("embedding").combine_chunks(), k)).combine_chunks()
            mats, m = _matrices(part.column("embedding").combine_chunks()), part.num_rows
            found = [best]
            base = 0 if kept is None else kept.num_rows
            for d, group in groups.items():
                if d is None:  # queries that are similar to nothing
                    first = np.arange(min(k, m))
                    found.append([np.repeat(group, len(first)), np.zeros(len(group) * len(first)), base + np.tile(first, len(group))])
                    continue
                at, q, qn = group
                rows, v, vn = mats.get(d) or (np.zeros(0, np.int64), np.zeros((d, 0)), np.zeros(0))
                rest = np.setdiff1d(np.arange(m), rows)[:k]  # of other lengths or without a direction: 0
                found.append([np.repeat(at, len(rest)), np.zeros(len(at) * len(rest)), base + np.tile(rest, len(at))])
                if not len(rows):
                    continue
                with np.errstate(all="ignore"):
                    unit_v, unit_q = (v / vn).astype(np.float32), (q / qn).astype(np.float32)
                # what single precision can't say: computed in double only
                bad_v, bad_q = (~(np.isfinite(u).all(0) & (w > 1e-140) & (w < 1e140)) for u, w in ((unit_v, vn), (unit_q, qn)))
                unit_v[:, bad_v], unit_q[:, bad_q] = 0, 0
                margin = np.float32(4 * (d + 8) * 2.0**-24)
                step = max(1, PRODUCTS // len(rows))
                for j in range(0, len(at), step):
                    some = slice(j, j + step)
                    s = unit_q[:, some].T @ unit_v
                    low = least[at[some]]
                    fresh = np.flatnonzero(low == -np.inf)
                    if len(fresh) and s.shape[1] - bad_v.sum() >= k:
                        low[fresh] = np.partition(s[fresh][:, ~bad_v], -k, axis=1)[:, -k].astype(np.float64)
                    low = np.where(bad_q[some], -np.inf, low - 2 * margin).astype(np.float32)
                    near = s >= low[:, None]
                    near[:, bad_v] = True
                    x, y = np.nonzero(near)
                    with np.errstate(all="ignore"):
                        for z in range(0, len(x), PRODUCTS // 16):
                            xs, ys = x[z : z + PRODUCTS // 16] + j, y[z : z + PRODUCTS // 16]
                            total = np.zeros(len(xs))
                            for e in range(d):
                                total += v[e, ys] * q[e, xs]
                            norms = vn[ys] * qn[xs]
                            found.append([at[xs], np.where(norms == 0, 0.0, total / norms), base + rows[ys]])
            everything = part.drop_columns("embedding") if kept is None else pa.concat_tables([kept, part.drop_columns("embedding")])
            query, similarity, row = (np.concatenate(c) for c in zip(*found, strict=True))
            # places of the rows, and of similarities: those that aren't a number come first
            place = np.empty(everything.num_rows, np.int64)
            place[np.asarray(pc.sort_indices(everything, [("at", "descending"), ("seq", "ascending")]))] = np.arange(everything.num_rows)
            order = np.lexsort((place[row], -np.where(np.isnan(similarity), np.inf, similarity), ~np.isnan(similarity), query))
            query, similarity, row = query[order], similarity[order], row[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            query, similarity, row, rank = (c[rank < k] for c in (query, similarity, row, rank))
            full = rank == k - 1
            worst = similarity[full]
            least[query[full]] = np.where(np.isnan(worst), np.inf, worst)
            used, row = np.unique(row, return_inverse=True)
            kept = everything.take(pa.array(used)).combine_chunks()
            best = [query, similarity, row]
    if kept is None:
        return
    for z in range(0, len(best[0]), 100_000):
        part = slice(z, z + 100_000)
        rows = kept.take(pa.array(best[2][part])).combine_chunks()
        query = ids.take(pa.array(best[0][part]))
        yield from pa.table({"query_id": query, "id": rows["id"], "seq": rows["seq"], "at": rows["at"], "similarity": pa.array(best[1][part])}).to_batches()


def _first_copies(column, k: int):
    """Rows but those after the k-th of equal vectors: they're as similar and come later."""
    import numpy as np

    sizes = np.asarray(column.value_lengths().fill_null(-1))
    flat, seen, keep, at = np.asarray(column.flatten(), dtype=np.float64), {}, [], 0
    for row, size in enumerate(sizes):
        end = at + max(size, 0)
        key = flat[at:end].tobytes() if size >= 0 else None
        seen[key] = n = seen.get(key, 0) + 1
        if n <= k:
            keep.append(row)
        at = end
    return keep


def with_vectors(vectors: DataFrame, new: DataFrame, embedder: Column, as_of: str) -> DataFrame:
    """Adds rows (id, source_id, source_type, content, confidence); a vector of the same id is replaced."""
    rows = new.select("id", "source_id", "source_type", preview(F.col("content")).alias("content_preview"), embedder.alias("embedding"), F.size(embedder).alias("dimensions"), F.lit("{}").alias("metadata"), F.lit(as_of).cast("timestamp").alias("created_at"), "confidence")
    return vectors.join(rows.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True)


def zero_embedding(dimensions: int) -> Column:
    """What stands for an embedding without a model: similar to nothing."""
    return F.array_repeat(F.lit(0.0).cast("float"), dimensions)


def without(vectors: DataFrame, keys: DataFrame, column: str = "id") -> DataFrame:
    """Without the vectors of the given ids, or of the given source_id."""
    return vectors.join(keys.select(column).distinct(), column, "left_anti")
