"""Helpers shared by the operators of this folder: shared tables, word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources import workspace
from tesserae.sources.workspace import BATCH_BYTES, ship  # noqa: F401

#: Rows of a broadcast side; at 16 to 32 bytes a row that is a few MB. Larger sides are shuffled.
BROADCAST_ROWS = 300_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- tables ---------------------------------------------------------------------------------


def shared_table(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """df, written below spark.checkpoint.dir and read again."""
    return workspace.shared_table(df, label)


def scratch(spark: SparkSession):
    """Within it, tables that are written are removed at its end, but for what is passed to the function that it gives."""
    return workspace.scratch(spark)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where the counted rows are few; a shuffle join otherwise."""
    return F.broadcast(df) if rows <= limit else df


def fresh(name: str, taken: list[str]) -> str:
    """The name, or one like it that none of the taken ones equals in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


# --- words as hashes ------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


mix = _mix
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_SEGMENT = 1 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_UP, _DOWN = powers(_STEP, _SEGMENT + 1), powers(_BACK, _SEGMENT + 1)


def byte_classes(words: str, lower: bool) -> np.ndarray:
    """Byte to byte, 0 for separators. words: "space" splits at ASCII white space, "alnum" at all ASCII but letters and digits."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    if words == "space":
        table[[0x20, *range(0x09, 0x0E)]] = 0
        # byte 0 is a word character here, so it gets a value that UTF-8 never holds
        table[0] = 0xFF
    else:
        keep = np.zeros(256, bool)
        keep[0x30:0x3A] = keep[0x41:0x5B] = keep[0x61:0x7B] = keep[0x80:] = True
        table[~keep] = 0
    return table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and UTF-8 bytes of a string column, or bytes of a binary one; null counts as empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def hash_words(offsets: np.ndarray, raw: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the index of each text's first word (one more at the end).

    Works through segments of a bounded number of bytes, cut at separators, so that temporary
    arrays stay small however long a text is, unless a single word is longer than a segment.
    """
    hashes, starts, at, total = [], [], 0, len(raw)
    while at < total:
        end = min(total, at + _SEGMENT)
        m = table[raw[at:end]]
        if end < total:
            gap = np.flatnonzero(m == 0)[-1:]
            while not len(gap) and end < total:  # one word fills it
                more = min(total, end + (end - at))
                gap = np.flatnonzero(table[raw[end:more]] == 0)[:1] + (end - at)
                end = more
            if len(gap):
                end = at + int(gap[0]) + 1
            m = table[raw[at:end]]
        is_word = m != 0
        before = np.empty_like(is_word)
        before[0], before[1:] = False, is_word[:-1]
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        before[inner] = False
        first = np.flatnonzero(is_word & ~before)
        if len(first):
            after = np.empty_like(is_word)
            after[-1], after[:-1] = False, is_word[1:]
            edge = inner[inner > 0] - 1
            after[edge] = False
            last = np.flatnonzero(is_word & ~after)
            up, down = (_UP, _DOWN) if len(m) <= _SEGMENT else (powers(_STEP, len(m)), powers(_BACK, len(m)))
            sums = np.cumsum(_BYTES[m] * up[: len(m)], dtype=np.uint64)
            h = sums[last]
            h -= np.where(first > 0, sums[first - 1], np.uint64(0))
            h *= down[first]
            hashes.append(_mix(h + (last - first + 1).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))
            starts.append(first + at)
        at = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets, side="left")


class Windows:
    """Hashes of runs of words, from prefix sums of a polynomial in the words' hashes."""

    BASE = np.uint64(0xD1342543DE82EF95)
    INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers(self.BASE, n), dtype=np.uint64, out=self.sums[1:])
        self.down = powers(self.INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


_CACHES: list[dict] = []


def worker_cache() -> dict:
    """A dict that a worker keeps from task to task, until one of another operator begins in it."""
    _CACHES.append(cache := {})
    return cache


class Generations:
    """A dict to bytes that forgets: entries not asked for while `most` bytes of others came in are dropped."""

    COST = 160  # of an entry beside its characters, about

    def __init__(self, most: int):
        self.most, self.size = most, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, keys: list[str]) -> list[bytes | None]:
        found = list(map(self.young.get, keys))
        if self.old:
            old = {}
            for n, value in enumerate(found):
                if value is None and (value := self.old.get(keys[n])) is not None:
                    found[n] = old[keys[n]] = value
            self.put(old)
        return found

    def put(self, entries: dict[str, bytes]) -> None:
        size = self.COST * len(entries) + sum(map(len, entries)) + sum(map(len, entries.values()))
        if self.size + size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        self.size += size
        self.young |= entries


def strings(column: pa.Array) -> list[str]:
    """The column as a list; faster than to_pylist."""
    return column.to_numpy(zero_copy_only=False).tolist()


def joined(parts: list[bytes], which: np.ndarray, first: np.ndarray) -> pa.Array:
    """For each text the 32-bit integers of its parts, one after the other; first: where each text begins in which (one more at the end)."""
    flat = np.frombuffer(b"".join(parts), "<u4")
    return spread(flat, np.fromiter(map(len, parts), np.int64, len(parts)) // 4, which, first)


def spread(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray, first: np.ndarray) -> pa.Array:
    """The same for parts that lie one after the other in flat; sizes: how many integers each has."""
    begins = np.cumsum(sizes) - sizes
    many = sizes[which]
    ends = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(ends[-1]) + np.repeat(begins[which] - ends[:-1], many)
    return binaries(flat[at], ends[first])


def binaries(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of 32-bit integers as binary."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((4 * first).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values, "<u4"))]).cast(pa.binary())


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20, keep: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one hold about most_bytes (or are a single text). Empties all caches but keep."""
    for cache in _CACHES:
        if cache is not keep:
            cache.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(lengths) // most_bytes
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


