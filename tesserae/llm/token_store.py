"""Token ids in files of patched frame-of-reference blocks.

Format. A dataset of rows, each a segment: whole documents in ascending order of doc_id, with
their numbers of ids, and a payload. The payload's header holds the number of ids, of blocks and, for each block
of BLOCK ids, where it starts (the index). A block holds its minimum, a width in bits, the values less the minimum packed in
that many bits each, and the exceptions: those values that don't fit, as places and full values. The
width is that of a percentile of the block's values, raised or lowered to where the block is smallest.
Segments lie in Parquet, written by Spark's own committer, so a lost executor's task is
written anew, whole or not at all, to any file system; `shard` is a range of doc_ids, written by one task, and `first`
the ids before the segment in its shard.

The payload is little-endian: header u32 ids, u32 blocks, u32 start of each block; block u32 minimum, u8 width, u8
0, u16 exceptions, u16 places, u32 values, packed bits (LSB first).

Defined results: null text is the empty text (one id, the end); rows with a null doc_id come first,
as the smallest; repeated doc_ids stand side by side, in no given order; an empty table writes
no segment; extra columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import Generations, ship, slices, spread, strings, text_bytes, worker_cache

#: Ids of a block and, about, of a segment; the percentile from which the width is chosen.
BLOCK, SEGMENT, PERCENTILE = 1024, 1 << 16, 95
#: Bytes of each of the two generations of a worker's cache of pieces that aren't plain words.
CACHE = 16 << 20
#: Characters of pieces that go to the library together.
GROUP = 1 << 16
#: Shards to a partition.
SHARDS = 4
#: Bytes of text, and of ids, that are worked on together.
TEXTS, SLICE = 4 << 20, 2 << 20

# --- patched frame of reference -------------------------------------------------------------


def _bits(values: np.ndarray, width: int) -> bytes:
    """The low width bits of each value, one after the other, lowest first."""
    kind, full = ("<u2", 16) if width <= 16 else ("<u4", 32)
    planes = np.unpackbits(values.astype(kind).view(np.uint8), bitorder="little").reshape(len(values), full)
    return np.packbits(planes[:, :width].reshape(-1), bitorder="little").tobytes()


def _values(raw: np.ndarray, width: int, size: int) -> np.ndarray:
    kind, full = ("<u2", 16) if width <= 16 else ("<u4", 32)
    planes = np.zeros((size, full), np.uint8)
    planes[:, :width] = np.unpackbits(raw, count=size * width, bitorder="little").reshape(size, width)
    return np.packbits(planes.reshape(-1), bitorder="little").view(kind).astype("<u4")


def pack_block(values: np.ndarray) -> bytes:
    low, size = int(values.min()), len(values)
    rest = values - low
    place = min(size - 1, size * PERCENTILE // 100)
    bits, widest = int(np.partition(rest, place)[place]).bit_length(), int(rest.max()).bit_length()
    width = min({bits, min(bits + 1, widest), widest}, key=lambda w: (w * size / 8 + 6 * int(np.count_nonzero(rest >> w)), w))
    where = np.flatnonzero(rest >> width)
    return struct.pack("<IBBH", low, width, 0, len(where)) + where.astype("<u2").tobytes() + values[where].astype("<u4").tobytes() + _bits(rest, width)


def unpack_block(data: memoryview, size: int) -> np.ndarray:
    low, width, _, n = struct.unpack_from("<IBBH", data)
    where = np.frombuffer(data, "<u2", n, 8)
    full = np.frombuffer(data, "<u4", n, 8 + 2 * n)
    values = _values(np.frombuffer(data, np.uint8, (size * width + 7) // 8, 8 + 6 * n), width, size) + np.uint32(low)
    values[where] = full
    return values


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One payload; ids below 2**32."""
    ids = ids.astype(np.int64)
    blocks = [pack_block(ids[a : a + block]) for a in range(0, len(ids), block)]
    head = 8 + 4 * len(blocks)
    starts = np.cumsum([head, *map(len, blocks)])[:-1] if blocks else np.zeros(0)
    return struct.pack("<II", len(ids), len(blocks)) + starts.astype("<u4").tobytes() + b"".join(blocks)


def unpack(payload: bytes, start: int = 0, stop: int | None = None, block: int = BLOCK) -> np.ndarray:
    """The ids from start to stop; reads only the blocks that hold them, by the index."""
    n, blocks = struct.unpack_from("<II", payload)
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, "<u4")
    starts, view = np.frombuffer(payload, "<u4", blocks, 8), memoryview(payload)
    first, last = start // block, (stop - 1) // block
    parts = [unpack_block(view[starts[b] :], min(block, n - b * block)) for b in range(first, last + 1)]
    return np.concatenate(parts)[start - first * block : stop - first * block]


# --- tokens ---------------------------------------------------------------------------------


class Library:
    """The tokenizers library's encoding of whole texts, put together from pieces.

    A byte-level pre-tokenizer always starts a new piece at a space that a non-space follows, at a newline between
    two non-spaces and after it, and between letters and one last punctuation mark. Texts are cut at these places,
    all texts of a batch at once, by their bytes, and each distinct piece of a batch is encoded once: words of letters
    side by side, in arrays, the others one by one, through a cache. What white space is, is told generously: where one library's tables have it and another's don't, there is no cut.
    Special tokens hold no white space and stay whole. A file with another pre-tokenizer is refused.
    """

    MARKS = frozenset(",.;:!?")

    def __init__(self, text: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        spec = json.loads(text)
        steps = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or not steps.get("use_regex", True) or spec["model"].get("type") != "BPE" or any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", [])):
            raise ValueError("the tokenizer's file asks for other steps than a byte-level pre-tokenizer")
        self.tokenizer = Tokenizer.from_str(text)
        self.model = self.tokenizer.model
        self.words = Tokenizer(self.model)  # the same model, for words that are one piece each
        self.words.pre_tokenizer = CharDelimiterSplit("\n")
        vocabulary = spec["model"]["vocab"]
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # in bytes
        self.lengths[list(vocabulary.values())] = list(map(len, vocabulary))
        self.alphabet = np.array([*map(ord, byte_alphabet())], "<u4")
        self.spelt = dict(enumerate(byte_alphabet()))
        self.cache = Generations(CACHE)

    white = np.zeros(256, bool)
    white[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
    letter = np.zeros(256, bool)
    letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    #: Of the characters of two bytes, from U+0080.
    pairs = np.array([chr(c).isalpha() for c in range(0x80, 0x800)])
    mark = np.zeros(256, bool)
    mark[[*map(ord, MARKS)]] = True
    #: White space beyond ASCII, by its first byte.
    wide = {lead: [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace() and c.encode()[0] == lead] for lead in (0xC2, 0xE1, 0xE2, 0xE3)}

    def letters(self, raw: np.ndarray) -> np.ndarray:
        """Which bytes are those of letters of one or two bytes."""
        out = self.letter[raw]
        at = np.flatnonzero((raw >= 0xC2) & (raw < 0xE0))
        at = at[self.pairs[((raw[at].astype(np.int64) & 31) << 6 | raw[at + 1] & 63) - 0x80]]
        out[at] = out[at + 1] = True
        return out

    def cuts(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Where pieces begin in the bytes of texts, and the end."""
        size = len(raw)
        white = self.white[raw]
        if size and raw.max() >= 0x80:
            for lead, chars in self.wide.items():
                at = np.flatnonzero(raw == lead)
                for c in chars:
                    found = at[at <= size - len(c)]
                    for k, byte in enumerate(c):
                        found = found[raw[found + k] == byte]
                    for k in range(len(c)):
                        white[found + k] = True
        edge = np.zeros(size + 1, bool)  # where texts begin or end
        edge[offsets] = edge[0] = edge[size] = True
        cut = edge.copy()
        inner = np.flatnonzero(raw == 0x20)
        inner = inner[~edge[inner + 1]]
        cut[inner[~white[inner + 1]]] = True
        inner = np.flatnonzero(raw == 0x0A)
        inner = inner[~edge[inner] & ~edge[inner + 1]]
        inner = inner[~white[inner - 1] & ~white[inner + 1]]
        cut[inner] = cut[inner + 1] = True
        if size:
            begin = np.flatnonzero(cut)  # the end as well
            last = begin[1:] - 1
            ends = self.mark[raw[last]]
            begin, last = begin[:-1][ends], last[ends]
            begin = begin + (raw[begin] == 0x20)
            letters = np.concatenate([[0], np.cumsum(self.letters(raw), dtype=np.int64)])
            cut[last[(last > begin) & (letters[last] - letters[begin] == last - begin)]] = True
        return np.flatnonzero(cut)

    def parts(self, key: str) -> list[str]:
        """The pieces that make up one in which a mark follows letters, some of three bytes; itself, if nothing is known to cut it."""
        if key[-1] in self.MARKS and self._letters(key[:-1].removeprefix(" ")):
            return [key[:-1], key[-1]]
        return [key]

    @staticmethod
    def _letters(word: str) -> bool:
        """Whether it is letters alone, by this Python and by any library's tables."""
        return word.isalpha() and (word.isascii() or max(word) < "\u2c00")

    def _encode(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of keys that aren't cut. Letters alone, with or without a space before them, are one piece to the pre-tokenizer and go to the library's model at once."""
        out, rest, spelt, tokenize = {}, [], self.spelt, self.model.tokenize
        for k in keys:
            if self._letters(k.removeprefix(" ")):
                out[k] = array("I", [t.id for t in tokenize(k if k.isascii() and k[0] != " " else k.encode().decode("latin-1").translate(spelt))]).tobytes()
            else:
                rest.append(k)
        sizes = np.cumsum([0, *map(len, rest)]) // GROUP
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(sizes[:-1])) + 1).tolist(), len(rest)]):
            for k, e in zip(rest[a:b], self.tokenizer.encode_batch_fast(rest[a:b], add_special_tokens=False), strict=True):
                out[k] = array("I", e.ids).tobytes()
        return out

    def learn(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct pieces, through the cache."""
        done = self.cache.find(keys)
        new = [n for n, d in enumerate(done) if d is None]
        cut = {k: own for n in new if not (k := keys[n]).isascii() and len(own := self.parts(k)) > 1}
        parts = list({keys[n] for n in new}.difference(cut).union(*cut.values()))
        found = self.cache.find(parts)
        known = dict(zip(parts, found, strict=True))
        made = self._encode([p for p, d in zip(parts, found, strict=True) if d is None])
        self.cache.put(made)
        known |= made
        get = known.__getitem__
        whole = {key: b"".join(map(get, own)) for key, own in cut.items()}
        self.cache.put(whole)
        known |= whole
        for n in new:
            done[n] = get(keys[n])
        return done

    def _words(self, pieces: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Of those pieces that are letters, with or without a space before them: which they are, all their ids, and how many each has.

        They go to the model side by side, as one piece each; where a word's ids end is told by the lengths of their
        tokens. A group of which these don't add up is left out.
        """
        offsets, raw = text_bytes(pieces)
        letters = np.concatenate([[0], np.cumsum(self.letters(raw), dtype=np.int64)])
        bare = np.diff(offsets) - (raw[offsets[:-1]] == 0x20)
        words = np.flatnonzero((bare > 0) & (np.diff(letters[offsets]) == bare))
        sizes = np.diff(offsets)[words]
        which, flat, many = [], [], []
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // GROUP)) + 1).tolist(), len(words)]):
            if a == b:
                continue
            own, ends = text_bytes(pieces.take(pa.array(words[a:b])))[1], np.cumsum(sizes[a:b])
            text = np.insert(self.alphabet[own], ends[:-1], ord("\n")).tobytes().decode("utf-32-le")
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            reach = np.cumsum(self.lengths[ids])
            last = np.searchsorted(reach, ends)
            if len(ids) == last[-1] + 1 and (reach[last] == ends).all():
                which.append(words[a:b])
                flat.append(ids)
                many.append(np.diff(last, prepend=-1))
        return which, flat, many

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text, as little-endian 32-bit integers."""
        offsets, raw = text_bytes(texts)
        if not len(raw):
            return pa.array([b""] * len(texts), pa.binary())
        cuts = self.cuts(offsets, raw)
        coded = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw)).dictionary_encode()
        pieces = coded.dictionary
        which, flat, many = self._words(pieces)
        rest = np.ones(len(pieces), bool)
        for own in which:
            rest[own] = False
        which.append(np.flatnonzero(rest))
        parts = self.learn(strings(pieces.take(pa.array(which[-1]))))
        flat.append(np.frombuffer(b"".join(parts), "<u4"))
        many.append(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)
        place = np.empty(len(pieces), np.int64)
        place[np.concatenate(which)] = np.arange(len(pieces))
        return spread(np.concatenate(flat), np.concatenate(many), place[coded.indices.to_numpy()], np.searchsorted(cuts, offsets))


_LIBRARIES: dict[int, Library] = worker_cache()


def _library(spec) -> Library:
    key = hash(spec.value)
    if key not in _LIBRARIES:
        _LIBRARIES.clear()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _LIBRARIES[key] = Library(spec.value)
        gc.freeze()
    return _LIBRARIES[key]


_SEGMENT_SQL = "shard int, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
_SEGMENT = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def _encoded(spec, end_id: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id and its ids with the end, in width bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(spec)
        for batch in slices(batches, "text", TEXTS, _LIBRARIES):
            offsets, raw = text_bytes(library.encode(pc.fill_null(batch.column("text"), "")))
            first = offsets // 4
            ids = np.insert(raw.view("<u4"), first[1:], end_id).astype(f"<u{width}")
            first = width * (first + np.arange(len(first)))
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(first), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column.cast(pa.binary())], ["doc_id", "ids"])

    return run


def _segments(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (shard, doc_id, ids), in order, as segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first = None, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def segment() -> pa.RecordBatch:
            nonlocal first, size
            ids = np.frombuffer(b"".join([x for _, x in held]), f"<u{width}")
            row = [[shard], [first], [len(ids)], [[d for d, _ in held]], [[len(x) // width for _, x in held]], [pack(ids)]]
            first, size = first + len(ids), 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _SEGMENT, strict=True)], schema=_SEGMENT)

        for batch in slices(batches, "ids", SLICE):
            for own, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                if own != shard:
                    if held:
                        yield segment()
                    shard, first = own, 0
                held.append((doc_id, ids))
                size += len(ids) // width
                if size >= SEGMENT:
                    yield segment()
        if held:
            yield segment()

    return run


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int = 0, shards: int | None = None) -> None:
    """Encode doc_id, text with a tokenizers file and write segments in ascending doc_id order below path.

    The bounds of the shards come from the doc_ids alone. Texts are encoded where they lie and only ids are dealt, by shard; there are several
    shards to a partition, so that partitions are alike.
    """
    spark = documents.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    largest = max(end_id, *json.loads(text)["model"]["vocab"].values(), *(t["id"] for t in json.loads(text).get("added_tokens", [])))
    width, spec = 2 if largest < 1 << 16 else 4, spark.sparkContext.broadcast(text)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = SHARDS * n
    edges = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts).alias("e")).first()["e"] or []
    # bounds that repeat leave a shard empty; nulls come first
    shard = F.coalesce(F.size(F.filter(F.lit(sorted(set(edges))).cast("array<bigint>"), lambda e: e < F.col("doc_id"))), F.lit(0)).cast("int")
    encoded = docs.mapInArrow(_encoded(spec, end_id, width), "doc_id long, ids binary").withColumn("shard", shard)
    ordered = encoded.repartition(n, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first())
    ordered.select("shard", "doc_id", "ids").mapInArrow(_segments(width), _SEGMENT_SQL).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The segments, with `start`: ids of all documents before the segment."""
    segments = spark.read.schema(_SEGMENT_SQL).parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # a row for each written task
    before, at = {}, 0
    for r in sorted(shards, key=lambda r: r["shard"]):
        before[r["shard"]] = at
        at += r["n"]
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "shard int, shift long")
    return segments.join(F.broadcast(offsets), "shard").withColumn("start", F.col("first") + F.col("shift")).drop("first", "shift")


_DOC_SQL = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"])
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            raw, begins = memoryview(ids.tobytes()), ends - lengths
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["start"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and a CRC-32 of its ids, unpacked."""
    return read(spark, path).mapInArrow(_documents, _DOC_SQL)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, at = unpack(row["payload"]), np.cumsum([0, *row["lengths"]])
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64)))], ["doc_id", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and its ids as array<long>, the end id included."""
    return read(spark, path).mapInArrow(_ids, "doc_id long, ids array<long>")
