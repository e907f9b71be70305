"""BPE encoding and decoding with a trie whose nodes hold the state of the prefix they stand for.

The last token of a prefix's encoding, with the node where that token begins, is all that is needed
to extend the encoding: a token t may follow the encoding of a shorter prefix exactly if its last token and t stay apart when
merged side by side. So each node of the trie is computed once, from the nodes on its path, and all
words that share the prefix share the node. The distinct new words of a batch are taken in sorted order, which walks their trie
depth first, with the states of the current path alone in memory. Words' ids are read off by following the tokens' beginnings back to the root.

Texts are split at ASCII white space into chunks; each distinct chunk of a batch is looked up once, in a cache
bounded by bytes, its words in another, and texts are put together from chunks by index.

The vocabulary file is a parameter: a byte-level BPE in the tokenizers format, with an end-of-word suffix. It is read on
the driver and sent out (its size doesn't grow with the data). A file with another normaliser or pre-tokeniser than the one built in here
is refused.

Defined results: null text encodes as the empty text, with no ids; special tokens' strings in a text
become their ids, as in the library; repeated rows each get a row; extra columns are kept by
`encode`, `decode` and `round_trip` unless they clash with the new ones, which replace them.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Generations, joined, ship, slices, strings, text_bytes, worker_cache

#: Bytes of each generation of a worker's caches of chunks and of words (two generations each); pairs of tokens known to stay apart or not.
CHUNKS, WORDS, PAIRS = 12 << 20, 40 << 20, 250_000
#: Bytes of text, or of ids, that are worked on together.
SLICE = 2 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Ranks and parts of tokens; whether two tokens stay apart side by side."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        self.rank: dict[tuple[int, int], int] = {}
        self.made = [-1] * (max(vocabulary.values()) + 1)
        self.parts: list[tuple[int, int] | None] = [None] * len(self.made)
        for n, pair in enumerate(merges):
            left, right = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            a, b, whole = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.rank[a, b] = n
            if self.parts[whole] is None:
                self.made[whole], self.parts[whole] = n, (a, b)
        self.known: dict[tuple[int, int], bool] = {}

    def apart(self, a: int, b: int) -> bool:
        answer = self.known.get((a, b))
        if answer is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            answer = self.known[a, b] = self._apart(a, b)
        return answer

    def _apart(self, a: int, b: int) -> bool:
        """Back in time along the seam: at no moment may a merge across it have come first.

        Undoing the later of the two seam tokens' merges shows the pair that touched there before;
        a merge of that pair wins if its rank is lower, or, against one on its right, equal (leftmost first).
        """
        rank, made, parts = self.rank, self.made, self.parts
        if (a, b) in rank:
            return False
        while made[a] >= 0 or made[b] >= 0:
            if made[b] >= made[a]:
                until = made[b] + 1
                b = parts[b][0]
            else:
                until = made[a]
                a = parts[a][1]
            across = rank.get((a, b))
            if across is not None and across < until:
                return False
        return True


class Trie:
    """Encodings of sorted words, by a depth-first walk over their trie.

    What is kept of a prefix is its state: the last token of its encoding, the depth at which that begins, and
    the longest end of the prefix with which a token begins. Only the states on the path to the current word are held, so memory is
    bounded by the longest word; words that share a prefix follow one another and share its states.
    """

    def __init__(self, merges: Merges, vocabulary: dict[str, int], suffix: str):
        self.merges, self.suffix = merges, suffix
        self.plain: dict[str, int] = {}  # tokens that may stand inside a word, and those that end one, by their text
        self.end: dict[str, int] = {}
        for text, token in vocabulary.items():
            if self._whole(token):
                ends = bool(suffix) and text.endswith(suffix)
                (self.end if ends else self.plain)[text.removesuffix(suffix) if ends else text] = token
        if not suffix:
            self.end = self.plain
        self.begun = {t[:n] for t in (*self.plain, *self.end) for n in range(len(t) + 1)}
        self.last: tuple[dict[str, list], dict[str, list]] = {}, {}

    def _whole(self, token: int) -> bool:
        """Whether merging a token's characters gives the token: its two parts must stay whole and meet."""
        parts = self.merges.parts[token]
        return parts is None or self.merges.made[token] == self.merges.rank[parts]

    def _candidates(self, tail: str, end: bool) -> list[tuple[int, int]]:
        """Tokens with which tail ends, the longest first, with their lengths. There are no more tails than beginnings of tokens."""
        tokens = self.end if end else self.plain
        found = self.last[end][tail] = [(len(tail) - n, tokens[tail[n:]]) for n in range(len(tail)) if tail[n:] in tokens]
        return found

    def encode(self, words: list[str]) -> Iterator[list[int]]:
        """words: sorted, in the byte alphabet, of at least one character each."""
        begun, (inner, ends), apart, known = self.begun, self.last, self.merges.apart, self.merges.known
        token, begins, tails, before = [-1], [0], [""], ""
        for word in words:
            size, at = len(word), 0
            shared = min(len(token), size) - 1  # the states of shorter prefixes than both words
            while at < shared and word[at] == before[at]:
                at += 1
            del token[at + 1 :], begins[at + 1 :], tails[at + 1 :]
            tail, before = tails[at], word
            while at < size:
                tail += word[at]
                at += 1
                while tail not in begun:
                    tail = tail[1:]
                last = ends if at == size else inner
                options = last.get(tail)
                if options is None:
                    options = self._candidates(tail, at == size)
                for length, t in options:
                    left = token[at - length]
                    if length == at:
                        break
                    answer = known.get((left, t))
                    if answer is None:
                        answer = apart(left, t)
                    if answer:
                        break
                else:
                    raise ValueError(f"no token of the vocabulary ends {word[:at]!r}")
                if at < size:
                    token.append(t)
                    begins.append(at - length)
                    tails.append(tail)
            out, at = [t], size - length
            while at:
                out.append(token[at])
                at = begins[at]
            yield out[::-1]


#: What the file must say beside its vocabulary: the library's steps that `Coder` has as well.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Coder:
    """Encoder and decoder of one vocabulary file, with bounded caches of chunks and of words."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, added = spec["model"], spec.get("added_tokens", [])
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or spec.get("normalizer") != NORMALIZER or steps[0].get("pattern") != {"Regex": PATTERN} or steps[-1].get("type") != "ByteLevel" or spec.get("decoder") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in added):
            raise ValueError("the vocabulary file asks for other steps than those built in here")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in added}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.trie = Trie(Merges(vocabulary, model["merges"]), vocabulary, self.suffix)
        strings = [""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for t, i in (model["vocab"] | self.special).items():
            strings[i] = t
        self.strings = pa.array(strings)
        self.bytes = byte_alphabet()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.mark = commonprefix([*self.special])  # stands wherever a special token does
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+")
        self.any = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.chunks, self.words = Generations(CHUNKS), Generations(WORDS)

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk; a special token's string comes as it stands, in which no word has its characters."""
        if self.mark not in chunk or not self.special:
            if chunk.isascii():
                return self.plain.findall(chunk.lower())
            return self.any.findall("".join([c.lower() for c in unicodedata.normalize("NFC", chunk)]))
        out = []
        for piece in self.cut.split(chunk):
            if piece in self.special:
                out.append(piece)
            elif piece.isascii():
                out += self.plain.findall(piece.lower())
            else:
                out += self.any.findall("".join([c.lower() for c in unicodedata.normalize("NFC", piece)]))
        return out

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks; their new words are encoded together, in sorted order."""
        done = self.chunks.find(chunks)
        new = [n for n, d in enumerate(done) if d is None]
        split = [self.split(chunks[n]) for n in new]
        words = list(set(chain.from_iterable(split)))
        found = self.words.find(words)
        known = dict(zip(words, found, strict=True))
        asked = {}
        for w in [w for w, d in zip(words, found, strict=True) if d is None]:
            if w in self.special:
                known[w] = np.array([self.special[w]], "<u4").tobytes()
            else:
                asked[w if w.isascii() and w.isprintable() else "".join([self.bytes[b] for b in w.encode()])] = w
        order = sorted(asked)
        made = [array("I", ids).tobytes() for ids in self.trie.encode(order)]
        fresh = dict(zip(map(asked.__getitem__, order), made, strict=True))
        self.words.put(fresh)
        known |= fresh
        get = known.__getitem__
        fresh = {chunks[n]: get(words[0]) if len(words) == 1 else b"".join(map(get, words)) for n, words in zip(new, split, strict=True)}
        self.chunks.put(fresh)
        for n, ids in zip(new, fresh.values(), strict=True):
            done[n] = ids
        return done

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text, as little-endian 32-bit integers."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        return joined(self.learn(strings(coded.dictionary)), coded.indices.to_numpy(), first)

    def decode(self, ids: pa.Array) -> pa.Array:
        offsets, raw = text_bytes(ids)
        tokens = self.strings.cast(pa.large_string()).take(pa.array(raw.view("<u4")))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets // 4), tokens), pa.scalar(" ", pa.large_string())).cast(pa.string())


_CODERS: dict[int, Coder] = worker_cache()


def _coder(text) -> Coder:
    key = hash(text.value)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(text.value)
        gc.freeze()  # its tables stay; the collector needn't look at them again and again
    return _CODERS[key]


def _run(text, kinds: tuple[str, ...], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(text)
        for batch in slices(batches, "ids" if kinds == ("decode",) else "text", SLICE, _CODERS):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            if "encode" in kinds:
                columns["ids"] = ids = coder.encode(pc.fill_null(batch.column("text"), ""))
                columns["n_tokens"] = pc.divide(pc.binary_length(ids), 4).cast(pa.int64())
            if "decode" in kinds:
                columns["decoded"] = coder.decode(pc.fill_null(columns["ids"], b""))
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return run


def _apply(df: DataFrame, vocabulary: str, kinds: tuple[str, ...]) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    new = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())] * ("encode" in kinds) + [T.StructField("decoded", T.StringType())] * ("decode" in kinds)
    kept = [f for f in df.schema.fields if f.name not in {x.name for x in new}]
    with open(vocabulary, encoding="utf-8") as f:  # a file of the driver's, whatever the executors have
        text = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([*kept, *new])
    return df.mapInArrow(_run(text, kinds, schema.names), schema)


def encode(documents: DataFrame, vocabulary: str) -> DataFrame:
    """The documents with ids (binary, little-endian 32-bit) and n_tokens."""
    return _apply(documents, vocabulary, ("encode",))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """What has ids, with the text that they decode to: tokens joined by spaces, specials included."""
    return _apply(encoded, vocabulary, ("decode",))


def round_trip(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Both in one pass over the documents."""
    return _apply(documents, vocabulary, ("encode", "decode"))


def digests(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, n_tokens and SHA-256 of the ids and of the decoded text."""
    done = round_trip(documents.select("doc_id", "text"), vocabulary)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
