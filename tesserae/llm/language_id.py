"""Language identification by sparse multinomial logistic regression.

Features are the TF-IDF weights of character n-grams of the lower-cased text, hashed into BUCKETS; what isn't a letter
counts as one space between words. Document frequencies are sums over all documents that may be learnt
from. The weights are trained in the driver by follow-the-regularised-leader with elastic-net penalties
(L1 keeps most weights at zero) on a bounded sample, SAMPLE documents spread evenly over the languages, chosen by hash; a part
of the sample is held back to fit one temperature that calibrates the probabilities. Prediction is one pass without a
shuffle; the weights that go out have a fixed size for each language.

Defined results: a text that is null or has no letter is `und` with score 0; if nothing can be learnt
from, all are; ties go to the first language by name; documents without a language or id aren't learnt from; repeated
rows count each; an empty table gives an empty one; extra columns are ignored by `predict` and kept by
`keep_identified`, whatever their names. Whole texts are read, long ones too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, mix, ship, slices

#: Buckets of hashed n-grams; lengths of n-grams; documents of the training sample; share of it for the temperature; passes.
BUCKETS, GRAMS, SAMPLE, CALIBRATION, EPOCHS = 1 << 15, (1, 2, 3), 2400, 0.2, 3
#: Of follow-the-regularised-leader: learning rate, smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2e-3, 1e-3
#: Languages at most; more in a lang column are taken for a mistake.
LANGUAGES = 500


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def bags(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and counts of each text's n-grams; empty without a letter."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    text = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = _letters()[points]
    kept = letter.copy()  # a run of others leaves one space after a word
    kept[1:] |= letter[:-1] & (text[1:] == text[:-1])
    code = np.where(letter, points, 32)[kept].astype(np.uint64)
    text = text[kept]
    first = np.searchsorted(text, np.arange(len(low) + 1))
    hashed, running = [], np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        size = max(0, len(code) - n + 1)
        running = running[:size] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in GRAMS:
            hashed.append((mix(running + np.uint64(n)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if a == b:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        own = np.concatenate([h[a : max(a, b - n + 1)] for h, n in zip(hashed, GRAMS, strict=True)])
        if len(own) < 2000:
            yield np.unique(own, return_counts=True)
        else:
            counts = np.bincount(own, minlength=BUCKETS)
            found = np.flatnonzero(counts)
            yield found, counts[found]


def weigh(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[found]
    return x / (np.sqrt(x @ x) or 1.0)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each bucket; one row for each bucket and task."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, "text", 1 << 20):
        for found, _ in bags(batch.column("text").to_pylist()):
            total[found] += 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        made = list(bags(batch.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("at"), pa.array([f.astype("<u2").tobytes() for f, _ in made], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in made], pa.binary())], ["lang", "at", "found", "counts"])


class Model:
    """Languages in order of name, a weight for each bucket and language, inverse frequencies, temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf
        self.weights = np.zeros((BUCKETS, len(languages)), np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self.temperature = 1.0

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weigh(found, counts, self.idf) @ self.weights[found] + self.bias

    def predict(self, found: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        if not len(found) or not self.languages:
            return "und", 0.0
        z = self.logits(found, counts) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())

    def fit(self, rows: list[tuple[str, np.ndarray, np.ndarray]]) -> None:
        """Follow the regularised leader over the rows, then the temperature over the last of them."""
        held = int(len(rows) * CALIBRATION) if len(rows) >= 50 else 0
        learnt, checked = rows[held:], rows[:held] or rows
        k = len(self.languages)
        z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))  # the last row is the bias
        which = {x: i for i, x in enumerate(self.languages)}

        def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
            return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

        for _ in range(EPOCHS):
            for lang, found, counts in learnt:
                at = np.append(found, BUCKETS)
                x = np.append(weigh(found, counts, self.idf), 0.1)
                w = weights(z[at], n[at])
                s = x @ w
                p = np.exp(s - s.max())
                p /= p.sum()
                p[which[lang]] -= 1
                g = x[:, None] * p
                more = np.sqrt(n[at] + g * g) - np.sqrt(n[at])
                z[at] += g - more / ALPHA * w
                n[at] += g * g
        w = weights(z, n)
        self.weights, self.bias = w[:-1].astype(np.float32), (w[-1] * 0.1).astype(np.float32)
        logits = np.array([self.logits(f, c) for _, f, c in checked], float).reshape(-1, k)
        truth = np.array([which[lang] for lang, _, _ in checked], int)

        def loss(t: float) -> float:
            s = logits / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]).mean())

        if len(truth):
            self.temperature = float(min(np.exp(np.linspace(np.log(0.5), np.log(5), 93)), key=loss))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from text and lang of the documents that aren't held out."""
    ship(documents.sparkSession)
    learnt = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in learnt.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    total = sum(sizes.values())
    df = np.zeros(BUCKETS)
    for r in learnt.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r["bucket"]] = r["n"]
    model = Model(sorted(sizes), np.log((1 + total) / (1 + df)) + 1)
    if not total:
        return model
    # by hash, so that the same documents are chosen wherever they lie
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, sample / len(sizes) / n) * (1 << 30)))])
    chosen = learnt.withColumn("at", at).where(F.col("at") < F.element_at(share, F.col("lang"))).select("lang", "at", "text")
    rows = chosen.mapInArrow(_features, "lang string, at long, found binary, counts binary").collect()
    rows = sorted((hash_order(r["at"]), r["lang"], bytes(r["found"]), bytes(r["counts"])) for r in rows if len(r["found"]))
    model.fit([(lang, np.frombuffer(f, "<u2").astype(np.int64), np.frombuffer(c, "<u4")) for _, lang, f, c in rows])
    return model


def hash_order(at: int) -> int:
    """An order of the sample that doesn't follow the value by which it was chosen."""
    return int(mix(np.array([at], np.uint64))[0])


def _predict(model, names: tuple[str, str] = ("lang_pred", "score")) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = model.value
        for batch in slices(batches, "text", 1 << 20):
            said = [known.predict(f, c) for f, c in bags(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in said], pa.string()), pa.array([y for _, y in said], pa.float64())], [*batch.schema.names, *names])

    return run


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    said = docs.mapInArrow(_predict(spark.sparkContext.broadcast(model)), "doc_id long, text string, lang_pred string, score double")
    return said.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(documents: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents whose language is told with at least that score; columns stay as they are."""
    from pyspark.sql import types as T

    spark = documents.sparkSession
    ship(spark)
    lang, score = fresh("lang_pred", documents.columns), fresh("score", documents.columns)
    schema = T.StructType([*documents.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    said = documents.mapInArrow(_predict(spark.sparkContext.broadcast(model), (lang, score)), schema)
    return said.where((F.col(lang) != "und") & (F.col(score) >= least)).select(*documents.columns)
