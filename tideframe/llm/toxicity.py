"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, their stems (their first STEMS bytes, where they are longer), word pairs and
pairs with one word left out, lower-cased, without punctuation around them, hashed into 2**BITS coordinates; each has
the value 1. Training goes over labelled rows one by one with FTRL-proximal: every
coordinate has its own learning rate, and the L1 term leaves most weights at exactly zero, so the model is a short list
of (coordinate, weight) that is cheap to send to every worker. Scoring is a map over the whole table.

Training uses at most MAX_ROWS labelled rows, those with the smallest hash of the key (a documented bound: the model is
a classifier fitted on a bounded sample). The features of these rows are made where the rows are; one task then goes
through them in hash order, as each FTRL step depends on the one before.

Defined results: null and empty texts have no features and get the score of the intercept; rows without a label, or
with a label other than 0 and 1, do not train; of several labels of one key each trains; repeated rows are scored each;
with no rows to train on, every score is 0. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import common
from tideframe.llm.shingles import slices

BITS = 20
STEMS = (4, 6, 8)
MAX_ROWS = 16_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.1
THRESHOLD = 0.3
#: Hashes of keys are taken modulo this, for the choice of the rows that train.
DEAL = 1 << 40
#: Entries of a worker's cache of word hashes before it starts anew, and texts that it takes out of a batch at a time.
CACHE_ENTRIES, SLICE = 1 << 17, 256


PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Hashes(dict):
    """A word's hash and those of its stems (0 for a stem it is too short for), packed as unsigned 64-bit integers."""

    def __init__(self):
        super().__init__()
        self.seen = common.Seen()

    def __missing__(self, word: bytes) -> bytes:
        bare = word.strip(PUNCTUATION) or word
        stems = [xxhash.xxh3_64_intdigest(bare[:n], seed=n) if len(bare) > n else 0 for n in STEMS]
        h = struct.pack(f"<{1 + len(stems)}Q", xxhash.xxh3_64_intdigest(bare), *stems)
        if self.seen.before(word):
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = h
        return h


_HASHES = Hashes()
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """The distinct coordinates of a text, ascending."""
    words = (text or "").encode().lower().split()
    table = np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), np.uint64).reshape(len(words), 1 + len(STEMS))
    h, stems = table[:, 0], table[:, 1:].ravel()
    every = np.concatenate([h, stems[stems != 0], (h[:-1] * _PAIR) ^ h[1:], (h[:-2] * _SKIP) ^ h[2:]]) * _PAIR >> np.uint64(64 - bits)
    return np.unique(every.astype(np.int32))


class Ftrl:
    """Follow the regularised leader, proximal form, with a rate for each coordinate (McMahan et al. 2013)."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the intercept, without L1
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.l1 = np.full(size + 1, l1)
        self.l1[-1] = 0.0

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1[at]) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1[at], w, 0.0)

    def learn(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def held_out(key: Column) -> Column:
    """Rows that never train: the crc32 of the key as text leaves 2 by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> DataFrame:
    """The model: (coordinate int, weight double) of every weight that is not zero; the intercept has coordinate 2**bits."""
    common.with_workers(docs.sparkSession)
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"))
    marked = marked.where(~held_out(F.col("key")) & F.col("y").isin(0, 1)).withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(DEAL)))
    if (n := marked.count()) > 2 * max_rows:  # thin by the same hash first, so that no task sorts them all
        marked = marked.where(F.col("deal") < int(1.3 * max_rows / n * DEAL))
    chosen = marked.orderBy("deal", "key", "y").limit(max_rows).select("key", "y")
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def extract(batches):
        for batch in slices(batches, SLICE):
            at = [features(t, bits) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a in at], pa.binary())], names=["key", "y", "at"])

    def fit(batches):
        model, rows = Ftrl(1 << bits), []
        for batch in batches:
            rows += zip(batch.column(0).to_pylist(), [np.frombuffer(b, np.int32) for b in batch.column(1).to_pylist()], strict=True)
        for _ in range(epochs):
            for y, at in rows:
                model.learn(at, y)
        kept = np.flatnonzero(model.weights(np.arange(len(model.z)))) if rows else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(model.weights(kept), pa.float64())], names=["coordinate", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    # chosen has max_rows rows of two numbers at most
    rows = texts.join(F.broadcast(chosen), "key").select("key", "y", "text").mapInArrow(extract, f"key {kind}, y int, at binary")
    one = rows.orderBy(F.xxhash64("key"), "key", "y", "at").limit(max_rows).select("y", "at")
    return one.mapInArrow(fit, "coordinate int, weight double")


def score(docs: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(key, score double) of every row. The model is at most 2**bits weights, so it can be sent to every worker."""
    common.with_workers(docs.sparkSession)
    rows = model.toPandas()
    dense = np.zeros((1 << bits) + 1, np.float32)
    dense[rows["coordinate"].to_numpy(np.int64)] = rows["weight"].to_numpy()
    intercept, any_weight = float(dense[-1]), bool(len(rows))
    at = np.flatnonzero(dense[:-1]).astype(np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((at, dense[at]))

    def run(batches):
        w = np.zeros(1 << bits, np.float64)
        w[sent.value[0]] = sent.value[1]
        for batch in slices(batches, SLICE):
            out = []
            for t in batch.column(1).to_pylist():
                total = float(w[features(t, bits)].sum()) + intercept
                out.append(float(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))) if any_weight else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: DataFrame, threshold: float = THRESHOLD, text: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of docs whose score is below threshold, all columns as they are. A map without a shuffle."""
    common.with_workers(docs.sparkSession)
    rows = model.toPandas()
    at, w = rows["coordinate"].to_numpy(np.int64), rows["weight"].to_numpy()
    inner = at < 1 << bits
    intercept, any_weight = float(w[~inner].sum()), bool(len(rows))
    sent = docs.sparkSession.sparkContext.broadcast((at[inner], w[inner].astype(np.float32)))
    place = docs.columns.index(text)

    def run(batches):
        dense = np.zeros(1 << bits, np.float64)
        dense[sent.value[0]] = sent.value[1]
        for batch in slices(batches, SLICE):
            keep = []
            for t in batch.column(place).to_pylist():
                total = float(dense[features(t, bits)].sum()) + intercept
                keep.append(not any_weight or bool(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))) < threshold))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def crc32_text(key) -> int:
    return zlib.crc32(str(key).encode())
