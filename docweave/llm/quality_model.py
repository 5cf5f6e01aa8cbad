"""Quality classifier: logistic regression over hashed word n-grams, learnt by follow-the-regularised-leader.

Method. Words (runs without space) give two streams: their lower-case forms, as 1- and 2-grams, and their
shapes (letters folded to X or x, digits to 0, marks as they are, and whether the word repeats the one
before), as 1- to 3-grams. All n-grams are hashed to 2**HASH_BITS features whose values are their shares of
the text; the score is the sparse dot product with the weights, through the logistic function.

Learning reads a bounded sample: at most `per_class` labelled documents of each class, chosen by a hash.
Scoring reads every text whole, in batches, without a shuffle.

Edge cases: null or empty text scores by the bias alone; a null id is scored and never held out; very long texts are
read whole; labels of documents that do not exist, null labels
and repeated labels (the greatest counts) do no harm; with no labels every score is 0.5; repeated rows give
repeated results; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import common
from docweave.llm.ftrl import Ftrl

HASH_BITS = 18
SIZE = 1 << HASH_BITS
BIAS = SIZE
SCALE = 20.0
#: Orders of the n-grams of each stream.
FORMS, SHAPES = (1, 2), (1, 2, 3)
_KEYS = common.mix(np.arange(301, 340, dtype=np.uint64)) | np.uint64(1)
_REPEAT = np.uint64(0x9E3779B97F4A7C15)
_FOLDS = ((re.compile(rb"[a-z\x80-\xff]+"), b"x"), (re.compile(rb"[A-Z]+"), b"X"), (re.compile(rb"[0-9]+"), b"0"))

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def shape(word: bytes) -> bytes:
    for pattern, mark in _FOLDS:
        word = pattern.sub(mark, word)
    return word


class Grams:
    """Texts -> hashed n-grams of all of them, and where each text's end."""

    def __init__(self, most: int = 400_000):
        import xxhash

        self._hash, self._most, self._known = xxhash.xxh3_64_intdigest, most, {}

    def _pair(self, word: bytes) -> tuple[int, int]:
        if (p := self._known.get(word)) is None:
            p = self._known[word] = (self._hash(word.lower()), self._hash(shape(word)))
        return p

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        if not words:
            return np.empty(0, dtype=np.int64)
        if len(self._known) > self._most:
            self._known.clear()
        known = self._known
        try:
            both = np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            both = np.array([self._pair(w) for w in words], dtype=np.uint64)
        forms, shapes = both[:, 0], both[:, 1].copy()
        shapes[1:] ^= np.where(forms[1:] == forms[:-1], _REPEAT, np.uint64(0))
        out = []
        for stream, orders, key in ((forms, FORMS, 0), (shapes, SHAPES, 8)):
            for n in orders:
                m = len(stream) - n + 1
                if m > 0:
                    h = np.full(m, _KEYS[key + n], dtype=np.uint64)
                    for k in range(n):
                        h += stream[k : k + m] * _KEYS[16 + key + k]
                    out.append((h ^ (h >> np.uint64(31))) * _KEYS[0] >> np.uint64(64 - HASH_BITS))
        return np.concatenate(out).astype(np.int64)


def features(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(g, return_counts=True)
    return np.append(at, BIAS).astype(np.int32), np.append(SCALE * n / max(1, len(g)), 1.0).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1200, epochs: int = 6, id_col="doc_id", text_col="text", label_col="quality") -> np.ndarray:
    """Weights (of class 1) from labelled rows; labels: the rows to learn from."""
    known = (
        labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("at", F.xxhash64("doc_id"))
    )
    chosen = common.first_of_each(known, "label", ["at", "doc_id"], per_class).select("doc_id", "label")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    #: At most 2 * per_class ids.
    sample = rows.join(F.broadcast(chosen), "doc_id")

    def shorten(batches):
        import pyarrow as pa

        grams = Grams()
        for batch in batches:
            found = [features(grams(t)) for t in common.texts_as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())], names=["label", "f", "x"])

    got = sorted(sample.mapInArrow(common.tidied(shorten), "label int, f binary, x binary").collect(), key=lambda r: (bytes(r.f), bytes(r.x), r.label))
    fit = Ftrl(SIZE + 1, 2, alpha=0.5, l1=0.02, l2=0.001)
    if got:
        fit.fit([(np.frombuffer(r.f, dtype=np.int32), np.frombuffer(r.x, dtype=np.float32)) for r in got], np.array([r.label for r in got]), epochs)
    w = fit.weights()
    return (w[:, 1] - w[:, 0]).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, held_out=None, threshold: float = 0.7, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row its score and prediction. The weights' size is fixed by HASH_BITS (1 MB)."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work(batches):
        import pyarrow as pa

        w, grams = shared.value, Grams()
        for batch in batches:
            s = np.empty(batch.num_rows)
            for k, text in enumerate(common.texts_as_bytes(batch.column(1))):
                g = grams(text)
                s[k] = w[BIAS] + (SCALE * w[g].sum(dtype=np.float64) / len(g) if len(g) else 0.0)
            p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=SCHEMA.names)

    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out")).mapInArrow(common.tidied(work), SCHEMA)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held = common.fold_col("doc_id", 4) == 2
    common.small_batches(spark)
    return score(docs, train(docs, labels.filter(~held)), held)
