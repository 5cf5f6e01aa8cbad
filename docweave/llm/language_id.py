"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Method. A text is lower-cased and its letters are kept (other characters act as one break). Its 1- to
3-grams are hashed to 2**HASH_BITS features; a feature's value is its share of the text's n-grams times the
feature's inverse document frequency. Weights are learnt by FTRL with elastic-net penalties; the logits are
divided by a temperature fitted on a part of the sample that the fit does not see.

Document frequencies cover every training document (one count per feature, summed in Spark: a fixed size,
however large the corpus). The fit itself reads a bounded sample: at most `per_language` documents of each
language, those whose text hashes come first.

Edge cases: null text or text without a letter: `und`, score 0.0; languages are whatever non-null `lang`
values the training rows have (rows with a null id teach and are never held out); with no training rows every text is `und`; very long texts are read whole;
repeated rows give repeated results; other columns are not read (predict) or pass through (keep_identified).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import common
from docweave.llm.ftrl import Ftrl, softmax, temperature

HASH_BITS = 15
SIZE = 1 << HASH_BITS
GRAMS = 3
SCALE = 20.0

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_KEYS = common.mix(np.arange(101, 101 + GRAMS, dtype=np.uint64)) | np.uint64(1)


def _letters() -> np.ndarray:
    """Code point -> lower-case letter's code point, 0 for what is no letter."""
    import regex

    out = np.zeros(0x110000, dtype=np.uint32)
    for ch in regex.findall(r"\p{L}", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))):
        low = ch.lower()
        out[ord(ch)] = ord(low) if len(low) == 1 else ord(ch)
    return out


_TABLE: list[np.ndarray] = []


def grams(text: str) -> np.ndarray | None:
    """Hashed 1- to 3-grams of the text's letters, with a break on both sides of each word; None if no letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    c = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    c = np.concatenate([[np.uint32(0)], c, [np.uint32(0)]])
    c = c[(c != 0) | np.concatenate([[True], c[:-1] != 0])].astype(np.uint64)
    if len(c) < 2 or not c.any():
        return None
    out, h = [], np.zeros(len(c), dtype=np.uint64)
    for n in range(GRAMS):
        h = (h[: len(c) - n] + c[n:]) * _KEYS[n]
        out.append((h ^ (h >> np.uint64(29))) * _KEYS[0] >> np.uint64(64 - HASH_BITS))
    return np.concatenate(out).astype(np.int64)


def features(g: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(g, return_counts=True)
    return at, SCALE * n / len(g) * idf[at]


class Model:
    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, np.ascontiguousarray(table, dtype=np.float32)

    def __call__(self, text: str | None) -> tuple[str, float]:
        g = grams(text) if text and self.languages else None
        if g is None:
            return "und", 0.0
        p = softmax(SCALE * np.bincount(g, minlength=SIZE).astype(np.float32) @ self.table / len(g))
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """rows: one column, text. The number of texts that hold each feature; at 0 past the end, all texts."""

    def work(batches):
        import pyarrow as pa

        total, n = np.zeros(SIZE, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                g = grams(text or "")
                if g is not None:
                    total += np.bincount(g, minlength=SIZE) > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, SIZE), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], names=["feature", "n"])

    counted = rows.mapInArrow(common.tidied(work), "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(SIZE + 1, dtype=np.int64)
    for feature, n in counted.collect():
        out[feature] = n
    return out


def train(docs: DataFrame, per_language: int = 600, text_col="text", lang_col="lang", epochs: int = 4) -> Model:
    """docs: the rows to learn from."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    df = document_frequencies(rows.select("text"))
    idf = np.log((1 + df[SIZE]) / (1 + df[:SIZE])) + 0.1
    local = rows.select("lang", F.xxhash64("text").alias("at"), "text").filter(F.col("text").rlike(r"\p{L}"))
    first = common.first_of_each(local.select("lang", "at").distinct(), "lang", ["at"], per_language)
    sample = local.join(F.broadcast(first.select("lang", "at")), ["lang", "at"], "left_semi").dropDuplicates(["lang", "at"])

    def shorten(batches):
        import pyarrow as pa

        for batch in batches:
            found = [features(grams(t), idf) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary())], names=["lang", "at", "f", "x"])

    got = sorted(sample.mapInArrow(common.tidied(shorten), "lang string, at bigint, f binary, x binary").collect(), key=lambda r: (r.at, r.lang))
    languages = sorted({r.lang for r in got})
    if not languages:
        return Model([], np.zeros((SIZE, 0)))
    data = [(np.frombuffer(r.f, dtype=np.int32), np.frombuffer(r.x, dtype=np.float32)) for r in got]
    labels = np.array([languages.index(r.lang) for r in got])
    apart = np.arange(len(data)) % 5 == 4
    fit = Ftrl(SIZE, len(languages), alpha=0.5, l1=0.01, l2=0.001)
    fit.fit([d for d, a in zip(data, apart) if not a], labels[~apart], epochs)
    w = fit.weights()
    held = [x @ w[f] for (f, x), a in zip(data, apart) if a]
    t = temperature(np.array(held), labels[apart]) if held else 1.0
    return Model(languages, idf[:, None] * w / t)


def predict(docs: DataFrame, model: Model, held_out=None, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row its language and the calibrated probability. The model's size is fixed by HASH_BITS and the languages."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            found = [shared.value(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([k for k, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=SCHEMA.names)

    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out")).mapInArrow(common.tidied(work), SCHEMA)


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.5, text_col="text") -> DataFrame:
    """The rows whose language is known with at least min_score; all columns are kept."""
    common.small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            found = [shared.value(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([k != "und" and p >= min_score for k, p in found], pa.bool_()))

    return docs.mapInArrow(common.tidied(work), docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    common.small_batches(spark)
    held = F.coalesce(common.fold_col("doc_id", 5) == 0, F.lit(False))
    return predict(docs, train(docs.filter(~held)), held)
