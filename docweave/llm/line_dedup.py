"""Native line dedup: lines that recur across documents stay in one of them, DataFrame functions only.

Method. Every text is exploded into its lines; a line's key (white space stripped at both ends, A-Z lower-cased) is
hashed, distinct documents are counted per hash, and where a key of min_chars code points or more is in min_docs
documents or more, all its lines go except those of the largest doc_id that holds it. Texts are put together
again by position.

Scale. Keys travel as two 64-bit hashes with different seeds, so that 128 bits tell keys apart. Counting is by
(hash, document) first and then partial by hash, so that a line in a third of all documents is spread over tasks
both times. The keys that go meet their lines on (hash, salt); the positions to drop come back per row, bounded
by the row's own lines. A text travels once, to its dropped positions; nothing is broadcast by hint.

Edge cases: a null or empty text is one empty line; documents are told apart by doc_id, so repeated rows of one
id count once and keep or lose lines alike; rows with a null id are one document that sorts before all others;
an empty table gives no rows; columns of the input other than the two named are not read, so they cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import common

MIN_CHARS, MIN_DOCS = 40, 5
SALTS = 16
_SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def long_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """row, doc_id, pos, h1, h2: the lines of (row, doc_id, text) whose key has min_chars code points or more."""
    lines = rows.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    stripped = lines.select("row", "doc_id", "pos", F.btrim("line", F.lit(_SPACES)).alias("line")).filter(F.length("line") >= min_chars)
    key = F.translate("line", _UPPER, _LOWER)
    return stripped.select("row", "doc_id", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def recurring(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, n_docs, last_id: the keys in min_docs documents or more, and the largest id that holds each."""
    held = lines.select("h1", "h2", "doc_id").distinct()
    return held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_id")).filter(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines (before), n_dropped: a row for every row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = long_lines(rows, min_chars)
    often = recurring(lines, min_docs).select("h1", "h2", "last_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = lines.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    gone = salted.join(often, ["h1", "h2", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("last_id")))
    dropped = gone.groupBy("row").agg(F.collect_list("pos").alias("dropped"))
    #: In an array of one struct the lines are made once, not once a position; array_except keeps order, by hashing.
    parts = F.array(F.struct(F.split("text", "\n").alias("lines"), F.col("dropped").alias("dropped")))
    left = F.transform(parts, lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["dropped"]), lambda i: F.get(s["lines"], i)), "\n"))
    return rows.join(dropped, "row", "left").select(
        "doc_id",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(left[0]).alias("text"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(common.table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
