"""Native quality rules: cross-document line frequency and per-document measures, DataFrame functions only.

Method. Each normalised line (lower case, runs of white space, digits and punctuation folded; a line without a
letter is taken as it is but for white space) is hashed; per host, the distinct texts that hold a line are counted. Lines held by more than a share of the host's texts,
and by more than a least number, are removed; a document that keeps too little of its words is rejected.
Copies of one whole text count once, so that a document is not depleted for having exact copies.

Scale. Lines travel as 64-bit hashes. Counting is partial before each shuffle; the frequent lines join back
on (host, line, salt): every line's rows are dealt over SALTS keys, so a line that a third of all documents
hold does not meet in one task. Nothing is broadcast by hint; no Python runs.

Edge cases: null or empty text has zero measures and fails the base rules (no words); a null host is a host
of its own; repeated rows are documents of their own, with one result each; columns of the input other than
the three named are not read, so they cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import common

WINDOW = 8
SALTS = 16
_SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, common.WORD_BREAKS)).otherwise(F.array().cast("array<string>"))


def repeat_words(words: str, hashes: str) -> Column:
    """Words inside 8-word windows that occur twice or more; `hashes` holds the windows' hashes in order."""
    return F.expr(
        f"""CASE WHEN size(array_distinct({hashes})) = size({hashes}) THEN 0L ELSE
        aggregate(
          array_sort(flatten(transform(array(sort_array(transform({hashes}, (h, i) -> struct(h AS h, i AS i)))), s ->
            filter(transform(s, (x, j) -> CASE
                WHEN (j > 0 AND s[j - 1].h = x.h) OR (j + 1 < size(s) AND s[j + 1].h = x.h) THEN x.i ELSE -1 END), i -> i >= 0)))),
          struct(0L AS n, -1 AS until),
          (a, i) -> struct(a.n + (i + {WINDOW} - greatest(i, a.until)) AS n, i + {WINDOW} AS until),
          a -> a.n) END"""
    )


def line_hashes(text: Column) -> Column:
    """A struct per line that has a word: the hash of the normalised line and the code points of its words."""
    folded = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\n]+", " "), "\n")
    bare = F.split(F.regexp_replace(text, r"[ \t\x0B\f\r]+", ""), "\n")
    return F.zip_with(folded, bare, lambda x, y: F.struct(F.xxhash64(F.when(F.trim(x) == "", y).otherwise(F.trim(x))).alias("hash"), F.length(y).alias("chars")))


def line_frequency(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_share: float = 0.01,
    min_texts: int = 20,
    min_left: float = 0.5,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """Measures and verdict of every row. A line is removed on a host where more than min_texts distinct
    texts, and more than max_share of all, hold it; a document is kept if the base rules pass and at least
    min_left of its words' code points are left."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\0null")).alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lined = rows.withColumn("lines", F.filter(line_hashes(F.col("text")), lambda x: x["chars"] > 0))

    held = lined.select("host", F.xxhash64("text").alias("copy"), F.explode(F.array_distinct(F.col("lines.hash"))).alias("line"))
    texts = rows.select("host", F.xxhash64("text").alias("copy")).distinct().groupBy("host").agg(F.count("*").alias("n_texts"))
    frequent = (
        held.distinct()
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > min_texts)
        .join(texts, "host")
        .filter(F.col("n") > max_share * F.col("n_texts"))
        .select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        .withColumn("removed", F.lit(True))
    )

    words = words_of(F.col("text"))
    measured = (
        lined.withColumn("words", words)
        .withColumn("windows", F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "host",
            "lines",
            F.struct(
                F.size("words").cast("bigint").alias("n_words"),
                F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
                (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
                F.expr(r"size(filter(split(text, '\n'), x -> length(btrim(x, ' \t\n\u000b\u000c\r')) > 0)) - size(array_distinct(filter(split(text, '\n'), x -> length(btrim(x, ' \t\n\u000b\u000c\r')) > 0)))").cast("bigint").alias("n_dup_lines"),
                repeat_words("words", "windows").cast("bigint").alias("n_repeat_words"),
            ).alias("m"),
        )
    )
    #: Row by row: the first line of a document brings its measures.
    lines = measured.select("row", "doc_id", "host", "m", F.posexplode_outer("lines").alias("at", "x")).select(
        "row",
        "doc_id",
        "host",
        F.col("x.hash").alias("line"),
        F.col("x.chars").alias("chars"),
        F.when(F.coalesce(F.col("at"), F.lit(0)) == 0, F.col("m")).alias("m"),
        F.pmod(F.col("row"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    judged = (
        lines.join(frequent, ["host", "line", "salt"], "left")
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("m").alias("m"), F.sum(F.when(F.col("removed"), F.col("chars")).otherwise(0)).alias("gone"))
        .select("doc_id", "m.*", F.coalesce(F.col("gone"), F.lit(0)).cast("bigint").alias("removed_chars"))
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("word_chars") - F.col("removed_chars") >= min_left * F.col("word_chars")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency(common.table(spark, sf_dir, "documents"))
