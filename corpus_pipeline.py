"""The corpus pipeline: language ID, near copies, repeated passages, benchmark leaks, tokens.

Each stage is a function of (spark, docs, sf_dir); its result is written and read again as the next one's
docs. All but the last return the columns of documents; the last returns the tokenised corpus.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, common, decontaminate, language_id, near_dup, repeats


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or whose language is known with less than even odds."""
    common.small_batches(spark)
    return language_id.keep_identified(docs, language_id.train(docs), min_score=0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays: the smallest id."""
    return near_dup.keep_first_copies(docs, percent=80)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out what repeats 100 bytes or more of an earlier document or an earlier place; all documents stay."""
    return repeats.remove_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids, their number and the digest of the bytes that they decode to."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, remembered=200_000, batch_bytes=2_000_000)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_dup", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("decontaminate", drop_leaks),
    ("byte_bpe", tokenize),
]

#: Trained scores, minima and BPE merges are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    shelf = common.Shelf(spark)
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shelf.put(docs)
    return docs
