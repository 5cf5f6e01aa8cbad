"""Retrieval metrics per question and their group means with a grand total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import trigrams


def per_question(delivered: DataFrame, gold: DataFrame, questions: DataFrame, top_n: int) -> DataFrame:
    """delivered: query_id, item, rank, content; gold: query_id, item; questions: query_id, grp, anchor.

    recall: any gold item delivered; precision: hits / top_n, however few are delivered; anchor: the answer
    sentence is in what was delivered."""
    hits = delivered.filter(F.col("rank") <= top_n).join(gold.withColumn("hit", F.lit(1)), ["query_id", "item"], "left").join(questions.select("query_id", "anchor"), "query_id")
    scored = hits.groupBy("query_id").agg(F.count("hit").alias("hits"), F.max(F.contains(F.col("content"), F.col("anchor")).cast("int")).alias("anchor_hit"), F.count("*").alias("delivered"))
    return questions.select("query_id", "grp").join(scored, "query_id", "left").select("query_id", "grp", (F.coalesce("hits", F.lit(0)) > 0).cast("int").alias("recall"), (F.coalesce("hits", F.lit(0)) / F.lit(float(top_n))).alias("precision"), F.coalesce("anchor_hit", F.lit(0)).alias("anchor"), F.coalesce("delivered", F.lit(0)).cast("bigint").alias("delivered"))


def group_means(rows: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Means by group and over all (group ALL) in one pass."""
    return rows.rollup("grp").agg(F.count("*").alias("n"), *[F.round(F.avg(c), digits).alias(c) for c in columns]).withColumn("grp", F.coalesce("grp", F.lit("ALL")))


def sweep(configurations: DataFrame, rankings: DataFrame, gold: DataFrame, questions: DataFrame, digits: int = 6) -> DataFrame:
    """configurations: config, arm, top_n, floor; rankings: arm, query_id, item, rank, score (each arm searched once, to the
    greatest depth asked for); gold: query_id, item; questions: query_id. Per configuration mean recall, precision and
    reciprocal rank over all questions, those without any result included."""
    asked = questions.select("query_id").distinct().agg(F.count("*").alias("questions"))
    hits = rankings.join(gold.select("query_id", "item").distinct().withColumn("hit", F.lit(1)), ["query_id", "item"], "left")
    taken = hits.join(configurations, "arm").filter((F.col("rank") <= F.col("top_n")) & (F.col("score") >= F.col("floor")))
    each = taken.groupBy("config", "top_n", "query_id").agg(F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    sums = each.groupBy("config").agg(F.count_if(F.col("hits") > 0).alias("found"), F.sum(F.col("hits") / F.col("top_n")).alias("precision"), F.sum(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("reciprocal"))
    mean = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / F.col("questions"), digits)
    return configurations.select("config", "arm", "top_n", "floor").join(sums, "config", "left").crossJoin(asked).select("config", "arm", "top_n", "floor", mean("found").alias("recall"), mean("precision").alias("precision"), mean("reciprocal").alias("mrr"))


def anchor_places(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """documents: doc_id, text; questions: query_id, anchor. doc_id, query_id, at (characters before it), chars: where
    each document's first copy of an anchor starts, for every document that holds it.

    An anchor's second to fourth words are whole words wherever it stands, so documents and anchors join on the hash of
    three neighbouring words, and only these pairs are looked up. Anchors of under five words have no such three and
    are sought in every text. Null texts hold nothing; null and empty anchors are nowhere."""
    d, q = documents.select("doc_id", "text"), questions.select("query_id", "anchor").filter(F.length("anchor") > 0)
    words = q.withColumn("w", F.split("anchor", r"[ \t-\r]+"))
    long = words.filter(F.size("w") >= 5).select("query_id", "anchor", F.xxhash64(F.get("w", F.lit(1)), F.get("w", F.lit(2)), F.get("w", F.lit(3))).alias("key"))
    w = F.split("text", r"[ \t-\r]+")
    triples = F.arrays_zip(w.alias("a"), F.slice(w, 2, F.size(w)).alias("b"), F.slice(w, 3, F.size(w)).alias("c"))
    keys = F.array_distinct(F.transform(triples, lambda x: F.xxhash64(x["a"], x["b"], x["c"])))
    near = d.select("doc_id", F.explode(keys).alias("key")).join(long, "key").select("doc_id", "query_id", "anchor")
    short = words.filter(F.size("w") < 5).select("query_id", "anchor")
    held = trigrams.candidates_in(d, short.select(F.col("anchor").alias("pattern_id"), F.col("anchor").alias("pattern")).distinct(), "doc_id", "text")
    near = near.unionByName(held.withColumnRenamed("pattern_id", "anchor").join(short, "anchor").select("doc_id", "query_id", "anchor"))
    pairs = d.join(near, "doc_id")
    return pairs.select("doc_id", "query_id", (F.expr("instr(text, anchor)") - 1).alias("at"), F.length("anchor").alias("chars")).filter("at >= 0").distinct()


def stale_questions(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Questions whose anchor is in no document any more."""
    return questions.join(anchor_places(documents, questions), "query_id", "left_anti")
