"""Fusion of rankings: reciprocal rank fusion, group folding, floors, corroboration, evidence strength.

Rankings are rows (query_id, ranking_no, pos, item, weight); sums run in ranking order, as floating-point
addition in another order changes ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deduplicated(rankings: DataFrame) -> DataFrame:
    """First occurrence of each item in each ranking, positions renumbered from 1."""
    first = rankings.groupBy("query_id", "ranking_no", "item").agg(F.min("pos").alias("at"), F.first("weight").alias("weight"))
    order = Window.partitionBy("query_id", "ranking_no").orderBy("at")
    return first.withColumn("pos", F.row_number().over(order)).drop("at")


def _ordered_sum(order: Column, value: Column) -> Column:
    return F.aggregate(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), F.lit(0.0), lambda a, x: a + x["v"])


def reciprocal_rank_fusion(rankings: DataFrame, k: float = 60) -> DataFrame:
    """query_id, item, score, rank. Ties go to the item that appears first in (ranking, position)."""
    if k < 0:
        raise ValueError("k must not be negative")
    scored = (
        deduplicated(rankings)
        .groupBy("query_id", "item")
        .agg(_ordered_sum(F.col("ranking_no"), F.col("weight").cast("double") / (F.lit(float(k)) + F.col("pos"))).alias("score"), F.min(F.struct("ranking_no", "pos")).alias("seen"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return scored.withColumn("rank", F.row_number().over(order)).drop("seen")


def group_key(doc: Column, chunk: Column, strategy: Column, path: Column, section: Column) -> Column:
    filled = lambda c: c.isNotNull() & (c != "")
    return F.when((strategy == "hierarchical") & filled(path), F.concat(doc, F.lit("#p:"), path)).when((strategy == "classification_table") & filled(section), F.concat(doc, F.lit("#s:"), section)).otherwise(chunk)


def fuse_groups(rankings: DataFrame, keys: DataFrame, k: float = 60, member_cap: int = 1) -> DataFrame:
    """Fusion by group: query_id, grp, item (the representative), score, members, rank.

    Per ranking only a group's first member_cap members add to the score; the representative is the member
    with the largest single contribution. keys: item, grp; an item without one is its own group."""
    rows = deduplicated(rankings).join(keys, "item", "left").withColumn("grp", F.coalesce("grp", "item"))
    rows = rows.withColumn("part", F.col("weight").cast("double") / (F.lit(float(k)) + F.col("pos")))
    in_group = Window.partitionBy("query_id", "ranking_no", "grp").orderBy("pos")
    ever = Window.partitionBy("query_id", "grp", "item").orderBy("ranking_no", "pos")
    along = Window.partitionBy("query_id").orderBy("ranking_no", "pos")
    rows = rows.withColumn("nth", F.row_number().over(in_group)).withColumn("new", (F.row_number().over(ever) == 1).cast("int"))
    rows = rows.withColumn("order", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = rows.groupBy("query_id", "grp").agg(
        _ordered_sum(F.struct("ranking_no", "pos"), F.when(F.col("nth") <= member_cap, F.col("part")).otherwise(0.0)).alias("score"),
        F.min_by("item", F.struct(-F.col("part"), "order", "item")).alias("item"),
        F.count_distinct("item").alias("members"),
        F.min(F.struct("ranking_no", "pos")).alias("seen"),
    )
    return grouped.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seen"))).drop("seen")


def cap_and_floor(fused: DataFrame, limit: int, floor: float = 0.0) -> DataFrame:
    """The cap first, then the floor; a floor of zero is absent."""
    out = fused.filter(F.col("rank") <= limit)
    return out.filter(F.col("score") >= floor) if floor > 0 else out


def corroborated(rankings: DataFrame, keys: DataFrame) -> DataFrame:
    """query_id, grp, corroborated: seen by a dense and by a sparse ranking. rankings have `arm`."""
    rows = rankings.join(keys, "item", "left").withColumn("grp", F.coalesce("grp", "item"))
    return rows.groupBy("query_id", "grp").agg((F.bool_or(F.col("arm") == "dense") & F.bool_or(F.col("arm") == "sparse")).alias("corroborated"))


def evidence_is_weak(items: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """items: query_id, source_type, rrf_score, variants, corroborated. Weak: nothing; or only retrieved text
    whose best score per variant is under `least`, or with nothing corroborated."""
    strength = items.groupBy("query_id").agg(F.bool_or(F.col("source_type") != "rag").alias("other"), F.max(F.col("rrf_score") / F.col("variants")).alias("best"), F.bool_or("corroborated").alias("both"))
    weak = F.when(F.col("other").isNull(), True).when(F.col("other"), False).when(F.col("best") < least, True).otherwise(~F.col("both"))
    return queries.select("query_id").join(strength, "query_id", "left").select("query_id", weak.alias("weak"))


def parse_permutation(answer: Column, n: Column) -> Column:
    """A reranker's answer as positions (from 0): a strict permutation of n, else the given order."""
    got = F.transform(F.regexp_extract_all(answer, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    want = F.sequence(F.lit(0), n - 1)
    return F.when((F.size(got) == n) & (F.sort_array(got) == want), got).otherwise(want)


def top_after_rerank(fused: DataFrame, scores: DataFrame | None, n: int) -> DataFrame:
    """query_id, rank, item, rrf_score, rerank_score, score. The cut comes after reranking, whose order is authoritative:
    items with a score first, by it, then the others in the fused order. score is the reranker's, zero included,
    else the fused one. scores: query_id, item, rerank_score; None: not reranked."""
    rows = fused.withColumn("rerank_score", F.lit(None).cast("double")) if scores is None else fused.join(scores.select("query_id", "item", "rerank_score"), ["query_id", "item"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    ranked = rows.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n)
    return ranked.select("query_id", F.col("__rank").alias("rank"), "item", F.col("score").alias("rrf_score"), "rerank_score", F.coalesce("rerank_score", "score").alias("score"))


def variant_rankings(variants: DataFrame, sparse_weight: float = 0.7) -> DataFrame:
    """variants: query_id, variant (0: the question itself), text. The rankings to be made, in order: each variant's
    dense one, then its sparse one."""
    arms = F.array(F.struct(F.lit("dense").alias("arm"), F.lit(1.0).alias("weight"), F.lit(0).alias("n")), F.struct(F.lit("sparse").alias("arm"), F.lit(float(sparse_weight)).alias("weight"), F.lit(1).alias("n")))
    return variants.withColumn("x", F.explode(arms)).select("query_id", "variant", "text", "x.arm", "x.weight", (2 * F.col("variant") + F.col("x.n")).alias("ranking_no"))


def retried(first: DataFrame, weak: DataFrame, second: DataFrame) -> DataFrame:
    """Evidence after a second pass: weak queries (query_id, weak) have the second pass's rows alone, the others the
    first's. Adds pass."""
    again = weak.filter("weak").select("query_id")
    return first.join(again, "query_id", "left_anti").withColumn("pass", F.lit(1)).unionByName(second.join(again, "query_id", "left_semi").withColumn("pass", F.lit(2)))
