"""Hybrid search in one call: keyword and vector rankings of a question and its rewrites, fused, folded, reranked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import dense, fusion, sparse
from docweave.operators.ranked import BlockIndex
from docweave.operators.small_world import GraphIndex


def hybrid_search(
    queries: DataFrame,
    post: DataFrame,
    vectors: DataFrame | GraphIndex,
    embed: Callable[[DataFrame], DataFrame],
    *,
    top_n: int = 5,
    depth: int = 10,
    tokenizer: str = "bigram",
    sparse_weight: float = 1.0,
    scope: DataFrame | None = None,
    rewrites: DataFrame | None = None,
    keys: DataFrame | None = None,
    member_cap: int = 1,
    floor: float = 0.0,
    candidates: int | None = None,
    rerank: Callable[[DataFrame], DataFrame] | None = None,
    index: BlockIndex | None = None,
) -> DataFrame:
    """query_id, rank, item, rrf_score, rerank_score, score: the best `top_n` per query.

    queries: query_id, text. post: the stored postings (chunk_id, term, tf); vectors: item, embedding, of the same
    chunks, or a graph index of them, whose search is approximate. index: the block index of post, which unscoped
    searches read in its place. embed: texts (query_id, text) -> query_id, embedding. scope: chunk_id rows that may be found, below the
    ranking (None: all; an empty table finds nothing). rewrites: query_id, text, variant (from 1); each adds a dense
    and a sparse ranking. keys: item, grp; groups are folded to their best member. floor cuts fused scores after the
    first `candidates` are taken. rerank: candidates (query_id, item, rank) -> query_id, item, rerank_score."""
    if scope is not None:
        post = post.join(scope.select("chunk_id"), "chunk_id", "left_semi")
        vectors = (vectors.vectors() if isinstance(vectors, GraphIndex) else vectors).join(scope.select(F.col("chunk_id").alias("item")), "item", "left_semi")
    asked = queries.select("query_id", F.lit(0).alias("variant"), "text")
    if rewrites is not None:
        asked = asked.unionByName(rewrites.select("query_id", F.col("variant").cast("int").alias("variant"), "text"))
    asked = asked.withColumn("key", F.xxhash64("query_id", "variant"))
    texts = asked.select(F.col("key").alias("query_id"), "text")
    terms = sparse.without_stop_words(sparse.query_terms(texts, tokenizer))
    words = index.keyword_search(terms, depth) if index is not None and scope is None else sparse.keyword_search_blocks(terms, post, depth)
    near = vectors.search(embed(texts), depth) if isinstance(vectors, GraphIndex) else dense.nearest(embed(texts), vectors, depth)
    arms = near.select("query_id", F.lit(0).alias("arm"), "rank", "item", F.lit(1.0).alias("weight")).unionByName(words.select("query_id", F.lit(1).alias("arm"), "rank", F.col("chunk_id").alias("item"), F.lit(float(sparse_weight)).alias("weight")))
    names = asked.select(F.col("key").alias("__key"), F.col("query_id").alias("__query"), "variant")
    rankings = arms.join(names, F.col("query_id") == F.col("__key")).select(F.col("__query").alias("query_id"), (2 * F.col("variant") + F.col("arm")).alias("ranking_no"), F.col("rank").alias("pos"), "item", "weight")
    fused = fusion.reciprocal_rank_fusion(rankings) if keys is None else fusion.fuse_groups(rankings, keys, member_cap=member_cap)
    kept = fusion.cap_and_floor(fused, candidates or max(top_n, depth), floor)
    return fusion.top_after_rerank(kept, rerank(kept.select("query_id", "item", "rank")) if rerank else None, top_n)
