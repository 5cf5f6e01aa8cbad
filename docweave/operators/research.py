"""The deterministic half of research runs: query cleaning, pools of hits, ranking, evidence blocks, citations."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_queries(queries: Column, least: int = 2, most: int = 100) -> Column:
    flat = F.transform(queries, lambda q: F.trim(F.regexp_replace(q, r"\s+", " ")).substr(1, most))
    return F.array_distinct(F.filter(flat, lambda q: F.length(q) >= least))


def merge_hits(pool: DataFrame, hits: DataFrame) -> DataFrame:
    """Best score per key; a hit replaces only a strictly lower score. `added` marks keys that the pool lacked."""
    rows = pool.withColumn("old", F.lit(1)).unionByName(hits.withColumn("old", F.lit(0)))
    return rows.groupBy("key").agg(F.max("score").alias("score"), (F.max("old") == 0).alias("added"))


def rank_sources(pool: DataFrame, limit: int) -> DataFrame:
    """pool: query_id, key, doc_id, section, score, seq. Best per document and section, by score, at least one."""
    best = pool.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_id", F.coalesce("section", F.col("key").cast("string"))).orderBy(F.desc("score"), "seq"))).filter("n = 1").drop("n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seq"))).filter(F.col("rank") <= max(1, limit))


def group_by_document(ranked: DataFrame) -> DataFrame:
    """Stable: documents in the order of their first source."""
    first = F.min("rank").over(Window.partitionBy("query_id", "doc_id"))
    return ranked.withColumn("first", first).withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "rank"))).drop("first")


def cited_numbers(report: Column, total: Column) -> Column:
    groups = F.regexp_extract_all(report, F.lit(r"\[([0-9]+(?:\s*,\s*[0-9]+)*)\]"), F.lit(1))
    numbers = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= total))))


def clamp(value: Column, least: int, most: int, default: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(F.try_to_number(value, F.lit("999999")).cast("int"), F.lit(default))))


def parse_json_object(text: str) -> dict | None:
    """From the first brace to the last; None if that is no object."""
    a, b = text.find("{"), text.rfind("}")
    try:
        found = json.loads(text[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def run(question: str, plan: Callable, search: Callable, gaps: Callable, write: Callable, rounds: int = 2, most: int = 12) -> dict:
    """Plan, search, fill gaps until a round brings nothing new, rank, write, keep the cited sources.

    The callables are injected; hits are dictionaries with key and score."""
    pool: dict = {}

    def take(queries):
        new = 0
        for q in queries:
            for h in search(q):
                if h["key"] not in pool:
                    new += 1
                    pool[h["key"]] = h
                elif h["score"] > pool[h["key"]]["score"]:
                    pool[h["key"]] = h
        return new

    take(plan(question))
    for _ in range(rounds):
        if not take(gaps(question, list(pool.values()))):
            break
    best: dict = {}
    for h in pool.values():
        at = (h.get("doc_id"), h.get("section") or h["key"])
        if at not in best or h["score"] > best[at]["score"]:
            best[at] = h
    sources = sorted(best.values(), key=lambda h: -h["score"])[: max(1, most)]
    report = write(question, sources)
    import re

    numbers = sorted({int(n) for g in re.findall(r"\[([0-9]+(?:\s*,\s*[0-9]+)*)\]", report) for n in g.split(",") if 1 <= int(n) <= len(sources)})
    return {"report": report, "sources": [sources[n - 1] for n in numbers], "found": len(pool)}
