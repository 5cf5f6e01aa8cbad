"""From texts to chunks: a collection's strategy, each document's character, and the fallback for documents without a hierarchy."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators import chunking, hierarchy, tables
from docweave.operators.chunking import TokenCounter, approximate_tokens
from docweave.operators.citations import Scheme, resolve_scheme, section_marker

CHARACTERS = ("reference_dependent", "self_contained")
STRATEGIES = ("size", "rows", "semantic", "hierarchical", tables.STRATEGY)


@dataclass(frozen=True)
class Strategy:
    name: str
    scheme: Scheme | None = None
    table: tables.Table | None = None

    @property
    def spine(self) -> str:
        return section_marker(self.scheme).pattern

    @property
    def citation(self) -> str:
        return "|".join(f"(?:{re.sub(r'\(\?P<[^>]+>', '(?:', p.pattern)})" for p in self.scheme.citations)


def resolve_strategy(config: dict | None) -> Strategy:
    """What a collection asks for; nothing is guessed from texts, and what cannot work is refused before any text is read."""
    name = (config or {}).get("strategy", "size")
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}")
    return Strategy(name, resolve_scheme(config) if name == "hierarchical" else None, tables.resolve_table(config))


def paragraphs(docs: DataFrame, marker: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks: lines that follow one another without a blank line are one paragraph; with a marker, a line that it
    matches is a block of its own. Null and empty texts have no block. doc_id, block_no, text, block_type, section."""
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    own = line.rlike(f"^(?:{marker})") if marker else F.lit(False)
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("n", "line")).select("doc_id", "n", line.alias("line"), own.alias("own"))
    w = Window.partitionBy("doc_id").orderBy("n")
    opens = F.col("own") | F.coalesce(F.lag(F.col("own") | (F.col("line") == "")).over(w), F.lit(True))
    numbered = lines.withColumn("opens", opens).withColumn("block_no", F.sum(F.col("opens").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).filter("line <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ")
    return numbered.groupBy("doc_id", "block_no").agg(joined.alias("text")).select("doc_id", "block_no", "text", F.lit("paragraph").alias("block_type"), F.lit(None).cast("string").alias("section"))


def characters(detected: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """detected: doc_id, character (and what else detection tells); overrides: doc_id, override, at most one a document.
    A known override wins over what is detected and stays beside it; an unknown one counts as none."""
    found = detected.withColumnRenamed("character", "detected")
    if overrides is None:
        return found.withColumn("override", F.lit(None).cast("string")).withColumn("character", F.col("detected"))
    told = overrides.filter(F.col("override").isin(*CHARACTERS)).select("doc_id", "override")
    return found.join(told, "doc_id", "left").withColumn("character", F.coalesce("override", "detected"))


def chunk_documents(docs: DataFrame, config: dict | None, overrides: DataFrame | None = None, max_tokens: int = 1300, target_chars: int = 1000, overlap: int = 150, count: TokenCounter = approximate_tokens, **thresholds) -> DataFrame:
    """docs: doc_id, text. doc_id, chunk_index, content, section, path, strategy (the one that made the chunk).

    A hierarchical collection's documents are parsed with its marker and judged; those that do not refer to their own
    provisions are parsed again without the marker and cut by size, so that they come out as in any other collection.
    thresholds: of `chunking.detect`."""
    asked = resolve_strategy(config)
    none = F.lit(None).cast("string")

    def by_size(rows, name="size"):
        made = chunking.chunk_blocks(rows, max_tokens, target_chars, overlap, "rows" if name == "rows" else "size", count)
        return made.select("doc_id", "chunk_index", "content", "section", none.alias("path"), F.lit(name).alias("strategy"))

    if asked.name == tables.STRATEGY:
        lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text")).filter(F.col("text").rlike(r"\S")).select("*", F.lit("paragraph").alias("block_type"), none.alias("section"))
        return tables.chunk_tables(lines, asked.table, max_tokens, target_chars, overlap, count).select("doc_id", "chunk_index", "content", "section", none.alias("path"), F.lit(tables.STRATEGY).alias("strategy"))
    if asked.name == "semantic":
        raise ValueError("semantic joining needs vectors: chunk by size, embed, then chunk_semantic")
    if asked.name != "hierarchical":
        return by_size(paragraphs(docs), asked.name)
    marked = paragraphs(docs, asked.spine)
    judged = characters(chunking.detect(marked, asked.spine, asked.citation, **thresholds), overrides).select("doc_id", "character")
    referring = judged.filter(F.col("character") == CHARACTERS[0]).select("doc_id")
    numbered = hierarchy.chunk_hierarchy(marked.join(referring, "doc_id", "left_semi"), asked.scheme, max_tokens, target_chars, count)
    return numbered.select("doc_id", "chunk_index", "content", "section", "path", F.lit("hierarchical").alias("strategy")).unionByName(by_size(paragraphs(docs.join(referring, "doc_id", "left_anti"))))
