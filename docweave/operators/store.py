"""A collection as stored tables: documents go in, chunks with vectors and citation edges stand there afterwards.

Chunks and edges are keyed tables (`sources/keyed_table.py`) in buckets of the document's id. Indexing documents
replaces all their chunks and edges, so that a second run changes nothing and a document that has no text any more
has no rows; other documents' buckets are not touched. What stays unresolved is resolved again by `relink`, once
the documents that it cites have come. Every step is one Spark job over the documents given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.text import document_title
from docweave.operators import citations, edges, ingest, providers
from docweave.operators.chunking import chunk_semantic
from docweave.sources.keyed_table import KeyedTable
from docweave.sources.storage import stored

CHUNKS = "doc_id bigint, chunk_id string, chunk_index int, content string, section string, path string, strategy string, filename string, embedding array<double>"
EDGES = "doc_id bigint, src string, kind string, target string, label string, dst string"


class Collection:
    """chunks: CHUNKS; edges: EDGES, for a hierarchical collection."""

    def __init__(self, spark: SparkSession, path: str, config: dict | None = None):
        self.spark, self.config, self.asked = spark, config, ingest.resolve_strategy(config)
        self.chunks = self._table(f"{path}/chunks", CHUNKS, ["doc_id", "chunk_id"])
        self.edges = self._table(f"{path}/edges", EDGES, ["doc_id", "src", "kind", "target"])

    def _table(self, path: str, shape: str, key: list[str]) -> KeyedTable:
        table = KeyedTable(self.spark, path)
        return table if table.versions() else KeyedTable.create(self.spark.createDataFrame([], shape), path, key, ["doc_id"])

    def index(self, docs: DataFrame, provider: providers.Embed, width: int, **options) -> None:
        """docs: doc_id (unique), filename, text. options: of `ingest.chunk_documents`; with the semantic strategy
        chunks are cut by size, joined by their vectors, and those that were joined are embedded anew."""
        semantic = self.asked.name == "semantic"
        cut = ingest.chunk_documents(docs, {"strategy": "size"} if semantic else self.config, **options)
        if semantic:
            first = stored(cut.withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index")))
            joined = chunk_semantic(first.join(providers.embed_table(first, provider, width), "chunk_id"))
            heads = first.select("doc_id", F.col("chunk_index").alias("at"), "section")
            before = F.sum("joined").over(Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1))
            cut = joined.withColumn("at", F.coalesce(before, F.lit(0)).cast("int")).join(heads, ["doc_id", "at"]).select("doc_id", "chunk_index", "content", "section", F.lit(None).cast("string").alias("path"), F.lit("semantic").alias("strategy"))
        named = cut.withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index")).join(docs.select("doc_id", "filename"), "doc_id")
        made = stored(named)
        rows = stored(made.join(providers.embed_table(made, provider, width), "chunk_id").select(*[F.col(f.name).cast(f.dataType) for f in self.chunks.read().schema]))
        self._replace(self.chunks, rows, docs)
        if self.asked.scheme is not None:
            found = edges.build_edges(rows, docs.select("doc_id", "filename"), self.asked.scheme)
            self._replace(self.edges, stored(found.select("doc_id", "src", "kind", "target", "label", "dst").dropDuplicates(["doc_id", "src", "kind", "target"])), docs)

    def remove(self, docs: DataFrame) -> None:
        """Takes documents (doc_id) out."""
        self.chunks.delete_groups(docs.select("doc_id"))
        self.edges.delete_groups(docs.select("doc_id"))

    def relink(self) -> None:
        """Resolves citations of other documents that have come since; rewrites the documents whose edges were open."""
        rows = self.chunks.read()
        every = self.edges.read()
        open_ = every.filter("dst IS NULL").select("doc_id").distinct()
        titles = rows.select("doc_id", "filename").distinct().select("doc_id", document_title(F.col("filename")).alias("title"))
        linked = citations.relink(every.join(open_, "doc_id", "left_semi"), citations.path_index(rows), titles)
        self.edges.replace_groups(stored(linked.select(*every.columns)))

    @staticmethod
    def _replace(table: KeyedTable, rows: DataFrame, docs: DataFrame) -> None:
        """Documents without a row lose theirs too."""
        gone = docs.select("doc_id").join(rows.select("doc_id"), "doc_id", "left_anti")
        table.replace_groups(rows)
        table.delete_groups(gone)
