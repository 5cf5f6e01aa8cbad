"""Listings and totals of the catalogue: documents with owners and counts, quotas, usage, versions, tools, projects.

Each operator aggregates the larger side by its key before the join, so that a row of the listing meets one row of
counts. A row without partner stays, with zero or null; null keys have no partner."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_counts(rows: DataFrame, key: str, **others: DataFrame) -> DataFrame:
    """rows, and a column per name: how many rows of that DataFrame (column `key`) have the row's key."""
    for name, other in others.items():
        rows = rows.join(other.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    return rows


def document_list(docs: DataFrame, collections: DataFrame, owners: DataFrame, chunks: DataFrame) -> DataFrame:
    """docs: doc_id, collection_id; collections: collection_id, collection, owner_id; owners: owner_id, owner; chunks: doc_id.

    doc_id, collection, owner, chunks. A document's collection and owner must exist; it may have no chunk."""
    return with_counts(docs.join(collections, "collection_id").join(owners, "owner_id"), "doc_id", chunks=chunks).select("doc_id", "collection", "owner", "chunks")


def folder_counts(folders: DataFrame, docs: DataFrame) -> DataFrame:
    """folders: id, parent_id, name; docs: folder_id. id, name, children, documents: what lies in a folder itself."""
    children, inside = folders.select(F.col("parent_id").alias("id")), docs.select(F.col("folder_id").alias("id"))
    return with_counts(folders.select("id", "name"), "id", children=children, documents=inside)


def in_folders(docs: DataFrame, paths: Iterable[str]) -> DataFrame:
    """docs: folder (path `/a/b/`). Documents in one of the folders or below; no path finds nothing."""
    hit = F.lit(False)
    for p in paths:
        hit = hit | F.startswith(F.col("folder"), F.lit(p.rstrip("/") + "/"))
    return docs.filter(hit)


def bulk_verdicts(rows: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    """rows, and verdict: `failed: <reason>` of the first check that refuses the row, else `done`. A null check does not refuse."""
    verdict = F.lit("done")
    for refused, reason in reversed(checks):
        verdict = F.when(refused, f"failed: {reason}").otherwise(verdict)
    return rows.withColumn("verdict", verdict)


def version_list(versions: DataFrame, authors: DataFrame) -> DataFrame:
    """versions: lineage_id, version, status, author_id; authors: author_id, author. An unknown author is null."""
    return versions.join(authors, "author_id", "left").select("lineage_id", "version", "status", "author")


def quotas(owners: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """owners: owner_id; files: owner_id, size. owner_id, files, used, over: whether more than `limit` is used."""
    sums = files.groupBy("owner_id").agg(F.count("*").alias("files"), F.sum("size").alias("used"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return owners.select("owner_id").join(sums, "owner_id", "left").select("owner_id", zero("files").alias("files"), zero("used").alias("used")).withColumn("over", F.col("used") > limit)


def token_usage(sources: Iterable[DataFrame]) -> DataFrame:
    """sources: user_id, tokens each. user_id, tokens, calls over all of them; a call without tokens counts none."""
    first, *rest = [s.select("user_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")) for s in sources]
    for s in rest:
        first = first.unionByName(s)
    return first.groupBy("user_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))


def attachments(conversations: DataFrame, files: DataFrame) -> DataFrame:
    """conversations: conv_id (repeats allowed); files: conv_id. The files of conversations that exist."""
    return files.join(conversations.select("conv_id"), "conv_id", "left_semi")


def trace_utilization(traces: DataFrame, digits: int = 6) -> DataFrame:
    """traces: conv_id, delivered, cited (booleans). Per conversation the counts, the share that is cited (null without any
    delivered), and nothing_cited."""
    t = traces.groupBy("conv_id").agg(F.count_if("delivered").alias("delivered"), F.count_if("cited").alias("cited"))
    share = F.when(F.col("delivered") > 0, F.col("cited") / F.col("delivered"))
    return t.withColumn("utilization", F.round(share, digits)).withColumn("nothing_cited", (F.col("delivered") > 0) & (F.col("cited") == 0))


def prompt_versions(prompts: DataFrame, authors: DataFrame) -> DataFrame:
    """prompts: name, version, author_id; authors: author_id, author. Per name: versions, latest, next, the latest's author."""
    last = prompts.groupBy("name").agg(F.max(F.struct("version", "author_id")).alias("m"), F.count("*").alias("versions"))
    flat = last.select("name", "versions", F.col("m.version").alias("latest"), (F.col("m.version") + 1).alias("next"), F.col("m.author_id").alias("author_id"))
    return flat.join(authors, "author_id", "left").select("name", "versions", "latest", "next", "author")


def projects(runs: DataFrame, ended: list[str]) -> DataFrame:
    """runs: project_id, status, day. Per project: runs, last_run, active (runs whose status is known and not in `ended`)."""
    return runs.groupBy("project_id").agg(F.count("*").alias("runs"), F.max("day").alias("last_run"), F.count_if(~F.col("status").isin(ended)).alias("active"))


def servers(rows: DataFrame, owners: DataFrame, nobody: str = "-") -> DataFrame:
    """rows: server_id, name, owner_id; owners: owner_id, owner. A server whose owner is unknown stays, under `nobody`."""
    return rows.join(owners, "owner_id", "left").select("server_id", "name", F.coalesce("owner", F.lit(nobody)).alias("owner"))


def leading(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in order, with their place and whether they are the group's default."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("n") <= n).withColumn("is_default", F.col("n") == 1)


def unused(collections: DataFrame, uses: DataFrame) -> DataFrame:
    """collections: collection_id; uses: collection_id. Collections that no use names."""
    return collections.join(uses.select("collection_id"), "collection_id", "left_anti")


def counts_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows each combination of values has; nulls are a value."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def duplicate_files(files: DataFrame) -> DataFrame:
    """files: doc_id, scope, content. Contents that a scope holds more than once: sha256, scope, first_id, copies. Missing contents are copies of
    each other, under a null sha256."""
    h = files.select("doc_id", "scope", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    return h.groupBy("sha256", "scope").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")


def attachment_texts(parts: DataFrame) -> DataFrame:
    """parts: conv_id, place, text. A conversation's texts in order of place, joined by line breaks; blank ones are left out."""
    ordered = F.sort_array(F.collect_list(F.struct("place", "text")))
    return parts.filter("length(trim(text)) > 0").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text")).withColumn("score", F.lit(None).cast("double"))


def discovered(known: DataFrame, listed: DataFrame, unset: str = "unset") -> DataFrame:
    """known: tool_id, risk (as set by hand); listed: tool_id, title (what the server tells now; title may be null).

    A vanished tool is disabled and keeps its risk; a new one is enabled with risk `unset`."""
    both = known.select("tool_id", "risk").join(listed.select("tool_id", "title", F.lit(True).alias("__there")), "tool_id", "full_outer")
    return both.select("tool_id", F.coalesce("risk", F.lit(unset)).alias("risk"), "title", F.coalesce("__there", F.lit(False)).alias("enabled"))


def available_tools(tools: DataFrame, servers: DataFrame, groups: DataFrame) -> DataFrame:
    """tools: tool_id, server_id, enabled; servers: server_id, server, group_id; groups: group_id, grp, allowed. Enabled tools of allowed groups."""
    return tools.filter("enabled").join(servers, "server_id").join(groups.filter("allowed"), "group_id").select("tool_id", "server", "grp")


def gold_addresses(gold: DataFrame) -> DataFrame:
    """gold: query_id, doc_id, chunk_index. query_id, address (`doc#chunk`), each once; a row without either part has no address."""
    return gold.select("query_id", F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("chunk_index").cast("string")).alias("address")).filter("address IS NOT NULL").distinct()
