"""One turn of a conversation: where its evidence comes from, what its tools gave, what it cost. Many turns at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How a failed and an empty tool call are told in evidence.
FAILED, EMPTY = "[failed] ", "[no result]"


def route(turns: DataFrame) -> DataFrame:
    """turns: booleans attached, picked (tools chosen by hand gave something), graph (a workflow or plan answered),
    chat (small talk), external (an outside tool gave something), table (the built-in lookup did), web, weak (of the
    search's evidence). Null is false. Adds route and clarify.

    Attachments and picked tools are taken along on every route. A workflow's evidence settles the turn; small talk
    is not searched; what an outside tool gave takes the place of a search, what the lookup gave does not; weak
    results of a search give way to the web's. A question back is asked only if nothing at all was found."""
    on = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("attached", "picked", "graph", "chat", "external", "table", "web", "weak")}
    way = F.when(on["graph"], "graph").when(on["chat"], "no search").when(on["external"], "tools").when(on["weak"] & on["web"], "web").otherwise("search")
    return turns.withColumn("route", way).withColumn("clarify", (way == "search") & on["weak"] & ~(on["attached"] | on["picked"] | on["table"]))


def tool_evidence(calls: DataFrame) -> DataFrame:
    """calls: turn_id, at, tool, content, error. Every call becomes evidence, in the order asked for; one that failed or
    came back empty says so."""
    said = F.when(F.col("error").isNotNull(), F.concat(F.lit(FAILED), "error")).when(F.trim(F.coalesce("content", F.lit(""))) == "", EMPTY).otherwise(F.col("content"))
    return calls.select("turn_id", F.row_number().over(Window.partitionBy("turn_id").orderBy("at")).alias("at"), "tool", said.alias("content"))


def substantive(evidence: DataFrame) -> DataFrame:
    """Evidence that is neither a failure nor an empty result."""
    return evidence.filter(~F.col("content").startswith(FAILED) & (F.col("content") != EMPTY))


def select_tools(tools: DataFrame, most: int) -> DataFrame:
    """tools: owner, tool, risk, enabled, at. Each owner's first `most` enabled tools that only read."""
    first = Window.partitionBy("owner").orderBy("at", "tool")
    return tools.filter("enabled AND risk = 'read'").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most)


def node_values(items: DataFrame) -> DataFrame:
    """items: run_id, node, pos, ref, filename, content, score. What later nodes can ask of a node that has run: how many
    items, the first of them (by pos, then ref, filename, content, nulls first), and its text. The items themselves stay rows."""
    entry = F.struct("ref", F.coalesce(F.nullif("filename", F.lit("")), F.col("ref").cast("string")).alias("title"), F.col("content").alias("text"), "score")
    return items.groupBy("run_id", "node").agg(F.count("*").alias("count"), F.min_by(entry, F.struct("pos", "ref", "filename", "content")).alias("top")).select("run_id", "node", "count", "top", F.coalesce("top.text", F.lit("")).alias("text"))


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage: model, tokens_in, tokens_out; prices: model, per_in, per_out of a million. Adds cost; an unknown model costs nothing."""
    price = F.coalesce(F.col("tokens_in"), F.lit(0)) * F.col("per_in") + F.coalesce(F.col("tokens_out"), F.lit(0)) * F.col("per_out")
    return usage.join(prices, "model", "left").withColumn("cost", F.coalesce(price / 1e6, F.lit(0.0))).drop("per_in", "per_out")
