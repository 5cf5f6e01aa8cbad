"""Conversations and memories: last-N windows, fold selection, newest-first budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_turns(messages: DataFrame, n: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The newest n messages of each conversation, in reading order by the reader's sort."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return messages.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n).drop("back")


def fold_selection(messages: DataFrame, through: DataFrame, window: int, least: int = 4, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages to fold into the summary: after `through`, all but the newest `window`, only if at least `least`."""
    rows = messages.join(through, by, "left").filter(F.col("summary_through").isNull() | (F.col(order) > F.col("summary_through")))
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    old = rows.withColumn("back", back).filter(F.col("back") > window)
    return old.withColumn("n", F.count("*").over(Window.partitionBy(by))).filter(F.col("n") >= least).drop("back", "n", "summary_through")


def newest_within(rows: DataFrame, chars: int, by: str, order: str, text: str) -> DataFrame:
    """Newest first until the first one that overflows the budget; the rest stays out."""
    w = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.length(text)).over(w)).filter(F.col("used") <= chars)


def latest_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Last write wins."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("n = 1").drop("n")


def persist_turns(messages: DataFrame, conversations: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """messages: conv_id, seq, role, content, model; conversations: conv_id, updated_at; turns: conv_id, at, question,
    answer, model. The messages with each turn's question and, right after it, its answer; and the conversations, those
    with a turn moved to the last one's time. Turns of unknown conversations are left out."""
    known = turns.join(conversations.select("conv_id"), "conv_id", "left_semi")
    last = messages.groupBy("conv_id").agg(F.max("seq").alias("last"))
    placed = known.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("at"))).join(last, "conv_id", "left")
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast("string").alias("model"), F.lit(1).alias("k")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.col("model"), F.lit(2).alias("k")))
    new = placed.withColumn("x", F.explode(pair)).select("conv_id", (F.coalesce("last", F.lit(0)) + 2 * (F.col("n") - 1) + F.col("x.k")).cast(dict(messages.dtypes)["seq"]).alias("seq"), "x.role", "x.content", "x.model")
    moved = known.groupBy("conv_id").agg(F.max("at").alias("moved"))
    touched = conversations.join(moved, "conv_id", "left").withColumn("updated_at", F.greatest("updated_at", "moved")).drop("moved")
    return messages.select("conv_id", "seq", "role", "content", "model").unionByName(new), touched
