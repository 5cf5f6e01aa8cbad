"""Incremental ingest: a listing of files against a ledger of what was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scan(listing: DataFrame, ledger: DataFrame, cap: int = 500) -> DataFrame:
    """listing: path, size, mtime, sha256; ledger: path, size, mtime, sha256, status.

    One row per path with its action: unchanged, register, duplicate, deferred (over the cap), missing.
    A file is unchanged if its size is equal, its time within a microsecond, and it has not failed."""
    hidden = F.element_at(F.split("path", "/"), -1).rlike(r"^(\.|~\$)")
    seen = ledger.select("path", F.col("size").alias("l_size"), F.col("mtime").alias("l_mtime"), F.col("status").alias("l_status"))
    both = listing.filter(~hidden).join(seen, "path", "full_outer")
    same = (F.col("size") == F.col("l_size")) & (F.abs(F.col("mtime") - F.col("l_mtime")) < 1e-6) & (F.col("l_status") != "failed")
    known = ledger.filter("status = 'registered'").select("sha256").distinct().withColumn("known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("sha256", "fresh").orderBy("path")) == 1
    marked = both.withColumn("fresh", F.col("size").isNotNull() & ~F.coalesce(same, F.lit(False))).join(known, "sha256", "left")
    new = marked.withColumn("candidate", F.col("fresh") & first & F.col("known").isNull())
    #: The first `cap` paths by a distributed top-k, not by a window over all candidates.
    taken = new.filter("candidate").select("path").orderBy("path").limit(cap).withColumn("taken", F.lit(True))
    return new.join(taken, "path", "left").select(
        "path",
        "sha256",
        F.when(F.col("size").isNull(), "missing").when(~F.col("fresh"), "unchanged").when(F.col("taken"), "register").when(F.col("candidate"), "deferred").otherwise("duplicate").alias("action"),
    )


def roll_up(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count("*").alias("files"), F.max("scanned_at").alias("last_scan"))
