"""Streams: files of a watched folder into a ledger, late events by watermark, rolling summaries with state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch_folder(spark: SparkSession, folder: str, ledger_path: str, checkpoint: str, register: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Ingests what is new in a folder and stops: each file is seen once across runs.

    The ledger is a Parquet table, one part per batch; a batch that is run again replaces its own part. Of
    new files, those whose content the ledger has, or that repeat in the batch, are duplicates."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.*").option("recursiveFileLookup", "true").load(folder)

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        name = F.element_at(F.split("path", "/"), -1)
        new = batch.filter(~name.rlike(r"^(\.|~\$)")).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))
        first = new.groupBy("sha256").agg(F.min("path").alias("first"))
        rows = new.join(first, "sha256")
        jvm_path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger_path)
        if jvm_path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
            known = session.read.parquet(ledger_path).filter(F.col("batch") != number).filter("status = 'registered'").select("sha256").distinct().withColumn("known", F.lit(True))
            rows = rows.join(known, "sha256", "left")
        else:
            rows = rows.withColumn("known", F.lit(None).cast("boolean"))
        status = F.when(F.col("known") | (F.col("path") != F.col("first")), "duplicate").otherwise("registered")
        done = rows.select("path", "size", "mtime", "sha256", F.coalesce(status, F.lit("registered")).alias("status"))
        done.write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")
        if register is not None:
            register(session.read.parquet(f"{ledger_path}/batch={number}").filter("status = 'registered'"))

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "1 hour", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts per key and window; events later than `late` behind the newest are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def rolling_summaries(messages: DataFrame, window: int = 8, least: int = 4, summarise: Callable[[str, list[str]], str] | None = None) -> DataFrame:
    """messages: conv_id, turn, text (a stream). Folds all but the newest `window` turns into a summary once at
    least `least` wait; the state of a conversation is its summary and the waiting turns (a bounded few)."""
    fold = summarise or (lambda old, texts: (old + " " + " ".join(t[:20] for t in texts)).strip())

    def work(key, frames, state: GroupState):
        import pandas as pd

        summary, through, turns = state.get if state.exists else ("", -1, "[]")
        import json

        held = {int(k): v for k, v in json.loads(turns)}
        for pdf in frames:
            held.update({int(t): x for t, x in zip(pdf["turn"], pdf["text"]) if int(t) > through})
        order = sorted(held)
        old = order[: max(0, len(order) - window)]
        if len(old) >= least:
            summary = fold(summary, [held[t] for t in old])
            through = old[-1]
            held = {t: held[t] for t in order if t > through}
        state.update((summary, through, json.dumps(sorted(held.items()))))
        yield pd.DataFrame({"conv_id": [key[0]], "summary": [summary], "summary_through": [through], "waiting": [len(held)]})

    return messages.groupBy("conv_id").applyInPandasWithState(work, "conv_id bigint, summary string, summary_through bigint, waiting int", "summary string, through bigint, turns string", "update", GroupStateTimeout.NoTimeout)
