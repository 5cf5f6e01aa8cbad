"""Benchmark decontamination by spaced seeds.

Method. Fixed masks pick some of the positions of a word window and ignore the others; the picked words'
hashes give one seed per mask and position. Seeds of the benchmark items are joined in Spark with those of the
documents, and around each hit the document and the item are aligned on the hit's diagonal: the best segment in
which at least MATCH_SHARE of the words agree decides, if it has `enough` agreeing words.

What is found. LONG masks (items of SHORT_ITEM words and more) pick five words of up to eleven, SHORT masks
(items of 5 to SHORT_ITEM - 1) four of five: whichever fifth of an item's words is replaced, at least one mask
fits on words that all agree (the tests enumerate this). An item counts as found from `enough` agreeing words on:
LONG_SHARE of a longer item's words, ENOUGH at most. With just so many, at random places, a mask fits in nine of ten cases
and more at every length; with more, or in longer items, in nearly all (the tests measure this). Items of one to four words are sought as they are.
A one-word item sends each place of its word into the join, so its cost grows with that word's occurrences.

Scale. Both sides' seeds are made in Spark tasks. The benchmark's seeds set PROBES bits each of one bitmap (1,024
bits a seed, 8 MB at most; past that more documents pass it, and the join decides), which is broadcast: only
documents with a seed in it go on, with the seeds that hit. These meet the benchmark's seeds in a join on the seed, dealt over
SALTS keys each, so that a phrase of many documents does not meet in one task. Of each document that shares a
seed its words' hashes travel once to the verification. The benchmark is never collected.

Edge cases: null, empty or wordless texts (documents or items) have no hits; repeated items or documents each
give their own rows; of equally good segments the first wins; long texts are searched whole; extra columns are not read
(findings) or pass through unchanged (clean_documents, which drops every row whose text holds an item, a null
id or a repeated id included); an empty benchmark finds nothing.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import common

#: Picked positions are 1.
LONG = ("11111", "1101011", "1100010011", "10100111", "1101000101", "11010000101")
SHORT = ("1111", "10111", "11011", "11101")
WHOLE = ("1", "11", "111", "1111")
MASKS = (*LONG, *SHORT, *WHOLE)
SHORT_ITEM = 13
#: Share of agreeing words: of a segment; of longer items; of short items.
MATCH_SHARE, LONG_SHARE, SHORT_SHARE = 0.6, 0.65, 0.8
#: Words of a longer item that must agree at most.
ENOUGH = 12
SALTS = 8
PROBES = 3
_PROBE = common.mix(np.arange(8101, 8101 + PROBES, dtype=np.uint64)) | np.uint64(1)

SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "item_id", "start_word", "n_words", "n_matched")])
_FACTORS = common.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def masks_for(n_words: int) -> range:
    """Numbers of the masks by which an item is sought."""
    if n_words >= SHORT_ITEM:
        return range(len(LONG))
    if n_words >= 5:
        return range(len(LONG), len(LONG) + len(SHORT))
    return range(at := len(LONG) + len(SHORT) + n_words - 1, at + (n_words > 0))


def enough(n_words: int) -> int:
    """Words that must agree."""
    if n_words < 5:
        return n_words
    return math.ceil(SHORT_SHARE * n_words) if n_words < SHORT_ITEM else min(ENOUGH, math.ceil(LONG_SHARE * n_words))


def seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """One per position; words: hashes."""
    picked = [k for k, x in enumerate(MASKS[mask]) if x == "1"]
    n = len(words) - len(MASKS[mask]) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, np.uint64(mask + 1), dtype=np.uint64)
    for k, at in enumerate(picked):
        total += words[at : at + n] * _FACTORS[k]
    return common.mix(total)


def best_segment(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Start in words, length and agreeing words of the best segment on a diagonal."""
    a, b = max(0, -shift), min(len(item), len(words) - shift)
    same = words[shift + a : shift + b] == item[a:b]
    run = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - MATCH_SHARE, -MATCH_SHARE))])
    end = int(np.argmax(run - np.minimum.accumulate(run)))
    begin = int(np.argmin(run[: end + 1]))
    return shift + a + begin, end - begin, int(same[begin:end].sum())


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number of the row), item_id, words (hashes), and its seeds with their positions."""
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches):
        import pyarrow as pa

        hashes, item = common.WordHashes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            words = [hashes(t.lower().split()) for t in common.texts_as_bytes(batch.column(1))]
            found = [[(seeds(w, m), np.arange(max(0, len(w) - len(MASKS[m]) + 1))) for m in masks_for(len(w))] for w in words]
            number = np.arange(item, item + len(words))
            item += len(words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number),
                    batch.column(0),
                    pa.array([w.tobytes() for w in words], pa.binary()),
                    pa.array([np.concatenate([s for s, _ in x]).view(np.int64) if x else [] for x in found], pa.list_(pa.int64())),
                    pa.array([np.concatenate([p for _, p in x]) if x else [] for x in found], pa.list_(pa.int64())),
                ],
                names=["item", "item_id", "words", "seeds", "places"],
            )

    return rows.mapInArrow(common.tidied(work), "item bigint, item_id bigint, words binary, seeds array<bigint>, places array<bigint>")


def _places(seed: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (common.mix(seed * _PROBE[probe]) & np.uint64(bits - 1)).astype(np.int64)


def _bitmap(placed: DataFrame) -> np.ndarray:
    """Bits of the benchmark's seeds (packed, a power of two of them)."""
    bits = 1 << min(26, max(20, (1024 * max(1, placed.count()) - 1).bit_length()))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            seed = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.concatenate([_places(seed, k, bits) for k in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> 15).astype(np.int32)), pa.array(at & 32767)], names=["slot", "at"])

    maps = placed.select("seed").mapInArrow(work, "slot int, at bigint").groupBy("slot").agg(F.expr("bitmap_construct_agg(at)").alias("map"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for slot, part in maps.collect():
        out[slot * 4096 : slot * 4096 + len(part)] = np.frombuffer(part, dtype=np.uint8)
    return out


def _hits(rows: DataFrame, there: np.ndarray, masks: list[int]) -> DataFrame:
    """rows: doc_id, text. Of the documents with a seed in the bitmap: row, doc_id, words, the seeds and their positions."""
    shared = rows.sparkSession.sparkContext.broadcast(there)

    def work(batches):
        import pyarrow as pa

        hashes, there, row = common.WordHashes(), shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            words = [t.lower().split() for t in common.texts_as_bytes(batch.column(1))]
            begin = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
            flat = np.concatenate([hashes(w) for w in words]) if words else np.empty(0, dtype=np.uint64)
            found, at = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
            for m in masks:
                s = seeds(flat, m)
                hit = np.arange(len(s))
                for k in range(PROBES):
                    at_bit = _places(s[hit], k, 8 * len(there))
                    hit = hit[(there[at_bit >> 3] >> (at_bit & 7).astype(np.uint8)) & 1 == 1]
                #: A window lies in one document.
                hit = hit[np.searchsorted(begin, hit, "right") == np.searchsorted(begin, hit + len(MASKS[m]) - 1, "right")]
                found.append(s[hit]), at.append(hit)
            found, at = np.concatenate(found), np.concatenate(at)
            doc = np.searchsorted(begin, at, "right") - 1
            order = np.argsort(doc, kind="stable")
            found, at, doc = found[order], at[order], doc[order]
            some, first = np.unique(doc, return_index=True)
            cut = np.append(first, len(doc))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + some),
                    batch.column(0).take(pa.array(some, pa.int64())),
                    pa.array([flat[begin[d] : begin[d + 1]].tobytes() for d in some], pa.binary()),
                    pa.array([found[a:b].view(np.int64) for a, b in zip(cut, cut[1:])], pa.list_(pa.int64())),
                    pa.array([at[a:b] - begin[d] for d, a, b in zip(some, cut, cut[1:])], pa.list_(pa.int64())),
                ],
                names=["row", "doc_id", "words", "seeds", "places"],
            )
            row += len(words)

    return rows.mapInArrow(common.tidied(work), "row bigint, doc_id bigint, words binary, seeds array<bigint>, places array<bigint>")


def _exploded(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.explode(F.arrays_zip(F.col("seeds").alias("seed"), F.col("places").alias("place"))).alias("x")).select(key, "x.seed", "x.place")


def _found(docs: DataFrame, benchmark: DataFrame, shelf: common.Shelf, id_col, text_col, item_id_col, item_text_col) -> DataFrame:
    """The columns of SCHEMA."""
    spark = docs.sparkSession
    common.small_batches(spark)
    items = shelf.put(_items(benchmark, item_id_col, item_text_col))
    placed = _exploded(items, "item")
    sizes = items.select(F.least(F.length("words") / 8, F.lit(SHORT_ITEM)).cast("int").alias("n")).distinct().collect()
    masks = sorted({m for r in sizes for m in masks_for(r.n)})
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hits = shelf.put(_hits(rows, _bitmap(placed), masks))

    mine = _exploded(hits, "row").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    theirs = placed.select("item", "seed", F.col("place").alias("of_item"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    diagonals = mine.join(theirs, ["seed", "salt"]).select("row", "item", (F.col("place") - F.col("of_item")).alias("shift")).distinct()
    asked = diagonals.groupBy("row", "item").agg(F.sort_array(F.collect_list("shift")).alias("shifts"))
    asked = asked.join(items.select("item", "item_id", F.col("words").alias("of_item")), "item").groupBy("row").agg(F.collect_list(F.struct("item", "item_id", "shifts", "of_item")).alias("asked"))

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc, raw, asked in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = np.frombuffer(raw, dtype=np.uint64)
                for x in sorted(asked, key=lambda x: x["item"]):
                    item = np.frombuffer(x["of_item"], dtype=np.uint64)
                    best = max((best_segment(words, item, s) for s in x["shifts"]), key=lambda b: b[2])
                    if best[2] >= enough(len(item)):
                        out.append((doc, x["item_id"], *best))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out)) or [[]] * 5], names=SCHEMA.names)

    joined = hits.select("row", "doc_id", "words").join(asked, "row").select("doc_id", "words", "asked")
    return joined.mapInArrow(common.tidied(verify), SCHEMA)


def findings(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_id_col="item_id", item_text_col="text") -> DataFrame:
    """One row per document and item found in it, with the place of the best segment (in words)."""
    return _found(docs, benchmark, common.Shelf(docs.sparkSession), id_col, text_col, item_id_col, item_text_col)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col="text", item_id_col="item_id", item_text_col="text") -> DataFrame:
    """The rows whose text has no finding, all columns kept."""
    shelf = common.Shelf(docs.sparkSession)
    #: Texts are told by their bytes, not by ids, which can repeat or be null.
    rows = docs.select(F.xxhash64(text_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = shelf.put(_found(rows, benchmark, shelf, "doc_id", "text", item_id_col, item_text_col).select(F.col("doc_id").alias("__found")).distinct())
    return docs.join(found, F.xxhash64(F.col(text_col).cast("string")) == F.col("__found"), "left_anti").select(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
