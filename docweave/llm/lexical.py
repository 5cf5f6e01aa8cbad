"""Ranked lexical search: compressed postings per shard, document-at-a-time merge, one result heap a query.

Method. Tasks cut their documents into shards of SHARD_BYTES of text. A shard's documents are numbered in doc_id
order, and each of its terms has one posting list: the numbers' differences and the frequencies as variable-length
bytes, ascending. Searches join a block of queries' terms to the postings, deal shards over tasks, and merge a
shard's cursors by a k-way heap, so that one document after another is complete and is scored for all queries of
the block at once. Per block of queries a task keeps one bounded heap a query, keyed by score and then by doc_id,
over all its shards; Spark merges the tasks' heaps.

Scores are 64-bit integers: a term of weight w = floor(1000 ln((2N+2)/(2df+1))) that a document of n terms holds tf
times gives w * (10^9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L, for each time the query has the term.

Scale. The index is written to the shared folder, once, by the tasks that read the documents: no shuffle. A search
reads the lists of its own terms only; lists meet terms on (term, salt), so that a term in every shard is
spread. Queries are dealt to blocks by a hash, about BLOCK_TERMS terms in each, so that a block's table (terms by
queries) is bounded however many queries there are. A task holds one shard's lists at a time. What reaches the last
merge is `limit` rows per query and task at most. The index's tables are deleted by `Index.drop`.

Edge cases: a null or empty text, or one without a term, is no document of N and is never found; rows that repeat
an id are documents of their own, each with its rank; null ids sort last; a query without terms, or with terms
that no document holds, has no rows; a query id that is repeated is one query with all its terms; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from heapq import heapify, heappop, heappush, heappushpop, heapreplace
from itertools import count

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docweave.llm import common

#: Bytes of text in a shard, and terms that the queries of one block have in all, about.
SHARD_BYTES, BLOCK_TERMS = 12_000_000, 20_000
SALTS = 16
INDEX = "shard bigint, term string, n_docs bigint, n_terms bigint, postings binary, ids array<bigint>, lengths array<bigint>"
#: Bytes of terms as they are, A-Z as a-z, all others as a space.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as seven bits a byte, low bits first, the top bit on all but a number's last byte;
    and the place after each number's last byte."""
    v = values.astype(np.uint64)
    width = np.ones(len(v), dtype=np.int64)
    for k in range(7, 63, 7):
        width += v >= np.uint64(1 << k)
    ends = np.cumsum(width)
    nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - width, width)
    out = (np.repeat(v, width) >> (nth * 7).astype(np.uint64) & np.uint64(0x7F)).astype(np.uint8)
    out[nth < np.repeat(width, width) - 1] |= 0x80
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    last = b < 0x80
    if last.all():
        return b.astype(np.int64)
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    nth = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 0x7F).astype(np.int64) << (7 * nth), starts) if len(starts) else np.zeros(0, np.int64)


class _Shard:
    """Documents of one shard as they come: terms get numbers, texts are forgotten."""

    def __init__(self):
        self.known: dict[bytes, int] = defaultdict(count().__next__)
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        self.size += len(text)
        tf = Counter(terms_of(text))
        if tf:
            self.docs.append((doc_id, np.fromiter(map(self.known.__getitem__, tf), np.int64, len(tf)), np.fromiter(tf.values(), np.int64, len(tf))))

    def batch(self, number: int):
        """The shard's rows: its documents (term null) and a list a term."""
        import pyarrow as pa

        self.docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
        each = np.array([len(d[1]) for d in self.docs])
        term, tf = (np.concatenate([d[k] for d in self.docs]) for k in (1, 2))
        doc = np.repeat(np.arange(len(each)), each)
        order = np.argsort(term * len(each) + doc)
        term, doc, tf = term[order], doc[order], tf[order]
        new = np.ones(len(term), dtype=bool)
        new[1:] = term[1:] != term[:-1]
        step = np.where(new, doc, doc - np.concatenate([[0], doc[:-1]]))
        pairs, ends = packed(np.stack([step, tf], axis=1).ravel())
        heads = np.flatnonzero(new)
        stops = np.append(heads[1:], len(term))
        bounds = np.concatenate([[0], ends[2 * stops - 1]])
        lists = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(pairs)])
        names = pa.array(list(self.known), pa.binary()).cast(pa.string())
        lengths = [int(d[2].sum()) for d in self.docs]
        n, none = len(heads), pa.nulls(len(heads), pa.list_(pa.int64()))
        first = [[number], [None], [len(each)], [sum(lengths)], [None], [[d[0] for d in self.docs]], [lengths]]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = ["shard", "term", "n_docs", "n_terms", "postings", "ids", "lengths"]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(first, kinds)], names=columns)
        rest = [pa.array(np.full(n, number), pa.int64()), names, pa.array(stops - heads, pa.int64()), pa.array(np.add.reduceat(tf, heads), pa.int64()), lists, none, none]
        for a in range(0, n, 2000):
            yield pa.RecordBatch.from_arrays([x[a : a + 2000] for x in rest], names=columns)


class Index:
    """The stored postings of a table of documents."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES):
        common.small_batches(docs.sparkSession)

        def work(batches):
            shard, number = _Shard(), TaskContext.get().partitionId() << 24
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), common.texts_as_bytes(batch.column(1))):
                    shard.add(doc_id, text)
                    if shard.size >= shard_bytes:
                        if shard.docs:
                            yield from shard.batch(number)
                        shard, number = _Shard(), number + 1
            if shard.docs:
                yield from shard.batch(number)

        rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.shelf = common.Shelf(docs.sparkSession)
        self.table = self.shelf.put(rows.mapInArrow(common.tidied(work), INDEX))

    def drop(self) -> None:
        self.shelf.drop(self.table)

    def weighed(self, terms: DataFrame) -> DataFrame:
        """term, df, w: for the distinct terms of `terms` that the index holds."""
        whole = self.table.filter("term IS NULL").agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"))
        df = self.table.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
        share = (2 * F.col("n") + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
        return df.join(F.broadcast(whole)).select("term", "df", F.floor(1000 * F.log(share)).cast("bigint").alias("w"))

    def search(self, queries: DataFrame, limit: int, query_col: str = "query_id", text_col: str = "text", tasks: int | None = None) -> DataFrame:
        """query_id, rank, doc_id, score: each query's best documents, equal scores by doc_id."""
        spark = self.table.sparkSession
        kind = dict(queries.dtypes)[query_col]
        terms = query_terms(queries, query_col, text_col)
        #: Blocks by the queries' hash; their number follows from what all queries hold (one number on the driver).
        blocks = 1 + (terms.count() // BLOCK_TERMS)
        asked = terms.join(self.weighed(terms), "term").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        sides = asked.groupBy("block", "term").agg(F.max("w").alias("w"), F.collect_list(F.struct("query_id", "times")).alias("queries"))
        salted = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        lists = self.table.filter("term IS NOT NULL").select("shard", "term", "postings", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int").alias("salt"))
        hits = lists.join(salted, ["term", "salt"]).select("block", "shard", F.lit(1).alias("part"), "term", "w", "postings", "queries", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("array<bigint>").alias("lengths"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("l"))
        whole = self.table.filter("term IS NULL").agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l"))
        tables = self.table.filter("term IS NULL").select("shard", "ids", "lengths").join(F.broadcast(whole)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        tables = tables.select("block", "shard", F.lit(0).alias("part"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("bigint").alias("w"), F.lit(None).cast("binary").alias("postings"), F.lit(None).cast(hits.schema["queries"].dataType).alias("queries"), "ids", "lengths", "n", "l")
        parts = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = tables.unionByName(hits).repartition(parts, "shard").sortWithinPartitions("block", "shard", "part", "term")
        shape = StructType.fromDDL(f"query_id {kind}, doc_id bigint, score bigint")
        schema = to_arrow_schema(shape)
        found = dealt.mapInArrow(common.tidied(lambda batches: _searched(batches, limit, schema)), shape)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "score")


def query_terms(queries: DataFrame, query_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """query_id, term, times."""
    kind = dict(queries.dtypes)[query_col]

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(q, t, n) for q, text in zip(batch.column(0).to_pylist(), common.texts_as_bytes(batch.column(1))) for t, n in Counter(terms_of(text)).items()]
            q, t, n = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, batch.column(0).type), pa.array(t, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["query_id", "term", "times"])

    cut = queries.select(F.col(query_col).alias("query_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, f"query_id {kind}, term string, times bigint")
    return cut.groupBy("query_id", "term").agg(F.sum("times").alias("times"))


class _Heaps:
    """The best `limit` documents of each query: worst first, by score and then by descending doc_id (null last)."""

    def __init__(self, limit: int):
        self.limit, self.held, self.at = limit, [], {}
        self.floor = np.zeros(0, dtype=np.int64)

    def number(self, query) -> int:
        if query not in self.at:
            self.at[query] = len(self.held)
            self.held.append([])
        return self.at[query]

    def grow(self) -> None:
        self.floor = np.concatenate([self.floor, np.ones(len(self.held) - len(self.floor), dtype=np.int64)])

    def offer(self, scores: np.ndarray, doc_id: int | None) -> None:
        key = (0, -doc_id) if doc_id is not None else (-1, 0)
        for q in np.flatnonzero(scores >= self.floor).tolist():
            heap, item = self.held[q], (int(scores[q]), key)
            if len(heap) < self.limit:
                heappush(heap, item)
            else:
                heappushpop(heap, item)
            if len(heap) == self.limit:
                self.floor[q] = heap[0][0]

    def rows(self):
        for query, q in self.at.items():
            for score, (known, negative) in self.held[q]:
                yield query, None if known else -negative, score


def merged(cursors: list[tuple[list, list]]):
    """Document after document (number, cursors that hold it, frequencies there), by a k-way heap of cursors."""
    k = len(cursors)
    where = [1] * k
    heap = [numbers[0] * k + c for c, (numbers, _) in enumerate(cursors)]
    heapify(heap)
    doc, holds, times = -1, [], []
    while heap:
        top = heap[0]
        d, c = divmod(top, k)
        if d != doc:
            if holds:
                yield doc, holds, times
            doc, holds, times = d, [], []
        numbers, tfs = cursors[c]
        at = where[c]
        holds.append(c)
        times.append(tfs[at - 1])
        if at < len(numbers):
            where[c] = at + 1
            heapreplace(heap, numbers[at] * k + c)
        else:
            heappop(heap)
    if holds:
        yield doc, holds, times


def _score(rows: list[dict], table: dict, heaps: _Heaps) -> None:
    """One shard's lists for one block of queries."""
    for r in rows:
        r["at"] = [heaps.number(x["query_id"]) for x in r["queries"]]
    heaps.grow()
    times = np.zeros((len(rows), len(heaps.held)), dtype=np.int64)
    for k, r in enumerate(rows):
        times[k, r["at"]] = [x["times"] for x in r["queries"]]
    weight = np.array([r["w"] for r in rows], dtype=np.int64)
    #: Sums below 2^53 are exact as doubles, whose products are fast; longer queries stay integers.
    if int((times * weight[:, None]).sum(0).max()) * 1_000_000 < 2**53:
        times = times.astype(np.float64)
    n, total = table["n"], table["l"]
    m = [75 + 25 * length * n // total for length in table["lengths"]]
    cursors = []
    for r in rows:
        pairs = unpacked(r["postings"]).reshape(-1, 2)
        cursors.append((np.cumsum(pairs[:, 0]).tolist(), pairs[:, 1].tolist()))
    for doc, holds, tfs in merged(cursors):
        tf, at = np.array(tfs, dtype=np.int64), np.array(holds)
        heaps.offer((weight[at] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))) @ times[at], table["ids"][doc])


def _searched(batches, limit: int, schema):
    """The bounded heaps of each block over the shards of one task: rows come by block, shard, table, term."""
    import pyarrow as pa

    block, table, held, heaps = None, None, [], None

    def out():
        rows = list(heaps.rows())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] == 0:
                if held:
                    _score(held, table, heaps)
                if row["block"] != block:
                    if heaps is not None:
                        yield out()
                    block, heaps = row["block"], _Heaps(limit)
                table, held = row, []
            else:
                held.append(row)
    if held:
        _score(held, table, heaps)
    if heaps is not None:
        yield out()


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Index(common.table(spark, sf_dir, "documents"))
    items = common.table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    return index.search(items, 20).withColumnRenamed("query_id", "item_id")
