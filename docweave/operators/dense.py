"""Exact cosine search of many queries in one scan, and an inverted-file index for approximate search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions import vectors as vx
from docweave.operators import sparse

#: Bytes of query vectors in one row; of all that are broadcast; and of those that a task holds at a time beyond that.
BLOCK_BYTES, BROADCAST_BYTES, HELD_BYTES = 4_000_000, 64_000_000, 256_000_000


def _top(df: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def top_with_counts(df: DataFrame, limit: int) -> DataFrame:
    """The best rows of each query out of those of all pages, with the sum over pages of what was scored there."""
    in_page = Window.partitionBy("query_id", "page").orderBy(F.desc("score"), "item")
    rows = df.withColumn("n", F.row_number().over(in_page)).withColumn("scored", F.when(F.col("n") == 1, F.col("scored")))
    total = rows.withColumn("scored", F.sum("scored").over(Window.partitionBy("query_id")))
    return _top(total.drop("n", "page"), limit)


def hashed_vectors(post: DataFrame, width: int = 64) -> DataFrame:
    """A deterministic offline embedding of postings (chunk_id, term, tf): a term adds its count at a place and
    with a sign that its MD5 gives. Postings are digested in place; sums are partial before the shuffle."""
    place, sign = vx.hashed_place(F.col("term"), width)
    sums = post.select("chunk_id", place.alias("p"), (F.col("tf") * sign).alias("x")).groupBy("chunk_id", "p").agg(F.sum("x").alias("v"))
    whole = sums.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("m"))
    return whole.select("chunk_id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("embedding"))


def hashed_lists(lists: DataFrame, width: int = 64) -> DataFrame:
    """hashed_vectors of counted chunks (chunk_id, terms, tfs), each made where the chunk is; a batch's distinct terms are
    digested once."""
    kind = dict(lists.dtypes)["chunk_id"]

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            coded = batch.column(1).flatten().dictionary_encode()
            place, sign = _hashed(coded.dictionary)
            term, n = coded.indices.to_numpy(), batch.num_rows
            row = np.repeat(np.arange(n), np.diff(batch.column(1).offsets.to_numpy()))
            x = np.bincount(row * width + place[term] % width, batch.column(2).flatten().to_numpy() * sign[term], n * width) if len(term) else np.zeros(n * width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), x)], names=["chunk_id", "embedding"])

    return lists.select("chunk_id", "terms", "tfs").mapInArrow(work, f"chunk_id {kind}, embedding array<double>")


def hashed_texts(chunks: DataFrame, width: int = 64, tokenizer: str = "bigram", id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """hashed_vectors of the postings of chunks, each made from its text: no posting leaves the task."""

    def tally(ids, names, row, term):
        import pyarrow as pa

        place, sign = _hashed(names)
        x = np.bincount(row * width + place[term] % width, sign[term], len(ids) * width).astype(np.float64)  # of nothing: integers
        return [pa.ListArray.from_arrays(np.arange(0, len(ids) * width + 1, width, dtype=np.int32), x)]

    return sparse.with_terms(chunks, tally, "embedding array<double>", tokenizer, id_col, text_col)


def _hashed(terms) -> tuple[np.ndarray, np.ndarray]:
    """For each term the number that its MD5 begins with, and its sign."""
    import hashlib

    digests = [hashlib.md5(t.encode()).hexdigest() for t in terms.to_pylist()]
    return np.array([int(x[:4], 16) for x in digests], dtype=np.int64), np.array([1.0 if x[4] < "8" else -1.0 for x in digests])


def packed(corpus: DataFrame) -> DataFrame:
    """items, x: each Arrow batch of the corpus (item, embedding) as one row, its vectors end to end. Null vectors are left out."""
    kinds = dict(corpus.dtypes)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = batch.column(1)
                if len(set(np.diff(x.offsets.to_numpy()).tolist())) > 1:
                    raise ValueError("vectors of different widths")
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(v)], v) for v in (batch.column(0), x.flatten())], names=["items", "x"])

    return corpus.select("item", "embedding").filter("embedding IS NOT NULL").mapInArrow(work, f"items array<{kinds['item']}>, x {kinds['embedding']}")


def for_each_block(pages: DataFrame, queries: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """What kernel(page, ids, vectors) returns (a record batch) for every page and every block of queries.

    pages are rows of a bounded size and are computed once, however many queries there are. Queries (query_id,
    embedding) travel as rows of BLOCK_BYTES. Where all blocks together stay under BROADCAST_BYTES they are broadcast
    and meet the pages where these are. Beyond it, pages are dealt over tasks and blocks go to every task, at most
    HELD_BYTES of them in one round; pages are dealt once a round."""
    spark = pages.sparkSession
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL")
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    size = 8 * n * width
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "embedding")).alias("r"))
    rows = rows.select("block", F.col("r.query_id").alias("ids"), F.flatten("r.embedding").alias("q"))
    names = pages.columns

    def block_of(row):
        ids = row["ids"].values
        return ids, row["q"].values.to_numpy().reshape(len(ids), -1)

    if size <= BROADCAST_BYTES:

        def pairs(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(j)[k] for j, c in enumerate(batch.schema.names)}
                    yield kernel(row, *block_of(row))

        return pages.crossJoin(F.broadcast(rows.drop("block"))).mapInArrow(pairs, schema)

    def streamed(batches):
        held, at = [], None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(j)[k] for j, c in enumerate(batch.schema.names)}
                key = (row["round"].as_py(), row["task"].as_py())
                if key != at:
                    held, at = [], key
                if row["ids"].is_valid:
                    held.append(block_of(row))
                else:
                    for ids, q in held:
                        yield kernel(row, ids, q)

    tasks, rounds = int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // HELD_BYTES)
    dealt = pages.withColumn("task", F.pmod(F.xxhash64(names[0]), F.lit(tasks))).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    sent = rows.select((F.col("block") % rounds).cast("int").alias("round"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tasks - 1).cast("bigint"))).alias("task"), "ids", "q")
    both = sent.unionByName(dealt, allowMissingColumns=True).withColumn("page", F.col("ids").isNull())
    return both.repartition(tasks * rounds, "round", "task").sortWithinPartitions("round", "task", "page").mapInArrow(streamed, schema)


def best_of(scores: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Places of a row's best scores, ties by order."""
    some = np.arange(len(scores))
    if len(scores) > limit:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - limit)[len(scores) - limit])
    return some[np.lexsort((order[some], -scores[some]))[:limit]]


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def order_of(items) -> np.ndarray:
    """Ranks of Arrow values among themselves."""
    return np.argsort(np.argsort(np.array(items.to_pylist(), dtype=object), kind="stable"), kind="stable")


def nearest(queries: DataFrame, corpus: DataFrame, limit: int, digits: int = 9) -> DataFrame:
    """query_id, item, score, rank. queries: query_id, embedding; corpus: item, embedding (null: not searched).

    The corpus is read once, as pages; a page is one matrix product with each block of queries, only the page's
    best `limit` per query leave it, and ties are by item before the cut."""

    def kernel(page, ids, q):
        import pyarrow as pa

        items = page["items"].values
        x, order = unit(page["x"].values.to_numpy().astype(np.float64).reshape(len(items), -1)), order_of(items)
        q = unit(q)
        at, scores = [], []
        for k in range(0, len(q), 256):
            for row in np.round(q[k : k + 256] @ x.T, digits):
                at.append(best_of(row, order, limit))
                scores.append(row[at[-1]])
        which = pa.array(np.repeat(np.arange(len(q)), [len(a) for a in at]))
        return pa.RecordBatch.from_arrays([ids.take(which), items.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(scores))], names=["query_id", "item", "score"])

    schema = f"query_id {dict(queries.dtypes)['query_id']}, item {dict(corpus.dtypes)['item']}, score double"
    return _top(for_each_block(packed(corpus), queries, kernel, schema), limit)


def parents_of(ranked: DataFrame, units: DataFrame) -> DataFrame:
    """Small to big: a parent's rank is that of its best unit. units: item, parent."""
    best = ranked.join(units, "item").groupBy("query_id", "parent").agg(F.min("rank").alias("unit_rank"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("unit_rank", "parent")))


def overlap_at(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per query the share of a's first k that b's first k has."""
    both = a.filter(F.col("rank") <= k).select("query_id", "item").join(b.filter(F.col("rank") <= k).select("query_id", "item", F.lit(1).alias("hit")), ["query_id", "item"], "left")
    return both.groupBy("query_id").agg((F.count("hit") / F.lit(float(k))).alias("overlap"))


class InvertedFile:
    """Cells by k-means on a bounded sample (`sample` vectors, the first by a hash); every vector is indexed."""

    def __init__(self, corpus: DataFrame, cells: int = 32, sample: int = 20_000, seed: int = 1):
        got = corpus.filter("embedding IS NOT NULL").orderBy(F.xxhash64("item")).limit(sample).select("embedding").collect()
        x = np.array([r[0] for r in got], dtype=np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        r = np.random.default_rng(seed)
        self.centres = x[r.choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(10):
            near = np.argmax(x @ self.centres.T, axis=1)
            for c in range(len(self.centres)):
                if (near == c).any():
                    self.centres[c] = x[near == c].mean(0)
            self.centres /= np.maximum(np.linalg.norm(self.centres, axis=1, keepdims=True), 1e-12)
        self.table = self._with_cells(corpus.filter("embedding IS NOT NULL"), 1).withColumn("cell", F.col("cells")[0]).drop("cells")

    def _with_cells(self, rows: DataFrame, n: int) -> DataFrame:
        """Adds cells: the n nearest centres of a row's vector, best first. Centres go to the tasks as one matrix."""
        centres = self.centres

        def work(batches):
            import pyarrow as pa

            for batch in batches:
                x = batch.column("embedding").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
                near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n] if batch.num_rows else np.zeros((0, n), np.int64)
                cells = pa.ListArray.from_arrays(np.arange(0, near.size + 1, max(near.shape[1], 1), dtype=np.int32), near.ravel().astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

        return rows.mapInArrow(work, T.StructType([*rows.schema.fields]).add("cells", T.ArrayType(T.IntegerType())))

    def search(self, queries: DataFrame, limit: int, probes: int = 8, digits: int = 9) -> DataFrame:
        """query_id, item, score, rank: as `nearest`, of the vectors in the `probes` cells whose centres are nearest to a query.

        An Arrow batch of the table is one page with its vectors in order of their cells. A block of queries meets a
        page once, as one product for each cell with those queries that probe it."""
        centres, table = self.centres, self.table

        def paged(batches):
            import pyarrow as pa

            for batch in batches:
                cells = batch.column(2).to_numpy()
                order = np.argsort(cells, kind="stable")
                sizes = np.bincount(cells, minlength=len(centres)).astype(np.int32)
                for rows in [batch.take(pa.array(order))] if len(order) else []:
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(v)], v) for v in (rows.column(0), rows.column(1).flatten(), pa.array(sizes))], names=["items", "x", "sizes"])

        def kernel(page, ids, q):
            import pyarrow as pa

            items = page["items"].values
            x, order = unit(page["x"].values.to_numpy().astype(np.float64).reshape(len(items), -1)), order_of(items)
            ends = np.cumsum(page["sizes"].values.to_numpy())
            asked = np.zeros((len(q), len(centres)), dtype=bool)
            np.put_along_axis(asked, np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes], True, axis=1)
            q = unit(q)
            at, scores = [], []
            for k in range(0, len(q), 256):
                s = np.full((len(q[k : k + 256]), len(items)), -np.inf)
                for c, end in enumerate(ends):
                    rows, begin = np.flatnonzero(asked[k : k + 256, c]), ends[c - 1] if c else 0
                    if len(rows) and begin < end:
                        s[rows, begin:end] = np.round(q[k + rows] @ x[begin:end].T, digits)
                for row in s:
                    best = best_of(row, order, limit)
                    at.append(best[np.isfinite(row[best])])
                    scores.append(row[at[-1]])
            which = pa.array(np.repeat(np.arange(len(q)), [len(a) for a in at]))
            return pa.RecordBatch.from_arrays([ids.take(which), items.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(scores))], names=["query_id", "item", "score"])

        kinds = dict(table.dtypes)
        pages = table.select("item", "embedding", "cell").mapInArrow(paged, f"items array<{kinds['item']}>, x {kinds['embedding']}, sizes array<int>")
        schema = f"query_id {dict(queries.dtypes)['query_id']}, item {kinds['item']}, score double"
        return _top(for_each_block(pages, queries, kernel, schema), limit)
