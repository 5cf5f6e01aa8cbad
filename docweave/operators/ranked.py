"""Ranked keyword search over postings in blocks of chunks, with a maximum beside each list so that blocks are skipped.

The index is three tables under one path. `blocks`: per block of BLOCK neighbouring chunks and per term the slots and
frequencies of the chunks that hold it, the greatest frequency and the least length among them, and one header row a
block (term null) with its chunk ids and lengths. `terms`: term, df. `stats`: chunks, total length. Lengths and
document frequencies are so kept beside the postings and not counted again by a search.

A search reads the lists of its own terms, deals blocks over tasks, most promising blocks first, and keeps the best
chunks of each query. From a list's maximum follows what a term can add to any chunk of the block; where the sum over
a query's terms can't reach the query's worst kept score, the block isn't scored for it (max-score). Scored are whole
blocks at once, as one product of the block's chunk-by-term matrix with the term-by-query matrix.

Queries are dealt to groups of QUERIES, which bounds that matrix; a group's table is sent once to each task. `report`
tells per query how many blocks and postings there were for it and how many of them were scored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import dense, sparse

#: Chunks in a block, and queries in a group.
BLOCK, QUERIES = 128, 512
#: Chunks that a task scores: with more there are more tasks.
SHARE = 50_000
LISTS = "block bigint, term string, slots array<int>, tfs array<int>, n int, max_tf int, min_len int, potential double"
_HALF = np.concatenate([[0.0], np.cumsum([1.0 / (j * j) for j in range(1, 257)])])


def rank_cell(tf, length, average):
    """What a term of weight one adds to a chunk, by the rank function."""
    return _HALF[np.minimum(tf, 256)]


def bm25_cell(k1: float, b: float):
    def cell(tf, length, average):
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.maximum(length, 1) / average))

    return cell


class BlockIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, post: DataFrame, path: str, block: int = BLOCK) -> BlockIndex:
        """post: chunk_id, term, tf. A chunk's postings are brought together once; chunks are sorted by id."""
        return cls.build_lists(sparse.listed(post).repartitionByRange("chunk_id").sortWithinPartitions("chunk_id"), path, block)

    @classmethod
    def build_lists(cls, lists: DataFrame, path: str, block: int = BLOCK) -> BlockIndex:
        """lists: counted chunks (chunk_id, terms, tfs). Those that follow each other in a partition are a block: nothing
        is shuffled."""
        kind = dict(lists.dtypes)["chunk_id"]

        def work(batches):
            from pyspark import TaskContext

            number = TaskContext.get().partitionId() << 32
            for batch in batches:
                for a in range(0, batch.num_rows, block):
                    yield from pack(batch.slice(a, block), number)
                    number += 1

        def pack(rows, number):
            import pyarrow as pa

            ids, terms, tfs = rows.column(0), rows.column(1), rows.column(2)
            coded = terms.flatten().dictionary_encode()
            term, tf = coded.indices.to_numpy(), tfs.flatten().to_numpy()
            counts = np.diff(terms.offsets.to_numpy())
            slot = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            lengths = np.add.reduceat(tf, np.cumsum(counts) - counts).astype(np.int32)
            order = np.lexsort((slot, term))
            term, tf, slot = term[order], tf[order].astype(np.int32), slot[order]
            heads = np.flatnonzero(np.diff(term, prepend=-1))
            at = np.append(heads, len(term)).astype(np.int32)
            most, least = np.maximum.reduceat(tf, heads), np.minimum.reduceat(lengths[slot], heads)
            potential = float(_HALF[np.minimum(most, 256)].sum())
            n, none = len(heads), pa.nulls(len(heads))
            schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("slots", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("n", pa.int32()), ("max_tf", pa.int32()), ("min_len", pa.int32()), ("potential", pa.float64()), ("ids", pa.list_(ids.type)), ("lengths", pa.list_(pa.int32()))])
            lists = [pa.array(np.full(n, number)), coded.dictionary.take(pa.array(term[heads])), pa.ListArray.from_arrays(at, slot), pa.ListArray.from_arrays(at, tf), pa.array(np.diff(at)), pa.array(most), pa.array(least), pa.array(np.full(n, potential)), none.cast(pa.list_(ids.type)), none.cast(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(lists, schema=schema)
            head = [[number], [None], [None], [None], [len(ids)], [None], [None], [potential], None, [lengths.tolist()]]
            arrays = [pa.ListArray.from_arrays([0, len(ids)], ids) if v is None else pa.array(v, f.type) for v, f in zip(head, schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

        blocks = lists.select("chunk_id", "terms", "tfs").mapInArrow(work, f"{LISTS}, ids array<{kind}>, lengths array<int>")
        blocks.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
        index = cls(lists.sparkSession, path)
        index.blocks().filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df")).sort("term").write.mode("overwrite").parquet(f"{path}/terms")
        index.blocks().filter("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x)), F.lit(0)).alias("total")).write.mode("overwrite").parquet(f"{path}/stats")
        return index

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def terms(self) -> DataFrame:
        """term, df."""
        return self.spark.read.parquet(f"{self.path}/terms")

    def stats(self) -> DataFrame:
        """chunks, total: one row."""
        return self.spark.read.parquet(f"{self.path}/stats")

    def keyword_search(self, terms: DataFrame, limit: int, digits: int = 9) -> DataFrame:
        """What `sparse.keyword_search` finds: query_id, chunk_id, score, rank."""
        t = terms.select("query_id", "term").distinct()
        n = t.groupBy("query_id").agg((F.lit(0.1 / sparse.RANK_LIMIT) / F.count("*")).alias("weight"))
        return self._top(self._found(t.join(n, "query_id"), limit, rank_cell, digits), limit)

    def bm25(self, terms: DataFrame, limit: int, k1: float = 1.2, b: float = 0.75, digits: int = 9) -> DataFrame:
        """What `sparse.bm25` finds: query_id, chunk_id, score, rank."""
        return self._top(self._found(self._idf(terms), limit, bm25_cell(k1, b), digits), limit)

    def report(self, terms: DataFrame, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """query_id, blocks, scored_blocks, postings, scored_postings of a BM25 search."""
        counts = self._found(self._idf(terms), limit, bm25_cell(k1, b), 9).filter("chunk_id IS NULL")
        return counts.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in ("blocks", "scored_blocks", "postings", "scored_postings")])

    def _idf(self, terms: DataFrame) -> DataFrame:
        t = terms.select("query_id", "term").distinct()
        known = t.join(self.terms(), "term").join(F.broadcast(self.stats()))
        return known.select("query_id", "term", F.log(1 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight"))

    @staticmethod
    def _top(found: DataFrame, limit: int) -> DataFrame:
        return sparse.top(found.filter("chunk_id IS NOT NULL").select("query_id", "chunk_id", "score"), limit)

    def _found(self, weights: DataFrame, limit: int, cell, digits: int) -> DataFrame:
        """weights: query_id, term, weight (over 0). Each task's best chunks per query, and its counts (chunk_id null)."""
        kinds = dict(weights.dtypes)["query_id"], dict(self.blocks().dtypes)["ids"].removeprefix("array<").removesuffix(">")
        groups = 1 + weights.select("query_id").distinct().count() // QUERIES
        found = self.stats().first()
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1 + (found.chunks if found else 0) // SHARE)
        asked = weights.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
        sides = asked.groupBy("group", "term").agg(F.collect_list("query_id").alias("queries"), F.collect_list("weight").alias("weights"))
        sent = sides.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).withColumn("part", F.lit(0))
        all_groups = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        task = F.pmod(F.xxhash64("block"), F.lit(tasks)).cast("int")
        heads = self.blocks().filter("term IS NULL").join(F.broadcast(self.stats())).withColumn("group", all_groups)
        lists = self.blocks().filter("term IS NOT NULL").drop("ids", "lengths").join(sides.select("term", "group"), "term")
        dealt = heads.withColumn("part", F.lit(1)).unionByName(lists.withColumn("part", F.lit(2)), allowMissingColumns=True).withColumn("task", task)
        rows = sent.unionByName(dealt, allowMissingColumns=True).select("group", "task", "part", "block", "term", "queries", "weights", "slots", "tfs", "n", "max_tf", "min_len", "potential", "ids", "lengths", "chunks", "total")
        order = ["group", "task", F.expr("part > 0"), F.desc("potential"), "block", "part", "term"]
        schema = f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double, blocks bigint, scored_blocks bigint, postings bigint, scored_postings bigint"
        return rows.repartitionById(tasks, "task").sortWithinPartitions(*order).mapInArrow(lambda batches: _scored(batches, limit, cell, digits), schema)


class _Group:
    """One task's state for one group of queries."""

    def __init__(self, limit: int):
        self.limit, self.row, self.at = limit, {}, {}
        self.sides: list[tuple] = []
        self.best: list[tuple] = []

    def learn(self, term: str, queries: list, weights: list) -> None:
        self.row[term] = len(self.sides)
        self.sides.append(([self.at.setdefault(q, len(self.at)) for q in queries], weights))

    def ready(self) -> None:
        m = len(self.at)
        self.weight = np.zeros((len(self.sides), m))
        for k, (of, w) in enumerate(self.sides):
            self.weight[k, of] = w
        self.asked = (self.weight > 0).astype(np.float64)
        self.floor = np.zeros(m)
        self.best = [(np.zeros(0), []) for _ in range(m)]
        self.counts = np.zeros((m, 4), dtype=np.int64)

    def score(self, head: dict, lists: list[tuple], cell, digits: int) -> None:
        """lists: pieces of the block's lists: the terms' rows, n, max_tf and min_len of each, and their slots and tfs end to end."""
        average = head["total"] / head["chunks"]
        rows, n, most, least, slot, tf = (np.concatenate(x) for x in zip(*lists))
        weight = self.weight[rows]
        bound = cell(most, least, average) @ weight
        #: A bound just under the worst kept score may still tie with it once scores are rounded.
        alive = np.flatnonzero((bound > 0) & (bound >= self.floor - 2 * 10.0**-digits))
        held = np.rint(n.astype(np.float64) @ self.asked[rows]).astype(np.int64)
        self.counts[:, 0] += bound > 0
        self.counts[:, 2] += held
        if not len(alive):
            return
        self.counts[alive, 1] += 1
        self.counts[alive, 3] += held[alive]
        lengths = np.array(head["lengths"])
        x = np.zeros((len(lengths), len(rows)))
        x[slot, np.repeat(np.arange(len(rows)), n)] = cell(tf, lengths[slot], average)
        scores = (x @ weight[:, alive]).T
        rounded = np.round(scores, digits)
        hit = (scores > 0) & (rounded >= self.floor[alive, None])
        for k in np.flatnonzero(hit.any(axis=1)).tolist():
            q, place = alive[k], np.flatnonzero(hit[k])
            if len(place) > self.limit:
                v = rounded[k, place]
                place = place[v >= np.partition(v, len(v) - self.limit)[len(v) - self.limit]]
            old, ids = self.best[q]
            s, ids = np.concatenate([old, rounded[k, place]]), [*ids, *(head["ids"][p] for p in place.tolist())]
            keep = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[: self.limit]
            self.best[q] = s[keep], [ids[i] for i in keep]
            if len(keep) == self.limit:
                self.floor[q] = s[keep[-1]]

    def batch(self):
        import pyarrow as pa

        names = list(self.at)
        q, c, s = [], [], []
        for query, (scores, ids) in zip(names, self.best):
            q += [query] * len(ids)
            c += ids
            s += scores.tolist()
        n, counts = len(q), self.counts.tolist()
        columns = [q + names, c + [None] * len(names), s + [None] * len(names), *([None] * n + [r[k] for r in counts] for k in range(4))]
        return columns


def _scored(batches, limit: int, cell, digits: int):
    """Rows of a task come by group: the queries' terms, then block by block its header and its lists. A batch's lists of
    a block are taken as slices of its columns, not row by row."""
    import pyarrow as pa

    state, at, head, lists, ready = None, None, None, [], False

    def finish():
        if head is not None and lists:
            state.score(head, lists, cell, digits)

    def out():
        columns = state.batch()
        types = [kinds["queries"].value_type, kinds["ids"].value_type, pa.float64(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names=["query_id", "chunk_id", "score", "blocks", "scored_blocks", "postings", "scored_postings"])

    kinds = {}
    for batch in batches:
        kinds = kinds or {f.name: f.type for f in batch.schema}
        column = dict(zip(batch.schema.names, batch.columns))
        group, task, part, block, n, most, least = (column[c].fill_null(0).to_numpy() for c in ("group", "task", "part", "block", "n", "max_tf", "min_len"))
        begin, slots, tfs = column["slots"].offsets.to_numpy(), column["slots"].values.to_numpy(), column["tfs"].values.to_numpy()
        coded = column["term"].dictionary_encode()
        terms, code = coded.dictionary.to_pylist(), coded.indices.fill_null(0).to_numpy()
        changes = np.ones(batch.num_rows, dtype=bool)  # a row goes on with what the one before belongs to, or does not
        changes[1:] = (np.diff(group) != 0) | (np.diff(task) != 0) | (np.diff(block) != 0) | (np.diff(part > 0) != 0)
        edges = [*np.flatnonzero(changes).tolist(), batch.num_rows]
        rows = None  # by number of a term in this batch, its row in the group's matrix
        for a, z in zip(edges, edges[1:]):
            if (group[a], task[a]) != at:
                if state is not None and ready:
                    finish()
                    yield out()
                state, at, head, lists, ready, rows = _Group(limit), (group[a], task[a]), None, [], False, None
            if part[a] == 0:
                for r in range(a, z):
                    state.learn(terms[code[r]], column["queries"][r].as_py(), column["weights"][r].as_py())
                continue
            if not ready:
                state.ready()
                ready = True
            if part[a] == 1:
                finish()
                head, lists = {c: column[c][a].as_py() for c in ("ids", "lengths", "chunks", "total")}, []
                a += 1
            if a < z:
                if rows is None:
                    rows = np.array([state.row.get(t, -1) for t in terms])
                lists.append((rows[code[a:z]], n[a:z], most[a:z], least[a:z], slots[begin[a] : begin[z]], tfs[begin[a] : begin[z]]))
    if state is not None and ready:
        finish()
        yield out()
