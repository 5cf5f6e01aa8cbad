"""Approximate vector search by navigable small-world graphs, one to a page of the corpus, kept as a table.

A page holds at most 1.5 times `page_rows` vectors. Its graph links a vector with up to LINKS near ones that are not
hidden behind nearer ones, and with up to LINKS that link to it. Its entries are about twice the root of its size: most
are chosen each as far as can be from those before, so that groups without a link between them are all entered, the
rest at random. A search scores the entries, then follows the links of the best vectors it has found, holding
`ef` of them, until none of these is left unfollowed. Whole blocks of queries walk a page together, step by step.

Building is one deal of the corpus by item. Searching deals nothing: blocks of queries meet the pages where these
are read (or are sent to them, beyond the bound of `dense.for_each_block`), and `limit` rows per query and page go to
the merge. New vectors are appended as pages of their own; `compacted` deals everything anew. An item may come twice,
null vectors are left out, a zero vector is near to nothing, and an empty corpus gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import dense

#: Links a vector chooses (others may choose it as often again), and near vectors it chooses from.
LINKS, CANDIDATES = 16, 48


def links_of(x: np.ndarray, block: int = 512) -> np.ndarray:
    """Neighbours of unit vectors, LINKS chosen and LINKS choosing ones a row, filled up with -1."""
    n = len(x)
    x = x.astype(np.float32)
    k = min(CANDIDATES, n - 1)
    chosen = np.full((n, LINKS), -1, dtype=np.int32)
    near = np.zeros((n, LINKS), dtype=x.dtype)
    for a in range(0, n if k > 0 else 0, block):
        s = x[a : a + block] @ x.T
        rows = np.arange(len(s))
        s[rows, a + rows] = -np.inf
        c = np.argpartition(np.negative(s, out=s), k - 1, axis=1)[:, :k]
        np.negative(s, out=s)
        c = np.take_along_axis(c, np.argsort(-np.take_along_axis(s, c, 1), axis=1, kind="stable"), 1)
        sim = np.take_along_axis(s, c, 1)
        among = x[c] @ x[c].transpose(0, 2, 1)
        open_ = np.zeros(c.shape, dtype=bool)  # not hidden behind a nearer one that is taken
        for j in range(k):
            open_[:, j] = ~((among[:, j, :j] > sim[:, j : j + 1]) & open_[:, :j]).any(1)
        first = np.argsort(~open_, axis=1, kind="stable")[:, :LINKS]
        m = first.shape[1]
        chosen[a : a + block, :m] = np.take_along_axis(c, first, 1)
        near[a : a + block, :m] = np.take_along_axis(sim, first, 1)
    source, target = np.repeat(np.arange(n, dtype=np.int32), LINKS), chosen.ravel()
    real = target >= 0
    source, target, sim = source[real], target[real], near.ravel()[real]
    order = np.lexsort((-sim, target))
    source, target = source[order], target[order]
    nth = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((n, LINKS), -1, dtype=np.int32)
    back[target[nth < LINKS], nth[nth < LINKS]] = source[nth < LINKS]
    #: Whom a vector has chosen itself need not be linked again.
    back[(back[:, :, None] == chosen[:, None, :]).any(2)] = -1
    return np.concatenate([chosen, back], axis=1)


def entries_of(x: np.ndarray, seed: int) -> np.ndarray:
    """Where walks begin."""
    n = len(x)
    count = min(n, max(32, 2 * int(n**0.5)))
    r = np.random.default_rng(seed)
    chosen = [int(r.integers(n))]
    nearest = x @ x[chosen[0]]
    while len(chosen) < 2 * count // 3:
        chosen.append(int(nearest.argmin()))
        np.maximum(nearest, x @ x[chosen[-1]], out=nearest)
    return np.unique([*chosen, *r.choice(n, count - len(chosen), replace=False)]).astype(np.int32)


def walk(x: np.ndarray, links: np.ndarray, entries: np.ndarray, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that a bounded walk finds for each query (its beam, -1 where empty), and how many it scored."""
    n, m = len(x), len(q)
    seen = np.zeros((m, n), dtype=bool)
    seen[:, entries] = True
    scored = np.full(m, len(entries), dtype=np.int64)
    beam = np.full((m, ef), -1, dtype=np.int64)
    sims = np.full((m, ef), -np.inf)
    followed = np.ones((m, ef), dtype=bool)

    def merge(rows, found, new):
        """Puts found vectors (row by row, -inf where none) into the beams of these rows."""
        s = np.concatenate([sims[rows], new], axis=1)
        best = np.argpartition(-s, ef - 1, axis=1)[:, :ef] if s.shape[1] > ef else np.arange(s.shape[1])[None, :].repeat(len(s), 0)
        beam[rows, : best.shape[1]] = np.take_along_axis(np.concatenate([beam[rows], found], axis=1), best, 1)
        done = np.concatenate([followed[rows], ~np.isfinite(new)], axis=1)
        followed[rows, : best.shape[1]] = np.take_along_axis(done, best, 1)
        sims[rows, : best.shape[1]] = np.take_along_axis(s, best, 1)

    everyone = np.arange(m)
    merge(everyone, np.broadcast_to(entries, (m, len(entries))), q @ x[entries].T)
    while True:
        waiting = np.where(followed, -np.inf, sims)
        at = waiting.argmax(1)
        rows = np.flatnonzero(np.isfinite(waiting[everyone, at]))
        if not len(rows):
            return beam, scored
        followed[rows, at[rows]] = True
        found = links[beam[rows, at[rows]]]
        fresh = (found >= 0) & ~seen[rows[:, None], found]
        who, which = np.nonzero(fresh)
        ids = found[who, which]
        seen[rows[who], ids] = True
        scored[rows] += fresh.sum(1)
        new = np.full(found.shape, -np.inf)
        new[who, which] = np.einsum("ij,ij->i", q[rows[who]], x[ids])
        merge(rows, found.astype(np.int64), new)


class GraphIndex:
    """The stored pages at `path`: page, items, x (vectors end to end), links (2 * LINKS a vector), entries."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, corpus: DataFrame, path: str, page_rows: int = 20_000) -> GraphIndex:
        """corpus: item, embedding. Vectors are dealt by item into tasks of about page_rows, each at least one page."""
        index = cls(corpus.sparkSession, path)
        index._write(corpus, page_rows, "overwrite")
        return index

    def append(self, corpus: DataFrame, page_rows: int = 20_000) -> None:
        """New vectors as pages of their own; what is stored stays as it is."""
        self._write(corpus, page_rows, "append")

    def pages(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def vectors(self) -> DataFrame:
        """item, embedding: what the index holds."""
        width = F.size("x") / F.size("items")
        return self.pages().select(F.posexplode("items").alias("n", "item"), "x", width.cast("int").alias("w")).select("item", F.slice("x", F.col("n") * F.col("w") + 1, F.col("w")).alias("embedding"))

    def adjacency(self) -> DataFrame:
        """page, item, neighbour: the graph's links as rows."""
        link = self.pages().select("page", "items", F.posexplode("links").alias("n", "to")).filter("to >= 0")
        return link.select("page", F.get("items", F.floor(F.col("n") / (2 * LINKS)).cast("int")).alias("item"), F.get("items", F.col("to")).alias("neighbour"))

    def compacted(self, path: str, page_rows: int = 20_000) -> GraphIndex:
        """The same vectors in full pages at another path."""
        return GraphIndex.build(self.vectors(), path, page_rows)

    def _write(self, corpus: DataFrame, page_rows: int, mode: str) -> None:
        kinds = dict(corpus.dtypes)
        rows = corpus.select("item", "embedding").filter("embedding IS NOT NULL")
        tasks = max(1, -(-rows.count() // page_rows))
        salt = uuid.uuid4().int & 0x7FFFFFFF

        def work(batches):
            import pyarrow as pa

            held, count, number = [], 0, 0

            def page(batch):
                nonlocal number
                items, flat = batch.column(0), batch.column(1).flatten()
                x = dense.unit(flat.to_numpy().astype(np.float64).reshape(len(items), -1))
                cells = [items, flat, pa.array(links_of(x).ravel()), pa.array(entries_of(x, len(items)))]
                name = salt << 32 | TaskContext.get().partitionId() << 12 | number
                number += 1
                return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *(pa.ListArray.from_arrays([0, len(v)], v) for v in cells)], names=["page", "items", "x", "links", "entries"])

            def whole():
                return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    count += batch.num_rows
                while count >= 1.5 * page_rows:
                    all_ = whole()
                    yield page(all_.slice(0, page_rows))
                    held, count = [all_.slice(page_rows)], count - page_rows
            if count:
                yield page(whole())

        schema = f"page bigint, items array<{kinds['item']}>, x {kinds['embedding']}, links array<int>, entries array<int>"
        rows.repartition(tasks, F.xxhash64("item")).mapInArrow(work, schema).write.mode(mode).parquet(self.path)

    def search(self, queries: DataFrame, limit: int, ef: int = 64, digits: int = 9) -> DataFrame:
        """query_id, item, score, rank, scored: as `dense.nearest`, of the vectors that the walks find. scored: how many
        vectors a query was compared with, over all pages."""
        ef = max(ef, limit)

        def kernel(page, ids, q):
            import pyarrow as pa

            items = page["items"].values
            n = len(items)
            x, q = dense.unit(page["x"].values.to_numpy().astype(np.float64).reshape(n, -1)), dense.unit(q)
            links, entries = page["links"].values.to_numpy().reshape(n, -1), page["entries"].values.to_numpy()
            order = dense.order_of(items)
            where, scores, which, counts = [], [], [], []
            for a in range(0, len(q), 256):
                beams, scored = walk(x, links, entries, q[a : a + 256], ef)
                for k, beam in enumerate(beams):
                    found = beam[beam >= 0]
                    s = np.round(x[found] @ q[a + k], digits)
                    best = dense.best_of(s, order[found], limit)
                    where.append(found[best])
                    scores.append(s[best])
                    which.append(np.full(len(best), a + k))
                    counts.append(np.full(len(best), scored[k]))
            where, scores, which, counts = map(np.concatenate, (where, scores, which, counts))
            page_of = pa.array(np.full(len(which), page["page"].as_py()))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(which)), items.take(pa.array(where)), pa.array(scores), page_of, pa.array(counts)], names=["query_id", "item", "score", "page", "scored"])

        pages = self.pages()
        kind = dict(pages.dtypes)["items"].removeprefix("array<").removesuffix(">")
        schema = f"query_id {dict(queries.dtypes)['query_id']}, item {kind}, score double, page bigint, scored bigint"
        found = dense.for_each_block(pages, queries, kernel, schema)
        #: A query has rows of every page, each with that page's count: one of them a page is summed.
        return dense.top_with_counts(found, limit)
