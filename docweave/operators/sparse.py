"""Postings, document frequencies, keyword search with ts_rank or BM25 scores."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx

TOTAL = "__total__"
#: The limit of the sum of 1 / j**2, as the rank function has it.
RANK_LIMIT = 1.64493406685


#: Texts that are counted, or scored, at a time.
ROWS = 1024
#: Entries of a table over all pairs of the characters in a batch.
TABLE = 1_000_000


def _whole(words):
    """Distinct terms of words, the words' terms by number end to end, and how many each has: here a word is a term."""
    return words, np.arange(len(words)), np.ones(len(words), dtype=np.int64)


def _pairs(words):
    """The same for pairs of characters. A pair is one number, from those of the characters that are there; few pairs
    are counted in a table, many are sorted."""
    import pyarrow as pa

    n = pc.utf8_length(words).to_numpy().astype(np.int64)
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else [0, 0]
    joined = bytes(memoryview(words.buffers()[2])[ends[0] : ends[-1]]).decode() if len(words) else ""
    code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    letters = np.flatnonzero(np.bincount(code, minlength=1))
    number = np.zeros(letters[-1] + 1 if len(letters) else 1, dtype=np.int64)
    number[letters] = np.arange(1, len(letters) + 1)  # 0 is no character
    base, code = len(letters) + 1, number[code]
    after = np.append(code[1:], 0)
    last = np.cumsum(n) - 1
    after[last[n == 1]] = 0
    begins = np.ones(len(code), dtype=bool)
    begins[last[n > 1]] = False  # a word's last character begins no pair, unless it is alone
    pairs = (code * base + after)[begins]
    if base * base <= TABLE:
        keys = np.flatnonzero(np.bincount(pairs, minlength=1))
        at = np.zeros(base * base, dtype=np.int64)
        at[keys] = np.arange(len(keys))
        flat = at[pairs]
    else:
        keys, flat = np.unique(pairs, return_inverse=True)
    shown = ["", *map(chr, letters.tolist())]
    return pa.array([shown[k // base] + shown[k % base] for k in keys.tolist()], pa.string()), flat, np.maximum(n - 1, 1)


def counted(chunks: DataFrame, tokenizer: str = "bigram", id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """chunk_id, terms, tfs: one row a chunk. Texts are dealt by id and sorted once; a chunk's terms are then counted
    where it is, so that no posting is shuffled. Rows that repeat an id are counted as one; without a term there is none.

    A batch's distinct words are cut into terms once each, however often they stand there."""

    def tally(ids, names, row, term):
        import pyarrow as pa

        keys, tf = np.unique(row * len(names) + term, return_counts=True)
        offsets = np.append(0, np.cumsum(np.bincount(keys // max(len(names), 1), minlength=len(ids)))).astype(np.int32)
        terms = names.take(pa.array(keys % max(len(names), 1)))
        return [pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))]

    return with_terms(chunks, tally, "terms array<string>, tfs array<bigint>", tokenizer, id_col, text_col)


def with_terms(chunks: DataFrame, tally: Callable, columns: str, tokenizer: str = "bigram", id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """chunk_id and what `tally` makes of chunks' terms, where the chunk is. tally gets a batch's distinct ids, the names of
    its terms, and for each occurrence the number of its id and of its term, by id; it returns a column for each of `columns`."""
    cut = {"simple": _whole, "bigram": _pairs}[tokenizer]
    kind = dict(chunks.dtypes)[id_col]
    texts = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").repartition("chunk_id").sortWithinPartitions("chunk_id").select("chunk_id", F.lower("text").alias("text"))
    words_of = re.compile(tx.WORD).findall
    named = ["chunk_id", *(c.split()[0] for c in columns.split(", "))]

    def counts(ids, texts):
        import pyarrow as pa

        found = [words_of(t) for t in texts.to_pylist()]
        some = np.array([bool(f) for f in found])
        if not some.all():
            ids, found = ids.filter(pa.array(some)), [f for f in found if f]
        new = np.ones(len(found), dtype=bool)
        if found:
            new[1:] = pc.or_(pc.not_equal(ids[1:], ids[:-1]).fill_null(False), pc.xor(ids[1:].is_valid(), ids[:-1].is_valid()))
        coded = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
        names, flat, sizes = cut(coded.dictionary)
        starts = np.cumsum(sizes) - sizes
        word = coded.indices.to_numpy()
        n = sizes[word]
        term = flat[np.repeat(starts[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        row = np.repeat(np.repeat(np.cumsum(new) - 1, np.array([len(f) for f in found], dtype=np.int64)), n)
        ids = ids.filter(pa.array(new))
        return pa.RecordBatch.from_arrays([ids, *tally(ids, names, row, term)], names=named)

    def work(batches):
        import pyarrow as pa

        held = []  # rows of the id that the last batch ended with
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = pa.Table.from_batches([*held, batch.slice(at, ROWS)]).combine_chunks().to_batches()[0]
                ids = rows.column(0)
                end = ids[len(ids) - 1]
                last = pc.index(ids, end).as_py() if end.is_valid else 0  # nulls are sorted first
                held = [rows.slice(last)]
                if last:
                    yield counts(ids.slice(0, last), rows.column(1).slice(0, last))
        if held:
            yield counts(held[0].column(0), held[0].column(1))

    return texts.mapInArrow(work, f"chunk_id {kind}, {columns}")


def postings(chunks: DataFrame, tokenizer: str = "bigram", id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """chunk_id, term, tf."""
    return posted(counted(chunks, tokenizer, id_col, text_col))


def posted(lists: DataFrame) -> DataFrame:
    """chunk_id, term, tf of counted chunks (chunk_id, terms, tfs)."""
    return lists.select("chunk_id", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("chunk_id", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))


def listed(post: DataFrame) -> DataFrame:
    """chunk_id, terms, tfs of postings: a chunk's are brought together."""
    return post.groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf")).alias("p")).select("chunk_id", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs"))


def store(post: DataFrame, path: str, append: bool = False) -> DataFrame:
    """The index as a table: postings by term, so that a term's are together and others are passed over by the
    files' statistics. Every search reads it; texts are cut into terms once, and new chunks are appended."""
    post.repartition("term").sortWithinPartitions("term", "chunk_id").write.mode("append" if append else "overwrite").parquet(path)
    return post.sparkSession.read.parquet(path)


def document_frequency(post: DataFrame, chunks: DataFrame) -> DataFrame:
    """lexeme, df over chunks (not occurrences), and the number of chunks under TOTAL."""
    df = post.groupBy(F.col("term").alias("lexeme")).agg(F.count("*").alias("df"))
    return df.unionByName(chunks.agg(F.count("*").alias("df")).select(F.lit(TOTAL).alias("lexeme"), "df"))


def query_terms(queries: DataFrame, tokenizer: str = "bigram", text_col: str = "text") -> DataFrame:
    """query_id, term, word: distinct."""
    return queries.select("query_id", F.explode(tx.word_tokens(F.col(text_col), tokenizer)).alias("t")).select("query_id", F.col("t.token").alias("term"), F.col("t.word").alias("word")).distinct()


def without_stop_words(terms: DataFrame) -> DataFrame:
    """Stop words are judged by the word, never by its pieces; a query may be left with no term."""
    return terms.filter(~F.col("word").isin(*tx.ENGLISH_STOP_WORDS, *tx.KOREAN_STOP_WORDS))


def trim_common(terms: DataFrame, frequencies: DataFrame, trim: float) -> DataFrame:
    """Keeps terms with df <= total * trim; an unknown term has df 0; no trim or no table keeps all."""
    if trim <= 0:
        return terms
    total = frequencies.filter(F.col("lexeme") == TOTAL).agg(F.max("df").alias("total"))
    return terms.join(frequencies.withColumnRenamed("lexeme", "term"), "term", "left").join(F.broadcast(total)).filter(F.col("total").isNull() | (F.coalesce("df", F.lit(0)) <= F.col("total") * trim)).drop("df", "total")


def half_squares(n: Column) -> Column:
    """Sum of 1 / j**2 for j up to n, at most 256 terms: a lookup in the prefix sums, which generated code can do."""
    sums, total = [], 0.0
    for j in range(1, 257):
        total += 1.0 / (j * j)
        sums.append(F.lit(total))
    return F.element_at(F.array(*sums), F.least(n, F.lit(256)).cast("int"))


def top(scored: DataFrame, limit: int, item: str = "chunk_id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), item)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def keyword_search(terms: DataFrame, post: DataFrame, limit: int, scope: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """query_id, chunk_id, score, rank: chunks with any term, by the rank function without weights.

    scope: chunk_id rows; None is unscoped and an empty table finds nothing. The scope is below the ranking."""
    t = terms.select("query_id", "term").distinct()
    n = t.groupBy("query_id").agg(F.count("*").alias("n"))
    p = post if scope is None else post.join(scope.select("chunk_id"), "chunk_id", "left_semi")
    weighed = p.select("chunk_id", "term", half_squares(F.col("tf")).alias("h"))  # once a posting, not once a match
    hits = weighed.join(t, "term").groupBy("query_id", "chunk_id").agg(F.sum("h").alias("h"))
    scored = hits.join(n, "query_id").select("query_id", "chunk_id", F.round(F.lit(0.1 / RANK_LIMIT) * F.col("h") / F.col("n"), digits).alias("score"))
    return top(scored, limit)


#: Entries of the query-by-term matrix that is broadcast at a time (8 bytes each); more queries go in blocks.
BLOCK_ENTRIES = 4_000_000


def keyword_search_blocks(terms: DataFrame, post: DataFrame, limit: int, digits: int = 9) -> DataFrame:
    """keyword_search for many queries over common terms, where a join would make a row per query, chunk and term.

    A batch of chunks is one matrix of the terms that any query of a block has, and one product with the block's
    query-by-term matrix."""
    return keyword_search_lists(terms, listed(post), limit, digits)


def keyword_search_lists(terms: DataFrame, lists: DataFrame, limit: int, digits: int = 9) -> DataFrame:
    """keyword_search over counted chunks (chunk_id, terms, tfs): they are scored where they are, and only a task's best
    `limit` per query leave it."""
    by_query = terms.select("query_id", "term").distinct().groupBy("query_id").agg(F.collect_list("term").alias("terms")).orderBy("query_id")
    out = None
    for block, columns in _blocks(by_query):
        matrix = np.zeros((len(block), len(columns)))
        for k, (_, own) in enumerate(block):
            matrix[k, [columns[t] for t in own]] = 0.1 / RANK_LIMIT / len(own)
        part = _scan(terms, lists, [q for q, _ in block], list(columns), matrix, _numbered, limit, digits)
        out = part if out is None else out.unionByName(part)
    return top(out, limit) if out is not None else keyword_search(terms, posted(lists), limit, digits=digits)


def prefix_search(terms: DataFrame, lists: DataFrame, limit: int, least: int = 2, most: int = 12, digits: int = 9) -> DataFrame:
    """keyword_search_lists for the terms that prefix_terms would give, of which a query has as many as the vocabulary
    has under its stems: no row is made for one.

    A term belongs to the longest stem that begins it, and so to the queries of that stem and of those that begin this
    one. Lists are read once to count the distinct terms under each stem and once to be scored."""
    by_query = terms.select("query_id", F.substring(tx.stem(F.col("word")), 1, most).alias("stem")).groupBy("query_id").agg(F.collect_set("stem").alias("stems")).orderBy("query_id")
    out = None
    for block, columns in _blocks(by_query):
        own = np.zeros((len(block), len(columns)))
        for k, (_, stems) in enumerate(block):
            own[k, [columns[t] for t in stems]] = 1.0
        asked = own.copy()
        for stem, k in columns.items():
            for shorter in (columns.get(stem[:n]) for n in range(least, len(stem))):
                if shorter is not None:
                    np.maximum(asked[:, k], own[:, shorter], out=asked[:, k])
        place = partial(_under, least=least, most=most)
        counts = np.zeros(len(columns))
        for r in _terms_under(lists, list(columns), place).distinct().groupBy("place").count().collect():
            counts[r["place"]] = r["count"]
        n = asked @ counts
        matrix = asked * (0.1 / RANK_LIMIT / np.maximum(n, 1))[:, None]
        part = _scan(terms, lists, [q for q, _ in block], list(columns), matrix, place, limit, digits)
        out = part if out is None else out.unionByName(part)
    return top(out, limit) if out is not None else keyword_search(terms, posted(lists), limit, digits=digits)


def _blocks(by_query: DataFrame):
    """Queries with their terms, as many at a time as BLOCK_ENTRIES allows, and the number of each term there."""
    block, columns = [], {}
    for r in by_query.toLocalIterator():
        new = {t for t in r[1] if t not in columns}
        if block and (len(block) + 1) * (len(columns) + len(new)) > BLOCK_ENTRIES:
            yield block, columns
            block, columns = [], {}
        for t in r[1]:
            columns.setdefault(t, len(columns))
        block.append((r[0], r[1]))
    if block:
        yield block, columns


def _numbered(terms, names):
    """The number of each term among names, -1 if it is not there."""
    return np.array(pc.index_in(terms, names).fill_null(-1))


def _under(terms, names, least: int, most: int):
    """The number of the longest name that begins each term; one of fewer than `least` characters is a term of its own."""
    length = pc.utf8_length(terms)
    place = np.array(pc.index_in(pc.if_else(pc.less(length, least), terms, None), names).fill_null(-1))
    for n in range(least, most + 1):
        longer = np.array(pc.index_in(pc.if_else(pc.greater_equal(length, n), pc.utf8_slice_codeunits(terms, 0, n), None), names).fill_null(-1))
        place = np.where(longer >= 0, longer, place)
    return place


def _terms_under(lists: DataFrame, names: list, place: Callable) -> DataFrame:
    """term, place: the lists' terms that have a place among names, once a batch."""
    shared = lists.sparkSession.sparkContext.broadcast(names)

    def work(batches):
        import pyarrow as pa

        known = pa.array(shared.value, pa.string())
        for batch in batches:
            terms = batch.column(0).flatten().unique()
            at = place(terms, known)
            yield pa.RecordBatch.from_arrays([terms.filter(pa.array(at >= 0)), pa.array(at[at >= 0].astype(np.int32))], names=["term", "place"])

    return lists.select("terms").mapInArrow(work, "term string, place int")


def _scan(terms: DataFrame, lists: DataFrame, ids: list, names: list, matrix: np.ndarray, place: Callable, limit: int, digits: int) -> DataFrame:
    """query_id, chunk_id, score: each task's best `limit` of its lists for every query of the matrix (ids by names).

    place: terms, names -> the number of the name that each term counts for, -1 if for none."""
    spark, kind, key = lists.sparkSession, dict(lists.dtypes)["chunk_id"], dict(terms.dtypes)["query_id"]
    shared = spark.sparkContext.broadcast((ids, names, matrix))

    def work(batches):
        import pyarrow as pa

        ids, names, q = shared.value
        names = pa.array(names, pa.string())
        half = np.concatenate([[0.0], np.cumsum([1.0 / (j * j) for j in range(1, 257)])])
        best = [(np.zeros(0), []) for _ in ids]
        floor = np.zeros(len(ids))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                n, lists, tfs = some.num_rows, some.column(1), some.column(2)
                coded = lists.flatten().dictionary_encode()
                at = place(coded.dictionary, names)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
                asked = at >= 0
                row, at = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))[asked], at[asked]
                h = half[np.minimum(tfs.flatten().to_numpy()[asked], 256)]
                present, column = np.unique(at, return_inverse=True)
                x = np.bincount(row * len(present) + column, h, n * len(present)).reshape(n, len(present))
                raw = q[:, present] @ x.T
                s = np.round(raw, digits)
                hit = (raw > 0) & (s >= floor[:, None])
                chunk_ids = some.column(0).to_pylist() if hit.any() else []
                for k in np.flatnonzero(hit.any(1)).tolist():
                    at = np.flatnonzero(hit[k])
                    if len(at) > limit:
                        v = s[k, at]
                        at = at[v >= np.partition(v, len(v) - limit)[len(v) - limit]]
                    old, held = best[k]
                    v, held = np.concatenate([old, s[k, at]]), [*held, *(chunk_ids[i] for i in at.tolist())]
                    keep = sorted(range(len(held)), key=lambda i: (-v[i], held[i]))[:limit]
                    best[k] = v[keep], [held[i] for i in keep]
                    if len(keep) == limit:
                        floor[k] = v[keep[-1]]
        query = [i for i, (_, held) in zip(ids, best) for _ in held]
        found = [c for _, held in best for c in held]
        kinds = pa.string() if key == "string" else pa.int64(), pa.string() if kind == "string" else pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(query, kinds[0]), pa.array(found, kinds[1]), pa.array(np.concatenate([v for v, _ in best]))], names=["query_id", "chunk_id", "score"])

    return lists.mapInArrow(work, f"query_id {'string' if key == 'string' else 'bigint'}, chunk_id {'string' if kind == 'string' else 'bigint'}, score double")


def bm25(terms: DataFrame, post: DataFrame, limit: int, k1: float = 1.2, b: float = 0.75, digits: int = 9) -> DataFrame:
    t = terms.select("query_id", "term").distinct()
    lengths = post.groupBy("chunk_id").agg(F.sum("tf").alias("len"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.greatest("len", F.lit(1)) / F.col("avgdl")))
    hits = post.join(t, "term").join(df, "term").join(lengths, "chunk_id").join(F.broadcast(stats))
    return top(hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), digits).alias("score")), limit)


def prefix_terms(terms: DataFrame, post: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """Each query word's stem expands to the indexed terms that start with it; a one-letter stem stays exact."""
    stems = terms.select("query_id", F.substring(tx.stem(F.col("word")), 1, most).alias("stem")).distinct()
    indexed = post.select("term").distinct()
    #: An equi-join on the first two characters keeps the prefix test off a nested loop.
    wide = stems.withColumn("head", F.substring("stem", 1, least)).join(indexed.withColumn("head", F.substring("term", 1, least)), "head")
    return wide.filter(F.when(F.length("stem") < least, F.col("term") == F.col("stem")).otherwise(F.col("term").startswith(F.col("stem")))).select("query_id", "term").distinct()


def with_expansion(post: DataFrame, extra: DataFrame) -> DataFrame:
    """Extra index terms of chunks (chunk_id, term); content and vectors are untouched."""
    return post.unionByName(extra.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))).groupBy("chunk_id", "term").agg(F.sum("tf").alias("tf"))
