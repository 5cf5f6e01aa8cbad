"""Stored indexes and tables against plain versions: block-max search, graphs, single-scan search, trigrams, keyed tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import catalog, chunking, dense, metrics, ranked, small_world, sparse, trigrams
from docweave.sources import page_geometry
from docweave.sources.keyed_table import Conflict, KeyedTable


def rows_of(df, *order):
    return sorted((tuple(r) for r in df.select(*order).collect()), key=repr)


# --- keyword search over blocks --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    chunks = [(f"c{k:03d}", " ".join(r.choice(words[: r.choice([5, 20, 60])]) for _ in range(r.randint(1, 40)))) for k in range(300)]
    chunks += [("same1", "w1 w2"), ("same2", "w1 w2"), ("é", "w1 w2 w2"), ("none", "...")]
    queries = [(q, " ".join(r.choice(words) for _ in range(r.randint(1, 8)))) for q in range(40)] + [(98, "w1 w2"), (99, "nowhere"), (100, "")]
    post = sparse.postings(spark.createDataFrame(chunks, "chunk_id string, content string"), "simple").cache()
    return post, sparse.query_terms(spark.createDataFrame(queries, "query_id long, text string"), "simple").cache()


@pytest.mark.parametrize("block", [1, 7, 128])
def test_block_search_equals_the_joins(spark, corpus, tmp_path, block, monkeypatch):
    monkeypatch.setattr(ranked, "QUERIES", 15)
    post, terms = corpus
    index = ranked.BlockIndex.build(post, f"{tmp_path}/index", block=block)
    columns = ("query_id", "chunk_id", "score", "rank")
    assert rows_of(index.keyword_search(terms, 6), *columns) == rows_of(sparse.keyword_search(terms, post, 6), *columns)
    assert rows_of(index.bm25(terms, 6), *columns) == rows_of(sparse.bm25(terms, post, 6), *columns)
    report = {r.query_id: r for r in index.report(terms, 6).collect()}
    assert all(r.scored_blocks <= r.blocks and r.scored_postings <= r.postings for r in report.values())
    matched = terms.join(post, "term").groupBy("query_id").agg(F.count("*").alias("n")).collect()
    assert {q.query_id: q.n for q in matched} == {q: r.postings for q, r in report.items()}
    if block == 1:
        assert sum(r.scored_blocks for r in report.values()) < 0.9 * sum(r.blocks for r in report.values())
    assert rows_of(index.terms(), "term", "df") == rows_of(post.groupBy("term").agg(F.count("*").alias("df")), "term", "df")


def test_block_index_of_nothing(spark, corpus, tmp_path):
    post, terms = corpus
    index = ranked.BlockIndex.build(post.limit(0), f"{tmp_path}/index")
    assert index.bm25(terms, 3).collect() == [] and index.keyword_search(terms, 3).collect() == []
    full = ranked.BlockIndex.build(post, f"{tmp_path}/full")
    assert full.bm25(terms.limit(0), 3).collect() == []


# --- vectors ---------------------------------------------------------------------------------------------


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "item long, embedding array<double>").repartition(3)


def plain_nearest(x, q, k):
    s = np.round(dense.unit(q) @ dense.unit(x).T, 9)
    return sorted((i, int(j), float(row[j]), r + 1) for i, row in enumerate(s) for r, j in enumerate(np.lexsort((np.arange(len(x)), -row))[:k]))


@pytest.mark.parametrize("bounds", [(4_000_000, 64_000_000, 256_000_000), (300, 64_000_000, 256_000_000), (300, 0, 600)])
def test_one_scan_equals_a_matrix(spark, monkeypatch, bounds):
    for name, value in zip(("BLOCK_BYTES", "BROADCAST_BYTES", "HELD_BYTES"), bounds):
        monkeypatch.setattr(dense, name, value)
    r = np.random.default_rng(1)
    x, q = r.integers(-2, 3, (90, 4)).astype(float), r.integers(-2, 3, (23, 4)).astype(float)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(77, None)], "query_id long, embedding array<double>")
    corpus = vectors(spark, x).unionByName(spark.createDataFrame([(500, None)], "item long, embedding array<double>"))
    assert sorted(map(tuple, dense.nearest(asked, corpus, 5).select("query_id", "item", "score", "rank").collect())) == plain_nearest(x, q, 5)
    assert dense.nearest(asked.filter("embedding IS NULL"), corpus, 5).collect() == []
    assert dense.nearest(asked, corpus.limit(0), 5).collect() == []


def test_the_corpus_is_scanned_once(spark, data, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_BYTES", 20_000)
    e = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("item"), "embedding")
    found = dense.nearest(e.select(F.col("item").alias("query_id"), "embedding"), e, 3)
    assert found.filter("rank = 1 AND item <> query_id").count() == 0
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 2  # the queries and the corpus, for thirteen blocks of queries


def test_graph_search_finds_most_and_scores_few(spark, tmp_path):
    r = np.random.default_rng(2)
    centres = r.standard_normal((40, 32))
    x = centres[r.integers(0, 40, 12_000)] + 0.6 * r.standard_normal((12_000, 32))
    index = small_world.GraphIndex.build(vectors(spark, x[:9000]), f"{tmp_path}/graph", page_rows=9000)
    index.append(vectors(spark, x[9000:], 9000), page_rows=9000)
    q = x[::200] + 0.05 * r.standard_normal((60, 32))
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    found = index.search(asked, 10).cache()
    exact = {(a, b) for a, b, _, _ in plain_nearest(x, q, 10)}
    assert len(exact & {(f.query_id, f.item) for f in found.collect()}) >= 0.95 * len(exact)
    assert found.agg(F.max("scored")).first()[0] <= 0.1 * len(x)
    assert index.vectors().count() == 12_000 and index.pages().count() == 2
    edges = index.adjacency()
    assert edges.filter("item = neighbour").count() == 0 and edges.groupBy("page", "item").count().agg(F.max("count")).first()[0] <= 2 * small_world.LINKS
    assert index.compacted(f"{tmp_path}/again", page_rows=12_000).pages().count() == 1


def test_a_wide_walk_is_exact_and_edge_cases_have_results(spark, tmp_path):
    x = np.array([[1.0, 0], [1.0, 0], [0, 1.0], [-1.0, 0], [0, 0], [1.0, 1.0]])
    given = vectors(spark, x).unionByName(spark.createDataFrame([(70, None)], "item long, embedding array<double>"))
    asked = spark.createDataFrame([(0, [1.0, 0.1]), (1, None)], "query_id long, embedding array<double>")
    index = small_world.GraphIndex.build(given, f"{tmp_path}/g")
    got = sorted(map(tuple, index.search(asked, 6, ef=64).select("query_id", "item", "score", "rank").collect()))
    assert got == plain_nearest(x, np.array([[1.0, 0.1]]), 6)
    assert small_world.GraphIndex.build(given.filter("item = 70"), f"{tmp_path}/none").search(asked, 3).collect() == []
    one = small_world.GraphIndex.build(given.filter("item = 2"), f"{tmp_path}/one").search(asked, 3).collect()
    assert [(r.item, r.scored) for r in one] == [(2, 1)]
    twice = small_world.GraphIndex.build(given.filter("item = 2").union(given.filter("item = 2")), f"{tmp_path}/two").search(asked, 3).collect()
    assert [r.item for r in twice] == [2, 2]


# --- trigrams --------------------------------------------------------------------------------------------


def test_candidates_hold_every_match(spark, tmp_path):
    r = random.Random(6)
    texts = [(i, "".join(r.choice("abcÄé😀 \n") for _ in range(r.randint(0, 60)))) for i in range(150)] + [(900, None), (901, "")]
    cut = [t[k : k + n] for _, t in texts[:60] if t for k, n in [(r.randrange(len(t)), r.randint(1, 9))]]
    patterns = [(k, p) for k, p in enumerate([*cut, "", None, "zz", "abcabcabcabc"])]
    docs = spark.createDataFrame(texts, "chunk_id long, content string")
    asked = spark.createDataFrame(patterns, "pattern_id long, pattern string")
    index = trigrams.TrigramIndex.build(docs, f"{tmp_path}/t")
    low = lambda s: (s or "").lower()
    want = {(k, i) for k, p in patterns if p for i, t in texts if low(p) in low(t)}
    text_of, pattern_of = dict(texts), dict(patterns)
    for found in (index.candidates(asked), trigrams.candidates_in(docs, asked, "chunk_id", "content").withColumnRenamed("chunk_id", "item")):
        pairs = {(r.pattern_id, r.item) for r in found.collect()}
        assert {(k, i) for k, i in pairs if low(pattern_of[k]) in low(text_of[i])} == want
    for p in ("", "a", "Ab", "bcä", "zz", "ab\n"):
        held = {r.item for r in index.holding(p).collect()}
        assert {i for i, t in texts if p and low(p) in low(t)} <= held


def test_short_anchors_join_on_runs(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "two"), (2, "e"), (3, "TWO"), (4, None), (5, "wo th")], "query_id long, anchor string")
    found = metrics.anchor_places(docs, asked)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 4, 3), (1, 2, 2, 1), (1, 5, 5, 5), (2, 1, 0, 3)]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


# --- keyed tables ----------------------------------------------------------------------------------------


def test_a_keyed_table_rewrites_what_it_must(spark, tmp_path):
    rows = spark.createDataFrame([(d, k, f"{d}.{k}") for d in range(40) for k in range(3)] + [(None, 0, "null")], "doc long, k int, v string")
    table = KeyedTable.create(rows, f"{tmp_path}/t", ["doc", "k"], ["doc"], buckets=16)
    assert rows_of(table.read(), "doc", "k", "v") == rows_of(rows, "doc", "k", "v")
    before = table.manifest()["where"]
    new = spark.createDataFrame([(3, 1, "new"), (3, 9, "more"), (None, 0, "other")], "doc long, k int, v string")
    for _ in range(2):
        table.upsert(new)
    got = {(r.doc, r.k): r.v for r in table.read().collect()}
    want = {(r.doc, r.k): r.v for r in rows.collect()} | {(3, 1): "new", (3, 9): "more", (None, 0): "other"}
    assert got == want and len(got) == table.read().count()
    after = table.manifest()["where"]
    assert 1 <= sum(before.get(b) != n for b, n in after.items()) <= 2
    table.replace_groups(spark.createDataFrame([(5, 0, "whole")], "doc long, k int, v string"))
    table.delete_groups(spark.createDataFrame([(6,)], "doc long"))
    assert [tuple(r) for r in table.read().filter("doc IN (5, 6)").collect()] == [(5, 0, "whole")]
    assert table.versions() == [0, 1, 2, 3, 4] and rows_of(table.read(0), "doc", "k", "v") == rows_of(rows, "doc", "k", "v")
    assert rows_of(table.lookup(spark.createDataFrame([(7,), (None,), (99,)], "doc long")), "doc", "k", "v") == [(7, 0, "7.0"), (7, 1, "7.1"), (7, 2, "7.2"), (None, 0, "other")]
    table.vacuum()
    assert table.versions() == [4] and table.read().count() == len(want) - 3 - 2


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    table = KeyedTable.create(rows, f"{tmp_path}/t", ["id"], buckets=4)
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(3, "x"), (3, "y")], "id long, v string"))
    broken = spark.createDataFrame([(3, "x")], "id long, v string").withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken)
    assert table.versions() == [0] and rows_of(table.read(), "id", "v") == [(1, "a"), (2, "b")]
    head = table.manifest()
    table.upsert(spark.createDataFrame([(3, "c")], "id long, v string"))
    with pytest.raises(Conflict):
        table._publish(1, head)
    assert rows_of(table.read(), "id", "v") == [(1, "a"), (2, "b"), (3, "c")]
    none = KeyedTable.create(rows.limit(0), f"{tmp_path}/none", ["id"])
    assert none.read().collect() == [] and none.upsert(rows) == 1 and none.read().count() == 2


# --- folders ---------------------------------------------------------------------------------------------


def test_deep_folders_and_cycles(spark):
    chain = [(k, k - 1 if k else None, f"n{k}") for k in range(1000)]
    odd = [(2000, 2001, "a"), (2001, 2000, "b"), (2002, 2001, "under"), (2003, 2003, "self"), (2004, 77777, "lost"), (2005, 2004, "child")]
    folders = spark.createDataFrame(chain + odd, "id long, parent_id long, name string")
    got = {r.id: r for r in catalog.folder_paths(folders).collect()}
    assert set(got) == set(range(1000)) | {2004, 2005}
    assert got[999].depth == 1000 and got[999].path == "/" + "/".join(f"n{k}" for k in range(1000)) + "/"
    assert got[2005].path == "/lost/child/"
    assert {r.id for r in catalog.folder_cycles(folders).collect()} == {2000, 2001, 2002, 2003}
    assert catalog.folder_paths(folders.limit(0)).collect() == []


# --- pages and windows -----------------------------------------------------------------------------------


def plain_lines(words):
    """One page's lines, word by word."""
    buckets = []
    for w in sorted(words, key=lambda w: (w["column"], round(w["top"], 1), w["x0"])):
        for b in buckets:
            if b[0] == w["column"] and abs(b[1] - w["top"]) <= 2.5:
                b[2].append(w)
                break
        else:
            buckets.append((w["column"], w["top"], [w]))
    out = []
    for column, top, row in buckets:
        row.sort(key=lambda w: (w["x0"], w["x1"], w["word"]))
        text = "".join(("" if k == 0 or (w["x0"] - row[k - 1]["x1"] <= 3 and not w["blank"]) else " ") + w["word"] for k, w in enumerate(row))
        out.append((column, round(top / 10), text, max(w["size"] for w in row), any(w["bold"] for w in row)))
    return out


def test_lines_equal_a_walk_over_words(spark):
    r = random.Random(8)
    rows = []
    for page in range(25):
        top = 30.0
        for _ in range(12):
            top += r.choice([1.3, 2.4, 2.6, 4.0, 12.0])
            rows += [(1, page, f"w{r.randrange(99)}", x, x + r.choice([20.0, 26.0, 28.0]), top + r.choice([0.0, 0.7, 1.9]), r.choice([9.0, 12.0]), r.random() < 0.2, r.random() < 0.2) for x in r.sample([50.0, 80.0, 110.0, 300.0, 330.0], 3)]
    words = spark.createDataFrame(rows, "doc_id long, page long, word string, x0 double, x1 double, top double, size double, bold boolean, blank boolean")
    placed = [x.asDict() for x in page_geometry.in_columns(words).collect()]
    got = page_geometry.page_lines(words).orderBy("page", "line_no").collect()
    for page in range(25):
        want = plain_lines([w for w in placed if w["page"] == page])
        assert [(x.column, x.band, x.text, x.size, x.bold) for x in got if x.page == page] == want


def plain_windows(blocks, size, overlap, most):
    text = "\n".join(b["text"] or "" for b in blocks)
    starts, at = [], 0
    for b in blocks:
        starts.append(at)
        at += len(b["text"] or "") + 1
    out = []
    for s in range(0, len(text), size - overlap):
        piece = text[s : s + size]
        if piece.strip():
            parts = [piece] if most is None or chunking.approximate_tokens(piece) <= most else chunking.split_to_limit(piece, most, size)
            p = s
            for part in parts:
                while text[p].isspace():
                    p += 1
                b = blocks[max(k for k, x in enumerate(starts) if x <= p)]
                out.append((part, b["block_no"], b["page"], b["section"]))
                left = sum(not c.isspace() for c in part)
                while left:
                    left -= not text[p].isspace()
                    p += 1
        if s + size >= len(text):
            break
    return out


@pytest.mark.parametrize("most", [None, 3, 9])
def test_windows_know_their_blocks(spark, most):
    r = random.Random(most)
    docs = {d: [{"block_no": k, "text": "".join(r.choice("ab cé. 　\x1c!\t") for _ in range(r.randint(0, 30))), "page": k // 3, "section": f"s{k // 2}"} for k in range(r.randint(1, 14))] for d in range(25)}
    docs[90], docs[91] = [{"block_no": 0, "text": None, "page": None, "section": None}], [{"block_no": 3, "text": "x" * 90, "page": None, "section": None}]
    rows = [(d, b["block_no"], b["text"], b["page"], b["section"]) for d, bs in docs.items() for b in bs]
    r.shuffle(rows)
    got = chunking.fixed_blocks(spark.createDataFrame(rows, "doc_id long, block_no int, text string, page int, section string"), 40, 12, most).orderBy("doc_id", "chunk_index").collect()
    for d, bs in docs.items():
        own = [x for x in got if x.doc_id == d]
        assert [x.chunk_index for x in own] == list(range(len(own)))
        assert [(x.content, x.block_no, x.page, x.section) for x in own] == plain_windows(bs, 40, 12, most)
        assert most is None or all(x.tokens <= most or len(x.content) == 1 for x in own)
