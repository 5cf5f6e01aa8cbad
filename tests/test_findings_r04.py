"""Faults that the fourth round's review found."""

import random

import numpy as np
from pyspark.sql import functions as F

from docweave.operators import citations, dense, edges, sparse
from docweave.plans import base, more_plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_scored_by_pages(spark):
    """No row is made of a pair of a query and a vector; what is found is what a plain scan of the probed cells finds."""
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 8)).round(1)
    x[5], x[7] = 0, x[6]
    corpus = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(-1, None)], "item long, embedding array<float>")
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x[::100])] + [(99, None), (98, [0.0] * 8)], "query_id long, embedding array<float>")
    index = dense.InvertedFile(corpus, cells=9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        near = index.search(queries, 10, probes=4)
        assert "Join [" not in plan_of(near).replace("NestedLoopJoin", "")  # queries meet pages, not vectors
        found = {(a.query_id, a["rank"]): (a.item, a.score) for a in near.collect()}
        cell = {a.item: a.cell for a in index.table.collect()}
        assert index.table.count() == 3000
        for n, v in [*enumerate(x[::100].astype(np.float32)), (98, np.zeros(8))]:
            probed = set(np.argsort(-(v.astype(float) @ index.centres.T), kind="stable")[:4].tolist())
            own = [k for k in range(3000) if cell[k] in probed]
            score = np.round(dense.unit(x[own].astype(np.float32).astype(float)) @ dense.unit(v.astype(float)[None])[0], 9)
            want = sorted(zip(-score, own))[:10]
            assert [found[n, k + 1][0] for k in range(10)] == [i for _, i in want] and np.allclose([found[n, k + 1][1] for k in range(10)], [-s for s, _ in want])
        assert len(found) == 310
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_prefixes_are_searched_without_a_row_for_each_term(spark, monkeypatch):
    """A term counts once for a query however many of its stems begin it; a stem of one letter is exact."""
    r = random.Random(2)
    words = [w + t for w in ("a", "ab", "abc", "b", "bca", "가나", "가나다", "x1") for t in ("", "c", "ca", "은", "에서", "0" * 14)]
    chunks = spark.createDataFrame([(f"c{k}", " ".join(r.choice(words) for _ in range(r.randrange(12)))) for k in range(1500)], "chunk_id string, content string")
    queries = spark.createDataFrame([(q, " ".join(r.choice(words) for _ in range(r.randrange(6)))) for q in range(40)] + [(90, "ab abc a 가나다은"), (91, "none"), (92, "the")], "query_id long, text string")
    terms, lists = sparse.without_stop_words(sparse.query_terms(queries, "simple")), sparse.counted(chunks, "simple")
    for entries in (4_000_000, 60):
        monkeypatch.setattr(sparse, "BLOCK_ENTRIES", entries)
        found = sparse.prefix_search(terms, lists, 7)
        want = sparse.keyword_search(sparse.prefix_terms(terms, lists.select(F.explode("terms").alias("term"))), sparse.posted(lists), 7)
        assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0 and found.count() > 200
    none = sparse.prefix_search(terms.filter("false"), lists, 7)
    assert none.columns == found.columns and none.count() == 0


def test_a_larger_vocabulary_is_not_scanned_more_often(spark, data, monkeypatch):
    """What is broadcast follows the queries' stems: with room for these alone, the lists are scored once."""
    stems = sparse.without_stop_words(sparse.query_terms(base.queries(spark, data), "simple")).select(sparse.tx.stem(F.col("word"))).distinct().count()
    monkeypatch.setattr(sparse, "BLOCK_ENTRIES", stems * base.queries(spark, data).count())
    assert plan_of(more_plans.d14_prefix_search(spark, data)).count("MapInArrow") == 1


def test_citations_and_chunks_of_edges_are_computed_once(spark, data):
    """A plan of edges reads tables: neither the chunking nor the search for citations stands in it."""
    for query in (more_plans.g5_build_edges, more_plans.g11_attach):
        plan = plan_of(query(spark, data))
        assert plan.count("MapInArrow") == (query is more_plans.g11_attach)  # the fold over what is delivered
    rows = spark.createDataFrame([(1, "a", "조1", "제2조에 따른다."), (1, "b", "조2", "제2조에 따른다."), (2, "c", None, None), (2, "d", "조3/항1", "제2항에 따른다.")], "doc_id long, chunk_id string, path string, content string")
    rows = edges.citation_rows(rows.coalesce(1), citations.resolve_scheme({"preset": "korean_legal"}))
    assert {tuple(r) for r in rows.collect()} == {(1, "a", "제2조", None, "조2"), (1, "b", "제2조", None, "조2"), (2, "d", "제2항", None, "조3/항2")}


def test_vectors_of_texts_need_no_stored_counts(spark, data, tmp_path):
    (tmp_path / "documents.parquet").symlink_to(f"{data}/documents.parquet")
    d = str(tmp_path)
    vectors, graph = base.chunk_vectors(spark, d), base.chunk_graph(spark, d)
    assert not base.has_stored(spark, d, "postings") and base.has_stored(spark, d, "vectors")
    want = dense.hashed_vectors(sparse.postings(base.chunks(spark, d))).withColumnRenamed("chunk_id", "item")
    assert vectors.exceptAll(want).count() == want.exceptAll(vectors).count() == 0 and graph.vectors().count() == vectors.count() > 0
    same = spark.createDataFrame([("a", "ab abc"), ("a", "ab"), ("b", "- "), ("c", None), (None, "가나")], "chunk_id string, content string")
    found, want = dense.hashed_texts(same), dense.hashed_vectors(sparse.postings(same))
    assert found.count() == 2 and found.exceptAll(want).count() == want.exceptAll(found).count() == 0


def test_pairs_of_any_alphabet():
    """Words are read from their buffer, wherever it begins; pairs are numbered by a table or sorted."""
    import pyarrow as pa

    r = random.Random(1)
    for letters in ("abc", "\U0001d4b3\U0001d4b4a", "".join(map(chr, range(0xAC00, 0xAC00 + 3000)))):
        for n in (0, 1, 400):
            words = ["".join(r.choice(letters) for _ in range(r.randrange(1, 6))) for _ in range(n)]
            for given in (pa.array(words, pa.string()), pa.array(["x", "가", *words], pa.string()).slice(2)):
                names, flat, sizes = sparse._pairs(given)
                ends = np.cumsum(sizes)
                cut = [[names[j].as_py() for j in flat[e - k : e]] for e, k in zip(ends, sizes)]
                assert cut == [[w[i : i + 2] for i in range(len(w) - 1)] or [w] for w in words]
