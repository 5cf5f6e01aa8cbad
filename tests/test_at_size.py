"""What keeps queries in their limits on large tables: few exchanges, little that is stored, no copy of a table in a broadcast."""

import glob
import random

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import catalog, dense, sparse
from docweave.plans import base, catalog_plans
from docweave.sources import page_geometry
from docweave.sources.keyed_table import KeyedTable


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_dealt_by_document_stay_there(spark):
    rows = [(1, p, f"w{k}", 50.0 * k, 50.0 * k + 20, 20.0 + 12 * (k % 3), 10.0, False) for p in range(3) for k in range(9)]
    words = spark.createDataFrame(rows, "doc_id long, page long, word string, x0 double, x1 double, top double, size double, bold boolean")
    assert plan_of(page_geometry.page_lines(words.repartition(3, "doc_id"))).count("Exchange") == 1
    assert page_geometry.page_lines(words.repartition(3, "doc_id")).count() == 27  # gaps of 30 make nearly every word a column


def test_terms_are_counted_where_the_chunk_is(spark):
    r = random.Random(3)
    texts = [(f"c{k % 1500}", " ".join(r.choice(["a", "ab", "Abc", "가나다", "x1y2", "-", "I", "zz"]) for _ in range(r.randrange(9)))) for k in range(2600)]
    chunks = spark.createDataFrame([*texts, ("none", None), (None, "ab abc"), (None, "ab")], "chunk_id string, content string")
    for name in ("simple", "bigram"):
        found = sparse.postings(chunks, name)
        want = chunks.select("chunk_id", F.explode(tx.tokens(F.col("content"), name)).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
        assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0 and found.schema["tf"].dataType == want.schema["tf"].dataType
        assert plan_of(found).count("Exchange") == 1


def test_lists_are_scored_where_they_are(spark):
    r = random.Random(5)
    chunks = spark.createDataFrame([(f"c{k}", " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randrange(12)))) for k in range(1300)], "chunk_id string, content string")
    terms = sparse.query_terms(spark.createDataFrame([(1, "ax by cz"), (2, "hx ax"), (3, "none")], "query_id long, text string"), "simple")
    lists = sparse.counted(chunks, "simple")
    found, want = sparse.keyword_search_lists(terms, lists, 7), sparse.keyword_search(terms, sparse.posted(lists), 7)
    assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0 and found.count() == 14
    near, all_ = dense.hashed_lists(lists), dense.hashed_vectors(sparse.posted(lists))
    assert near.exceptAll(all_).count() == all_.exceptAll(near).count() == 0
    assert plan_of(near).count("Exchange") == 1


def test_paths_are_not_broadcast(spark):
    plans = []
    folders = spark.createDataFrame([(k, k - 1 if k > 1 else None, f"f{k}") for k in range(1, 12)], "id long, parent_id long, name string")
    found = catalog.folder_paths(folders, lambda rows: (plans.append(plan_of(rows)), rows.localCheckpoint())[1])
    assert {(r.id, r.path, r.depth) for r in found.collect()} == {(k, "/" + "".join(f"f{i}/" for i in range(1, k + 1)), k) for k in range(1, 12)}
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans[1:])


def test_one_lookup_stores_no_index(spark, data):
    catalog_plans.j22_table_lookup(spark, data).collect()
    assert not any(name == "trigrams" and d == data for _, d, name in base._STORED)


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 50).alias("g"), F.col("id").alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        KeyedTable.create(rows, f"{tmp_path}/t", ["g", "k"], ["g"], buckets=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{tmp_path}/t/data/*/*/*.parquet")) > 1
