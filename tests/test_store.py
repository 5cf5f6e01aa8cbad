"""Collections as stored tables: indexing twice, documents that go, citations that are resolved late, semantic joining."""

import pytest
from pyspark.sql import functions as F

from docweave.operators.store import Collection

DOCS = "doc_id long, filename string, text string"


#: A lambda, as workers cannot import this module.
embed = lambda texts: [(k, [float(len(t)), float(t.count("a")), 1.0]) for k, t in enumerate(texts)]


def state(c):
    return sorted(map(tuple, c.chunks.read().drop("embedding").collect()), key=repr), sorted(map(tuple, c.edges.read().collect()), key=repr)


def test_laws_are_indexed_replaced_and_linked(spark, tmp_path):
    one = [(1, "법1.pdf", "제1조(목적) 이 조의 사항을 정한다.\n제2조(준용) 「법2」 제1조를 준용한다.\n제3조(끝) 제2조에 따른다.")]
    two = [(2, "법2.pdf", "제1조(정의) 이 법에서 쓰는 말이다.\n제2조(적용) 제1조에 따른다."), (3, "c.txt", None)]
    told = spark.createDataFrame([(d, "reference_dependent") for d in (1, 2)], "doc_id long, override string")
    config = {"strategy": "hierarchical", "preset": "korean_legal"}
    c = Collection(spark, f"{tmp_path}/laws", config)
    for _ in range(2):
        c.index(spark.createDataFrame(one, DOCS), embed, 3, overrides=told)
    first = state(c)
    assert {r[0] for r in first[0]} == {1} and all(r.embedding[0] == len(r.content) for r in c.chunks.read().collect())
    assert {e.target: e.dst for e in c.edges.read().filter("kind = 'ref'").collect()}["법2#조1"] is None
    c.index(spark.createDataFrame(two, DOCS), embed, 3, overrides=told)
    c.relink()
    late = {(e.src, e.target): e.dst for e in c.edges.read().filter("kind = 'ref' AND doc_id = 1").collect()}
    opened = {(r.doc_id, r.path): r.chunk_id for r in c.chunks.read().collect()}
    assert late[(opened[1, "조2"], "법2#조1")] == opened[2, "조1"] and late[(opened[1, "조3"], "조2")] == opened[1, "조2"]
    again = Collection(spark, f"{tmp_path}/laws", config)
    before = state(again)
    again.relink()
    assert state(again) == before
    again.index(spark.createDataFrame([(1, "법1.pdf", "")], DOCS), embed, 3, overrides=told)
    again.remove(spark.createDataFrame([(2,)], "doc_id long"))
    assert state(again) == ([], [])


def test_semantic_joining_between_two_embeddings(spark, tmp_path):
    text = "\n\n".join(["aaa " * 30, "aaa " * 31, "zzz " * 200, "a" * 40])
    docs = spark.createDataFrame([(1, "a.txt", text), (2, "b.txt", "one")], DOCS)
    c = Collection(spark, f"{tmp_path}/s", {"strategy": "semantic"})
    c.index(docs, lambda texts: [(k, [float("z" in t), float("a" in t)]) for k, t in enumerate(texts)], 2, target_chars=150, overlap=0)
    rows = c.chunks.read().orderBy("doc_id", "chunk_index").collect()
    assert [r.doc_id for r in rows].count(2) == 1 and all(len(r.embedding) == 2 and r.strategy == "semantic" for r in rows)
    assert c.edges.read().count() == 0 and len({r.chunk_id for r in rows}) == len(rows)
    size = Collection(spark, f"{tmp_path}/size", None)
    size.index(docs, embed, 3, target_chars=150, overlap=0)
    assert size.chunks.read().filter(F.col("doc_id") == 1).count() >= len(rows) - 1
    with pytest.raises(ValueError):
        Collection(spark, f"{tmp_path}/x", {"strategy": "sniff"})
