"""Faults that the third round's review found."""

import random
import re

from docweave.llm import lm_score
from docweave.operators import chunking, citations, context, fusion, hierarchy, ranked, sparse, workflow
from docweave.plans import search_plans


def test_references_of_one_place_are_numbered_alike_however_rows_are_dealt(spark):
    rows = [(run, 2, 50_000, "rag", ref) for run in range(200) for ref in (2, 0, 1)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        items = spark.createDataFrame(rows, "run_id long, node_no long, pos long, source_type string, ref long")
        assert {(r.ref, r.at) for r in workflow.merge_evidence(items).collect()} == {(0, 1), (1, 2), (2, 3)}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_document_s_texts_are_counted_once_each():
    asked = []

    def count(text):
        asked.append(text)
        return chunking.approximate_tokens(text)

    texts = ["제1조(목적) 이 조의 사항을 정한다.", "① 제2조에 따른다.", "② 「법」 제1조를 준용한다.", "제2조(정의) 이 조의 사항을 정한다."]
    blocks = [{"doc_id": 1, "block_no": k, "text": t, "block_type": "paragraph"} for k, t in enumerate(texts)]
    assert len(hierarchy.hierarchical(blocks, citations.resolve_scheme({"preset": "korean_legal"}), 1300, 1000, count=count)) == 4
    assert len(asked) == len(set(asked))


def test_tokens_are_four_letters_of_a_word_or_a_mark():
    r = random.Random(4)
    for text in ["", "_", "__ab_c d_e", "a_b", *("".join(r.choice("abcde0_1 \n.,é가²½_\u0301①") for _ in range(r.randrange(40))) for _ in range(5000))]:
        assert chunking.approximate_tokens(text) == sum(-(-len(w) // 4) if w[0].isalnum() else 1 for w in re.findall(r"\w+|[^\w\s]", text))


def test_rankings_are_fused_where_their_query_is(spark, data):
    plan = fusion.reciprocal_rank_fusion(search_plans._arms(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_every_word_teaches_in_one_round(spark):
    texts = [" ".join(f"w{d}x{k}" for k in range(n)) for d, n in enumerate([0, 1, 15, 16, 17, 400, 33, 2000])]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    parts = [lm_score.taught(rows, 3, k).collect() for k in range(3)]
    assert all(parts) and sorted(w for part in parts for r in part for w in r.words.split()) == sorted(w.encode() for t in texts for w in t.split())
    assert sum(r.last for part in parts for r in part) == len(texts)
    assert lm_score.taught(rows, 3).count() == sum(map(len, parts))


def test_the_mixture_is_weighed_by_every_id_that_teaches(spark):
    """One pass does both: an id is met before it is learnt from, and each is counted once in one round."""
    import numpy as np
    import public_tokenizers

    from docweave.llm.bpe import read_ranks

    ranks = spark.sparkContext.broadcast(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    lexicon = lm_score.Lexicon(ranks.value)
    texts = [" ".join(f"w{d}x{k}" for k in range(n)) for d, n in enumerate([0, 1, 15, 16, 17, 400, 33, 2000])]
    every = np.concatenate([lexicon.subwords(lexicon.numbers([*t.encode().split(), b""]))[0] for t in texts])
    counts = np.bincount(every, minlength=lexicon.size)
    empty = np.zeros(0, dtype=np.uint64)
    table, model = lm_score.Continuations(lexicon.size, empty, empty, np.zeros(0), np.ones(0)), lm_score.start([], counts)
    rows, tallies = spark.createDataFrame([(t,) for t in texts], "text string"), []
    for k in range(3):
        model, told = lm_score.learn(lm_score.taught(rows, 3, k), model, table, model.shares(counts), ranks, 2, k)
        tallies.append(told)
    assert all(t.sum() for t in tallies) and sum(t.sum() for t in tallies) == len(every)
    assert (sum(tallies).sum(axis=0) > 0).sum() == 1  # without counts, attention has the whole mass: one ratio


def test_a_task_s_share_of_the_index_does_not_grow_with_it(spark, tmp_path, monkeypatch):
    """Blocks that end in another Arrow batch than they began in count as one."""
    r = random.Random(6)
    chunks = spark.createDataFrame([(f"c{k}", " ".join("".join(r.choice("abcd") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(30)))) for k in range(300)], "chunk_id string, content string")
    terms = sparse.query_terms(spark.createDataFrame([(q, " ".join("".join(r.choice("abcd") for _ in range(4)) for _ in range(3))) for q in range(9)], "query_id long, text string"))
    post = sparse.postings(chunks)
    index = ranked.BlockIndex.build(post, f"{tmp_path}/index", block=16)
    monkeypatch.setattr(ranked, "SHARE", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        weights = index._idf(terms)
        assert index._found(weights, 5, ranked.bm25_cell(1.2, 0.75), 9).rdd.getNumPartitions() > 10
        for got, want in ((index.bm25(terms, 5), sparse.bm25(terms, post, 5)), (index.keyword_search(terms, 5), sparse.keyword_search(terms, post, 5))):
            assert sorted(map(tuple, got.select("query_id", "chunk_id", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "chunk_id", "score", "rank").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_joined_chunk_s_tokens_are_counted_once():
    asked = []

    def count(text):
        asked.append(text)
        return len(text)

    rows = [{"content": c, "similarity": s, "embedding": [1.0]} for c, s in (("a", None), ("b", 0.8), ("c", 0.9), ("d", 0.1))]
    merged = chunking.semantic_merge(rows, 0.75, 100, 100, count)
    assert [(m["content"], m.get("counted")) for m in merged] == [("a\nb\nc", 5), ("d", None)] and asked == ["a\nb", "a\nb\nc"]


def test_new_words_are_encoded_in_one_call_each_as_by_itself():
    import public_tokenizers
    import tiktoken

    from docweave.llm.bpe import read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    alone = tiktoken.Encoding("alone", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    lexicon, calls = lm_score.Lexicon(ranks), []
    encode = lexicon._encode
    lexicon._encode = lambda text: calls.append(text) or encode(text)
    r = random.Random(5)
    words = ["".join(r.choice("abeinrst0.,é가 　\u0085​\x1c\x00") for _ in range(r.randrange(1, 12))).encode() for _ in range(2000)]
    for some in ([b""], words[:300], [words[0], b"", words[300], b""], words, [b"z" * 3000], []):
        before = len(calls)
        numbers = lexicon.numbers(some)
        ids, n = lexicon.subwords(numbers)
        assert len(calls) - before <= 1
        want = [alone.encode_ordinary(f" {w.decode()}") if w else [lexicon.size - 1] for w in some]
        assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_what_is_delivered_is_read_once_for_its_section_heads(spark):
    chunks = spark.createDataFrame([(d, k, f"{d}-{k}", f"s{k // 3}" if k < 6 else None) for d in (1, 2) for k in range(8)], "doc_id long, chunk_index int, chunk_id string, section string")
    asked = [(1, "1-1"), (1, "1-2"), (1, "1-5"), (1, "1-3"), (2, "1-5"), (2, "2-0"), (2, "1-7"), (None, "2-2"), (None, "2-0")]
    found = spark.createDataFrame(asked, "query_id long, chunk_id string").join(chunks.select("chunk_id", "doc_id", "section"), "chunk_id")
    found = found.mapInArrow(lambda batches: batches, found.schema)
    heads = context.section_heads(found, chunks)
    assert sorted(map(tuple, heads.collect()), key=str) == sorted([(1, "1-1", "1-0"), (1, "1-2", "1-0"), (2, "1-5", "1-3"), (None, "2-2", "2-0")], key=str)
    assert heads._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
