"""Operators on small fixtures with known results."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import catalog, chunking, citations, context, dense, fusion, history, research, sparse, workflow
from docweave.sources import blocks, ledger


def rows_of(spark, rankings, k=60, weights=None):
    rows = [(0, n, p + 1, x, float((weights or [1.0] * len(rankings))[n])) for n, r in enumerate(rankings) for p, x in enumerate(r)]
    df = spark.createDataFrame(rows, "query_id int, ranking_no int, pos int, item string, weight double")
    return [(r.item, r.score) for r in fusion.reciprocal_rank_fusion(df, k).orderBy("rank").collect()]


def plain_rrf(rankings, k, weights=None):
    score, seen = {}, {}
    for n, r in enumerate(rankings):
        for p, x in enumerate(dict.fromkeys(r), 1):
            score[x] = score.get(x, 0.0) + (weights or [1.0] * len(rankings))[n] / (k + p)
            seen.setdefault(x, (n, p))
    return sorted(score.items(), key=lambda x: (-x[1], seen[x[0]]))


def test_fusion_known_values(spark):
    assert rows_of(spark, [["a", "b"]]) == [("a", 1 / 61), ("b", 1 / 62)]
    assert rows_of(spark, [["a", "b", "a", "c"]])[2] == ("c", 1 / 63)
    assert [x for x, _ in rows_of(spark, [["a", "b"], ["b", "a"]])] == ["a", "b"]
    assert [s for _, s in rows_of(spark, [["a", "b"]], k=0)] == [1.0, 0.5]
    assert rows_of(spark, []) == []
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion(None, -1)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=7), min_size=1, max_size=3), st.sampled_from([0, 1, 60]))
def test_fusion_equals_a_plain_model(spark, rankings, k):
    assert rows_of(spark, rankings, k) == plain_rrf(rankings, k)


def folded(spark, rankings, keys, k=60, cap=1):
    rows = [(0, n, p + 1, x, 1.0) for n, r in enumerate(rankings) for p, x in enumerate(r)]
    df = spark.createDataFrame(rows, "query_id int, ranking_no int, pos int, item string, weight double")
    kf = spark.createDataFrame(list(keys.items()) or [("?", "?")], "item string, grp string")
    return [(r.grp, r.item, r.score) for r in fusion.fuse_groups(df, kf, k, cap).orderBy("rank").collect()]


def test_folding(spark):
    assert [(g, s) for g, _, s in folded(spark, [["a", "b"], ["b", "c"]], {})] == plain_rrf([["a", "b"], ["b", "c"]], 60)
    third = folded(spark, [["x", "y", "z", "s1", "s2"]], {"s1": "g", "s2": "g"}, k=0, cap=2)
    assert [g for g, *_ in third][2] == "g" and round(third[2][2], 2) == 0.45
    assert folded(spark, [["x", "y", "a"], ["b"]], {"a": "g", "b": "g"})[0][:2] == ("g", "b")


def test_group_key_and_permutation(spark):
    row = spark.sql("SELECT 'd1' d, 'c' c").select(
        fusion.group_key(F.col("d"), F.col("c"), F.lit("hierarchical"), F.lit("조36/항1"), F.lit(None)).alias("a"),
        fusion.group_key(F.col("d"), F.col("c"), F.lit("hierarchical"), F.lit(""), F.lit("s")).alias("b"),
        fusion.parse_permutation(F.lit("[2, 0, 1]"), F.lit(3)).alias("p"),
        fusion.parse_permutation(F.lit("0 0 1"), F.lit(3)).alias("q"),
    ).first()
    assert (row.a, row.b, row.p, row.q) == ("d1#p:조36/항1", "c", [2, 0, 1], [0, 1, 2])


def test_tokens_and_korean(spark):
    row = spark.sql("SELECT '상표등록을 AB1 a 😀' t").select(tx.bigram_tokens(F.col("t")).alias("b"), tx.simple_tokens(F.col("t")).alias("s"), tx.stem(F.lit("공지예외주장은")).alias("x"), tx.stem(F.lit("은은")).alias("y"), tx.join_wrapped(F.lit("상표"), F.lit("등록")).alias("j"), tx.join_wrapped(F.lit("상표"), F.lit("A")).alias("k"), tx.readable_ratio(F.lit("(cid:1)(cid:2)ab")).alias("r")).first()
    assert row.b == ["상표", "표등", "등록", "록을", "ab", "b1", "a"] and row.s == ["상표등록을", "ab1", "a"]
    assert (row.x, row.y, row.j, row.k) == ("공지예외주장", "은은", "상표등록", "상표 A") and row.r == 0.5
    with pytest.raises(KeyError):
        tx.tokens(F.lit(""), "other")


def test_search_scopes_and_abstaining(spark):
    chunks = spark.createDataFrame([("a", "red fox fox"), ("b", "red hen"), ("c", "blue")], "chunk_id string, content string")
    post = sparse.postings(chunks, "simple")
    q = spark.createDataFrame([(1, "the red fox"), (2, "the of")], "query_id int, text string")
    terms = sparse.without_stop_words(sparse.query_terms(q, "simple"))
    got = sparse.keyword_search(terms, post, 5).collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, "a"), (1, "b")]
    assert round(got[1].score, 4) == round(0.0608 / 2, 4)
    assert sparse.keyword_search(terms, post, 5, chunks.limit(0)).count() == 0
    assert sparse.trim_common(terms, sparse.document_frequency(post, chunks), 0.4).select("term").collect()[0].term == "fox"


def test_nearest_orders_ties_by_item_and_skips_nulls(spark):
    corpus = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("n", None), ("z", [0.0, 0.0])], "item string, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert [(r.item, r.score) for r in dense.nearest(q, corpus, 3).orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0), ("z", 0.0)]


def test_chunk_folds():
    assert "".join(chunking.hard_split("가나다라마바사", 2, 3, len)) == "가나다라마바사"
    assert all(len(p) <= 2 for p in chunking.hard_split("가나다라마바사", 2, 3, len))
    block = lambda t, k="paragraph", s=None: {"text": t, "block_type": k, "section": s}
    got = chunking.size_bounded([block("H", "heading", "H"), block("One. Two.", s="H"), block("x" * 30, s="H"), block("H2", "heading", "H2"), block("End.", s="H2")], 100, 25, 0, len)
    assert [c.content for c in got] == ["H\nOne. Two.", "x" * 25, "x" * 5, "H2\nEnd."] and got[-1].section == "H2"
    rows = chunking.row_bundles([block("a: 1", s="s"), block("b: 2", s="s"), block("c: 3", s="t")], 9, 100, len)
    assert [(c.content, c.section) for c in rows] == [("a: 1\nb: 2", "s"), ("c: 3", "t")]
    merged = chunking.semantic_merge([{"content": "a", "similarity": None, "embedding": 1}, {"content": "b", "similarity": 0.8, "embedding": 1}, {"content": "c", "similarity": 0.2, "embedding": 1}], 0.75, 100, 100, len)
    assert [m["content"] for m in merged] == ["a\nb", "c"] and merged[0]["embedding"] is None


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab .!가", max_size=120), st.integers(1, 9))
def test_split_bounds_hold(text, n):
    parts = chunking.split_to_limit(text, n, 12, len)
    assert all(0 < len(p) <= min(n, 12) for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_citations():
    scheme = citations.resolve_scheme({"preset": "korean_legal"})
    found = citations.find_citations("제36조제1항제4호와 제2항 각 호, 「특허법」 제64조 및 이 법 제21조제3항, [특법3(2)]", scheme)
    assert [(citations.path_key(c.path), c.law, c.relative) for c in found] == [("조36/항1/호4", None, False), ("항2", None, True), ("조64", "특허법", False), ("조21/항3", None, False), ("조3/항2", "특법", False)]
    assert citations.complete_relative(found[1], (("조", "36"), ("항", "1")), scheme) == (("조", "36"), ("항", "2"))
    assert citations.complete_relative(found[1], (), scheme) is None
    level, m = scheme.opens("제5조의2(목적) ...")
    assert scheme.levels[level][0] == "조" and citations.number(m) == "5의2"
    assert scheme.opens("제2조의 정의규정 위반") is None and citations.section_marker(scheme).match("① 내용")
    with pytest.raises(ValueError):
        citations.resolve_scheme({"preset": "korean_legal", "break_level": "none"})


@pytest.mark.parametrize(
    ("written", "path", "law", "relative"),
    [("제12조", "조12", None, False), ("제1조제1항", "조1/항1", None, False), ("제5조의2제2항", "조5의2/항2", None, False), ("[특법54(3)]", "조54/항3", "특법", False), ("[민법950]", "조950", "민법", False), ("제1항", "항1", None, True)],
)
def test_citation_depth(written, path, law, relative):
    (c,) = citations.find_citations(f"자세한 내용은 {written}에 따른다.", citations.resolve_scheme({"preset": "korean_legal"}))
    assert (c.label, citations.path_key(c.path), c.law, c.relative) == (written, path, law, relative)


def test_laws_in_force():
    scheme = citations.resolve_scheme({"preset": "korean_legal"})
    found = citations.find_citations("「특허법」 제3조 및 제2항과 제3조, 이 법 제4조", scheme)
    assert [(c.label, c.law, c.relative) for c in found] == [("「특허법」 제3조", "특허법", False), ("제2항", None, True), ("제4조", None, False)]
    assert citations.complete_relative(citations.Citation("제4호", (("호", "4"),), None, True), (("조", "36"),), scheme) == (("조", "36"), ("호", "4"))
    assert citations.complete_relative(citations.Citation("제4호", (("호", "4"),), None, True), (("목", "가"),), scheme) is None
    assert [c.label for c in citations.find_citations("제36조제1항에 따른 출원서", scheme)] == ["제36조제1항"]


def test_walk_survives_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "a", "y"), ("b", "c", "z")], "src string, dst string, label string")
    roots = spark.createDataFrame([("a",)], "root string")
    assert sorted((r.chunk, r.depth) for r in citations.forward_walk(roots, edges, 3).collect()) == [("b", 1), ("c", 2)]


def test_context():
    assert context.strip_overlap("one two. three four", "three four\nfive", 20) == "five"
    assert context.strip_overlap("one two", "six\nfive", 20) is None
    items = [{"chunk_id": "a", "content": "x"}]
    near = {("a", 1): {"chunk_id": "b", "content": "다만 예외", "section": None}, ("a", -1): {"chunk_id": "c", "content": "before"}}
    assert context.expand(items, near, "off", 1000, 0, 0, len) is items
    out = context.expand(items, near, "targeted", 1000, 0, 0, len)
    assert out[0]["content"] == "x\n다만 예외" and out[0]["neighbors"][0]["chunk_id"] == "b"
    assert context.expand(items, near, "targeted", 71 + 41 + 1, 0, 0, len)[0]["content"] == "x"
    p = context.build_prompt(["aa", "bbbb", "c"], ["old", "new"], 71 + 43 + 44 + 3, 1, 3, len)
    assert p["items"] == ["aa"] and p["history"] == ["old", "new"]


def test_ordered_fold_per_query(spark):
    rows = spark.createDataFrame([(1, 1, 50), (1, 2, 900), (1, 3, 20), (2, 1, 5)], "query_id int, rank int, tokens long")
    got = context.skip_fill(rows, 200).orderBy("query_id", "rank").collect()
    assert [(r.taken, r.total) for r in got] == [(True, 121), (False, 121), (True, 141), (True, 76)]
    fold = lambda items: [(i["query_id"], i["rank"], n) for n, i in enumerate(items)]
    assert context.fold_by_query(rows, fold, "query_id int, rank int, n int", ["rank"]).filter("n = 2").first().rank == 3


def graph(*nodes, edges):
    return {"nodes": [{"id": "in", "kind": "input"}, *nodes, {"id": "out", "kind": "answer"}], "edges": [dict(zip(("from", "to", "when"), e)) for e in edges]}


def test_workflow_validation_and_run():
    search = {"id": "s", "kind": "tool", "tool": "rag", "q": "{{input.text}}"}
    branch = {"id": "b", "kind": "branch", "condition": {">": ["{{s.count}}", 1]}}
    raw = graph(search, branch, {"id": "t", "kind": "template", "prompt": "Q={{input.text}} n={{s.count}}"}, {"id": "w", "kind": "tool", "tool": "rag"}, edges=[("in", "s"), ("s", "b"), ("b", "t", "true"), ("b", "w", "false"), ("t", "out"), ("w", "out")])
    g = workflow.validate(raw, {"rag"})
    assert g.order() == ["in", "s", "b", "t", "w", "out"] and g.ancestors("t") == {"in", "s", "b"}
    run = workflow.Run(g, lambda node, config, scope: workflow.node_value([{"content": config["q"]}] * 2))
    assert run.start("안녕")["status"] == "done" and run.scope["t"]["text"] == "Q=안녕 n=2" and run.state["w"] == "pruned" and run.waves == [["s"]]
    paused = workflow.Run(g, None, needs_approval=lambda n: True)
    assert paused.start("x") == {"status": "paused", "nodes": ["s"]}
    for bad in (graph(edges=[("in", "nope")]), graph(search, edges=[("s", "in")]), graph({**search, "tool": "x"}, edges=[]), graph({"id": "t", "kind": "template", "prompt": "{{z.count}}"}, edges=[("in", "t")]), {"nodes": []}):
        with pytest.raises(workflow.GraphError):
            workflow.validate(bad, {"rag"})
    assert workflow.closes_cycle([("a", "b"), ("b", "c")], ("c", "a")) and not workflow.closes_cycle([("a", "b")], ("a", "c"))
    with pytest.raises(workflow.GraphError):
        workflow.evaluate({">": ["a", 1]}, {})
    assert workflow.evaluate({"empty": "{{x.y}}"}, {}) and not workflow.evaluate({"exists": "{{x.y}}"}, {})


def test_catalogue_edges(spark):
    assert catalog.narrow([], None) is None and catalog.narrow(["a"], None) == ["a"]
    with pytest.raises(ValueError):
        catalog.narrow(["a"], ["b"])
    df = spark.createDataFrame([(1, None), (2, "u"), (3, "v")], "id int, owner string")
    pick = lambda user, scope: [r.id for r in df.filter(catalog.owner_visible(F.col("owner"), user, scope)).collect()]
    assert (pick(None, "all"), pick("u", "mine"), pick("u", "all")) == ([1], [2], [1, 2])
    assert catalog.scoped(df, "id", []).count() == 0 and catalog.scoped(df, "id", None).count() == 3
    with pytest.raises(Exception, match="twice"):
        catalog.upsert(df, df.union(df), ["id"]).collect()
    assert [r.bad for r in spark.range(1).select(catalog.is_stale(F.lit(None).cast("date"), F.lit("2020-01-01").cast("timestamp"), F.lit(datetime.date(2024, 1, 1)), 1095).alias("bad")).collect()] == [True]


def test_blocks_history_research_ledger(spark):
    docs = spark.createDataFrame([(1, "# T\n\n- a\nb"), (2, ""), (3, None)], "doc_id int, text string")
    assert [(r.text, r.block_type, r.section) for r in blocks.text_blocks(docs).orderBy("block_no").collect()] == [("T", "heading", "T"), ("a", "list_item", "T"), ("b", "paragraph", "T")]
    turns = spark.createDataFrame([(1, n, "x") for n in range(6)], "conv_id int, turn int, text string")
    assert sorted(r.turn for r in history.last_turns(turns, 2).collect()) == [4, 5]
    assert research.parse_json_object('say {"a": 1} ok') == {"a": 1} and research.parse_json_object("{") is None
    out = research.run("q", lambda q: [q], lambda q: [{"key": q, "score": 1.0, "doc_id": 1}], lambda q, p: [], lambda q, s: "see [1, 7]")
    assert out["sources"][0]["key"] == "q"
    listing = spark.createDataFrame([("a.txt", 1, 1.0, "h1"), (".b", 1, 1.0, "h2"), ("c.txt", 1, 1.0, "h1")], "path string, size long, mtime double, sha256 string")
    seen = spark.createDataFrame([("gone.txt", 1, 1.0, "h9", "registered")], "path string, size long, mtime double, sha256 string, status string")
    assert {r.path: r.action for r in ledger.scan(listing, seen).collect()} == {"a.txt": "register", "c.txt": "duplicate", "gone.txt": "missing"}


def test_block_search_equals_the_join(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{k}", " ".join("abcdef"[j % (k % 5 + 1)] for j in range(k))) for k in range(20)], "chunk_id string, content string")
    post = sparse.postings(chunks, "simple")
    q = spark.createDataFrame([(1, "a b"), (2, "c d e"), (3, "f"), (4, "zz")], "query_id int, text string")
    terms = sparse.query_terms(q, "simple").withColumn("query_id", F.col("query_id").cast("bigint"))
    want = sorted(map(tuple, sparse.keyword_search(terms, post, 3).collect()))
    for entries in (4, 4_000_000):
        monkeypatch.setattr(sparse, "BLOCK_ENTRIES", entries)
        assert sorted(map(tuple, sparse.keyword_search_blocks(terms, post, 3).collect())) == want
    assert sparse.keyword_search_blocks(terms.limit(0), post, 3).count() == 0


def test_anchors_are_found_whole_and_wherever_they_stand(spark):
    from docweave.operators import metrics

    docs = spark.createDataFrame([(1, "xx one two three four five six"), (2, "a short b short"), (3, None), (4, ""), (5, "one two three four fiv")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "e two three four five s"), (2, "short"), (3, None), (4, ""), (5, "nine two three four six")], "query_id int, anchor string")
    assert sorted(map(tuple, metrics.anchor_places(docs, asked).collect())) == [(1, 1, 5, 23), (2, 2, 2, 5)]
    assert sorted(r[0] for r in metrics.stale_questions(asked, docs).select("query_id").collect()) == [3, 4, 5]
