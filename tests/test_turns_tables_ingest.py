"""Tables, ingestion, turns, hybrid search and page geometry on small fixtures with known results."""

import pytest
from pyspark.sql import functions as F

from docweave.operators import catalog, context, dense, fusion, history, hybrid, ingest, metrics, providers, sparse, tables, turns
from docweave.sources import page_geometry, pdf_lines

BLOCK = "doc_id long, block_no int, text string, block_type string, section string"


def blocks(spark, *lines, doc=1):
    return spark.createDataFrame([(doc, k, t, "paragraph", None) for k, t in enumerate(lines)], BLOCK)


def test_table_configuration():
    assert tables.resolve_table(None) is None and tables.resolve_table({"strategy": "size"}) is None
    for bad in ({"preset": "x"}, {}, {"marker": "("}, {"marker": "a" * 501}):
        with pytest.raises(ValueError):
            tables.resolve_table({"strategy": "classification_table", **bad})
    assert tables.resolve_table({"strategy": "classification_table", "preset": "korean_ip_classification", "break_before": ""}).break_before == ""


def test_table_chunks(spark):
    t = tables.resolve_table({"strategy": "classification_table", "preset": "korean_ip_classification"})
    b = blocks(spark, "머리말", "[제9류/G390802] 소프트웨어", "게임", "앱", "본류에는 물감이 있다", "바탕", "[제2류/G1, G2]", "[제3류/G3902, G3903]")
    rows = tables.chunk_tables(b, t).orderBy("chunk_index").collect()
    head = "상표 출원 시 소프트웨어의 상품류는 제9류, 유사군코드는 G390802입니다."
    assert [r.content for r in rows] == ["머리말", f"{head}\n[제9류/G390802] 소프트웨어\n게임\n앱", "본류에는 물감이 있다\n바탕\n[제2류/G1, G2]", "[제3류/G3902, G3903]"]
    assert [r.section for r in rows] == [None, "[제9류/G390802] 소프트웨어", None, "[제3류/G3902, G3903]"]
    many = tables.chunk_tables(blocks(spark, "[제9류/G390802] 소프트웨어", *["가나다라 마바사" for _ in range(40)]), t, 200, 150).collect()
    assert len(many) > 3 and all(r.content.startswith(f"{head}\n[제9류/G390802]") and len(r.content) <= 150 for r in many)
    assert sum(r.content.count("가나다라") for r in many) == 40
    assert tables.chunk_tables(b.limit(0), t).count() == 0


NUMBERED = {"strategy": "hierarchical", "levels": [["part", r"^Part (?P<n>\d+)"]], "citations": [r"see Part (?P<part>\d+)"]}


def test_documents_without_a_hierarchy_are_cut_by_size(spark):
    law = "\n".join(f"Part {n} text\nsee Part {n}" for n in range(1, 9))
    docs = spark.createDataFrame([(1, law), (2, "plain\nlines\n\nmore"), (3, law), (4, ""), (5, None), (6, "Part 1 alone\nand on")], "doc_id long, text string")
    told = spark.createDataFrame([(3, "self_contained"), (2, "nonsense"), (6, "reference_dependent")], "doc_id long, override string")
    rows = ingest.chunk_documents(docs, NUMBERED, told).collect()
    by = {d: {r.strategy for r in rows if r.doc_id == d} for d in range(1, 7)}
    assert by == {1: {"hierarchical"}, 2: {"size"}, 3: {"size"}, 4: set(), 5: set(), 6: {"hierarchical"}}
    assert [r.content for r in rows if r.doc_id == 2] == ["plain lines\nmore"]
    assert {r.path for r in rows if r.doc_id == 1} == {f"part{n}" for n in range(1, 9)}
    with pytest.raises(ValueError):
        ingest.resolve_strategy({"strategy": "sniff"})
    assert ingest.chunk_documents(docs.limit(0), NUMBERED).count() == 0
    kept = ingest.characters(spark.createDataFrame([(1, "self_contained")], "doc_id long, character string"), spark.createDataFrame([(1, "reference_dependent")], "doc_id long, override string")).first()
    assert (kept.detected, kept.override, kept.character) == ("self_contained", "reference_dependent", "reference_dependent")


def test_turns(spark):
    calls = spark.createDataFrame([(1, 3, "b", "  ", None), (1, 1, "a", "found", None), (1, 2, "c", "x", "down"), (2, 1, "a", None, None)], "turn_id int, at int, tool string, content string, error string")
    said = turns.tool_evidence(calls)
    assert [(r.tool, r.content) for r in said.filter("turn_id = 1").orderBy("at").collect()] == [("a", "found"), ("c", "[failed] down"), ("b", "[no result]")]
    assert [r.tool for r in turns.substantive(said).collect()] == ["a"]
    flags = "id int, attached boolean, picked boolean, graph boolean, chat boolean, external boolean, table boolean, web boolean, weak boolean"
    t = spark.createDataFrame([(1, *[None] * 8), (2, None, None, True, True, True, None, None, None), (3, None, None, None, None, None, True, None, True), (4, None, None, None, None, None, None, None, True), (5, None, None, None, None, True, None, True, True), (6, None, None, None, None, None, None, True, True)], flags)
    assert [(r.route, r.clarify) for r in turns.route(t).orderBy("id").collect()] == [("search", False), ("graph", False), ("search", False), ("search", True), ("tools", False), ("web", False)]
    items = spark.createDataFrame([(1, "n", 2, "r2", "f", "late", 1.0), (1, "n", 1, "r1", "", "first", 2.0)], "run_id int, node string, pos int, ref string, filename string, content string, score double")
    got = turns.node_values(items).first()
    assert (got["count"], got.top.title, got.text) == (2, "r1", "first")
    cost = turns.usage_cost(spark.createDataFrame([("m", 10, None), ("x", 5, 5)], "model string, tokens_in int, tokens_out int"), spark.createDataFrame([("m", 2.0, 3.0)], "model string, per_in double, per_out double"))
    assert sorted(r.cost for r in cost.collect()) == [0.0, 2e-5]


def test_retries_and_reranks(spark):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, item string")
    second = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, item string")
    weak = spark.createDataFrame([(1, True), (2, False), (3, True)], "query_id int, weak boolean")
    assert sorted(map(tuple, fusion.retried(first, weak, second).collect())) == [(1, "x", 2), (2, "b", 1)]
    fused = spark.createDataFrame([(1, "a", 0.3, 1), (1, "b", 0.2, 2), (1, "c", 0.1, 3)], "query_id int, item string, score double, rank int")
    scores = spark.createDataFrame([(1, "c", 0.9), (1, "b", 0.0)], "query_id int, item string, rerank_score double")
    assert [(r.item, r.score) for r in fusion.top_after_rerank(fused, scores, 3).orderBy("rank").collect()] == [("c", 0.9), ("b", 0.0), ("a", 0.3)]
    allowed = spark.createDataFrame([("p", 1)], "owner string, item int")
    asked = spark.createDataFrame([("p", 1), ("p", 2), ("q", 2)], "owner string, item int")
    assert sorted(map(tuple, catalog.narrowed(asked, allowed, "owner", "item").collect())) == [("p", 1), ("q", 2)]


def test_hybrid_search(spark):
    chunks = spark.createDataFrame([("a", "red apple pie"), ("b", "green apple"), ("c", "blue sky"), ("d", "red sky")], "chunk_id string, content string")
    post = sparse.postings(chunks)
    vectors = dense.hashed_vectors(post).withColumnRenamed("chunk_id", "item")
    q = spark.createDataFrame([(7, "red apple"), (8, "sky")], "query_id long, text string")

    def embed(texts):
        return dense.hashed_vectors(sparse.postings(texts.withColumnRenamed("query_id", "chunk_id"), text_col="text")).withColumnRenamed("chunk_id", "query_id")

    def top(**more):
        return {k: [r.item for r in hybrid.hybrid_search(q, post, vectors, embed, top_n=2, **more).filter(F.col("query_id") == k).orderBy("rank").collect()] for k in (7, 8)}

    assert top()[7][0] == "a" and set(top()[8]) == {"c", "d"}
    assert top(scope=chunks.filter("chunk_id = 'b'").select("chunk_id")) == {7: ["b"], 8: ["b"]}
    assert top(scope=chunks.limit(0).select("chunk_id")) == {7: [], 8: []}
    assert top(rerank=lambda c: c.select("query_id", "item", F.when(F.col("item") == "b", 1.0).otherwise(0.5).alias("rerank_score")))[7][0] == "b"
    rewritten = spark.createDataFrame([(8, 1, "green apple")], "query_id long, variant int, text string")
    assert "b" in {r.item for r in hybrid.hybrid_search(q, post, vectors, embed, rewrites=rewritten).filter("query_id = 8").collect()}
    folded = top(keys=spark.createDataFrame([("a", "g"), ("b", "g")], "item string, grp string"))[7]
    assert folded[0] == "a" and "b" not in folded


def test_prompts_equal_the_fold_over_all_rows(spark):
    rows = [(1, k, ("item", "history")[k % 2], "word " * (k % 7)) for k in range(400)] + [(2, 0, "item", "long " * 5000), (3, 5, "history", None)]
    df = spark.createDataFrame(rows, "query_id long, rank int, kind string, text string")
    got = {r.query_id: (r["items"], r.turns, r.tokens) for r in context.prompts(df, 900, 30, 200).collect()}
    for k in (1, 2, 3):
        mine = sorted(r for r in rows if r[0] == k)
        done = context.build_prompt([r[3] or "" for r in mine if r[2] == "item"], [r[3] or "" for r in mine if r[2] == "history"], 900, 30, 200)
        assert got[k] == (len(done["items"]), len(done["history"]), done["tokens"])
    sizes = spark.createDataFrame([(1, k, 3) for k in range(50)], "query_id long, rank int, tokens int")
    for newest in (False, True):
        kept = sorted(r["rank"] for r in context.first_within(sizes, 30, newest=newest, width=7).collect())
        assert kept == (list(range(39, 50)) if newest else list(range(11)))


def test_turns_are_stored(spark):
    messages = spark.createDataFrame([(1, 1, "user", "hi", None), (1, 2, "assistant", "ho", "m")], "conv_id long, seq int, role string, content string, model string")
    conversations = spark.createDataFrame([(1, 5), (2, 9)], "conv_id long, updated_at long")
    new = spark.createDataFrame([(1, 7, "q2", "a2", "m"), (1, 6, "q1", "a1", "m"), (2, 8, "q", "a", "m"), (3, 8, "lost", "lost", "m")], "conv_id long, at long, question string, answer string, model string")
    stored, touched = history.persist_turns(messages, conversations, new)
    assert [r.content for r in stored.filter("conv_id = 1").orderBy("seq").collect()] == ["hi", "ho", "q1", "a1", "q2", "a2"]
    assert [(r.seq, r.role) for r in stored.filter("conv_id = 2").orderBy("seq").collect()] == [(1, "user"), (2, "assistant")]
    assert sorted(map(tuple, touched.collect())) == [(1, 7), (2, 9)]


def test_reembedding_and_sweeps(spark):
    chunks = spark.createDataFrame([("a", "xx"), ("b", "yyy")], "chunk_id string, content string")
    assert tuple(providers.reembed(chunks, None, 1, 10.0, F.length("content")).first()) == (2, 5, 5e-5)
    done = providers.reembed(chunks, lambda t: [(k, [float(len(x))]) for k, x in enumerate(t)], 1, 10.0, F.length("content"), dry_run=False)
    assert {r.chunk_id: r.embedding for r in done.collect()} == {"a": [2.0], "b": [3.0]}
    found = spark.createDataFrame([("s", 1, "a", 1, 0.5), ("s", 1, "b", 2, 0.4), ("d", 1, "b", 1, 0.9)], "arm string, query_id int, item string, rank int, score double")
    settings = spark.createDataFrame([("c1", "s", 1, 0.0), ("c2", "s", 2, 0.0), ("c3", "d", 1, 0.0), ("c4", "d", 1, 1.0)], "config string, arm string, top_n int, floor double")
    gold, asked = spark.createDataFrame([(1, "b")], "query_id int, item string"), spark.createDataFrame([(1,), (2,)], "query_id int")
    assert {r.config: (r.recall, r.precision, r.mrr) for r in metrics.sweep(settings, found, gold, asked).collect()} == {"c1": (0.0, 0.0, 0.0), "c2": (0.5, 0.25, 0.25), "c3": (0.5, 0.5, 0.5), "c4": (0.0, 0.0, 0.0)}


def test_page_geometry_equals_the_fold(spark):
    words = [(1, 1, "left", 50.0, 90.0), (1, 1, "side", 95.0, 120.0), (1, 1, "right", 300.0, 340.0), (1, 2, "alone", 50.0, 90.0), (1, 3, "a", 0.0, 10.0), (1, 3, "b", 30.0, 200.0)]
    df = spark.createDataFrame(words, "doc_id int, page int, word string, x0 double, x1 double")
    got = {(r.page, r.word): r.column for r in page_geometry.in_columns(df).collect()}
    for page in (1, 2, 3):
        own = [pdf_lines.Word(w, a, b, 0.0) for _, p, w, a, b in words if p == page]
        cuts = pdf_lines.columns(own)
        assert {w.text: sum(c < w.x0 for c in cuts) for w in own} == {w: c for (p, w), c in got.items() if p == page}
    texts = ["1.2 Scope", "1.2 Scope ..... 7", "상표 등록", "ALL CAPITALS", "A Title Case", "A Title Case", "goes on", "not a heading", "Ends here.", "", "x" * 90, "O'Neil Said"]
    lines = spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(texts)], "doc_id int, page int, line_no int, text string").withColumn("size", F.lit(10.0)).withColumn("bold", F.lit(False))
    flags = [r.heading for r in page_geometry.with_headings(lines).orderBy("line_no").collect()]
    assert flags == [pdf_lines.is_heading(t, n) for t, n in zip(texts, [*texts[1:], ""])]
    sizes = lines.withColumn("size", F.when(F.col("line_no") < 5, 12.0).otherwise(10.0))
    assert page_geometry.body_sizes(sizes).first().body == 10.0
    furniture = spark.createDataFrame([(1, p, 0, "Head") for p in range(5)] + [(1, p, 0, "Rare") for p in range(4)], "doc_id int, page int, band int, text string")
    assert {r.text for r in page_geometry.with_furniture(furniture).filter("furniture").collect()} == {"Head"}


def test_edges_and_what_they_attach(spark):
    from docweave.operators import citations, edges

    scheme = citations.resolve_scheme({"preset": "korean_legal"})
    rows = [(1, "a", 0, "조1", "제1조 제2조에 따른다."), (1, "b", 1, "조2", "제2조 「나법」 제1조를 준용한다. 제9조도 본다."), (2, "c", 0, "조1", "제1조 정한다.")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id string, chunk_index int, path string, content string").withColumn("tokens", F.lit(10))
    names = spark.createDataFrame([(1, "가법.pdf"), (2, "나법.pdf")], "doc_id long, filename string")
    made = edges.build_edges(chunks, names, scheme)
    found = {(r.src, r.dst, r.kind) for r in made.collect()}
    assert found == {("a", "b", "ref"), ("b", "c", "ref"), ("b", None, "ref")}
    picked = spark.createDataFrame([(7, 1, "a")], "query_id long, rank int, chunk_id string")
    assert [(r.chunk_id, r.attached, r.kind, r.total) for r in edges.attach(picked, made, chunks, 900).collect()] == [("a", "b", "ref", 71 + 41 + 10 + 10)]
    assert edges.attach(picked, made, chunks, 71 + 41 + 19).count() == 0
    cited = edges.attach(picked.withColumn("chunk_id", F.lit("c")), made, chunks, 900)
    assert [(r.attached, r.kind) for r in cited.collect()] == [("b", "cited-by")]


def test_inverted_file_recall(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("item"), "embedding")
    q = e.filter("item % 20 = 0").withColumnRenamed("item", "query_id")
    exact, near = dense.nearest(q, e, 10), dense.InvertedFile(e, 8).search(q, 10, 6)
    assert dense.overlap_at(exact, near, 10).agg(F.avg("overlap")).first()[0] >= 0.9
