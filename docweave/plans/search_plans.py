"""Sparse and dense search, fusion and their parts as queries over benchmark items and document chunks."""

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.functions import vectors as vx
from docweave.operators import dense, fusion, hybrid, sparse, turns
from docweave.plans import base
from docweave.plans.base import POSTINGS, TERMS, read
from docweave.sources.storage import stored

STOP = ", ".join(f"'{w}'" for w in (*tx.ENGLISH_STOP_WORDS, *tx.KOREAN_STOP_WORDS))
H2 = "list_sum([1.0 / (j * j) for j in range(1, least(tf, 256) + 1)])"
KEYWORD = f"hits AS (SELECT query_id, chunk_id, sum({H2}) AS h FROM postings JOIN (SELECT DISTINCT query_id, term FROM kept) USING (term) GROUP BY ALL), n AS (SELECT query_id, count(DISTINCT term) AS n FROM kept GROUP BY 1), scored AS (SELECT query_id, chunk_id, round({0.1 / sparse.RANK_LIMIT!r} * h / n, 9)::DOUBLE AS score FROM hits JOIN n USING (query_id)), sparse AS (SELECT query_id, chunk_id, score, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM scored) WHERE rn <= 10)"
KEPT = f"kept AS (SELECT * FROM terms WHERE word NOT IN ({STOP}))"


def d5_postings(spark, d):
    p = base.postings(spark, d)
    return p.groupBy("chunk_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("length"), F.max("tf").alias("top_tf"))


D5 = f"WITH {POSTINGS} SELECT chunk_id, count(*) AS terms, sum(tf)::BIGINT AS length, max(tf) AS top_tf FROM postings GROUP BY 1"


def d7_lexeme_df(spark, d):
    c = base.chunks(spark, d)
    return sparse.document_frequency(base.postings(spark, d), c)


D7 = f"WITH {POSTINGS} SELECT term AS lexeme, count(DISTINCT chunk_id) AS df FROM postings GROUP BY term UNION ALL SELECT '__total__', count(*) FROM chunks"


def d8_trim_common(spark, d):
    c = base.chunks(spark, d)
    return sparse.trim_common(sparse.query_terms(base.queries(spark, d)), sparse.document_frequency(base.postings(spark, d), c), 0.3)


D8 = f"WITH {POSTINGS}, {TERMS}, df AS (SELECT term, count(DISTINCT chunk_id) AS df FROM postings GROUP BY term) SELECT query_id, term, word FROM terms LEFT JOIN df USING (term) WHERE coalesce(df, 0) <= 0.3 * (SELECT count(*) FROM chunks)"


def d9_stop_words(spark, d):
    return sparse.without_stop_words(sparse.query_terms(base.queries(spark, d)))


D9 = f"WITH {TERMS}, {KEPT} SELECT query_id, term, word FROM kept"


def _kept(spark, d):
    return sparse.without_stop_words(sparse.query_terms(base.queries(spark, d)))


def d10_keyword_search(spark, d):
    return base.block_index(spark, d).keyword_search(_kept(spark, d), 10)


D10 = f"WITH {POSTINGS}, {TERMS}, {KEPT}, {KEYWORD} SELECT query_id, chunk_id, score, rank FROM sparse"


def d10_keyword_blocks(spark, d):
    return sparse.keyword_search_lists(_kept(spark, d), base.counted(spark, d), 10)


def d11_ts_rank(spark, d):
    p = base.postings(spark, d)
    return p.groupBy("tf").agg(F.count("*").alias("n")).select("tf", "n", F.round(F.lit(0.1 / sparse.RANK_LIMIT) * sparse.half_squares(F.col("tf")), 9).alias("score"))


D11 = f"WITH {POSTINGS} SELECT tf, count(*) AS n, round({0.1 / sparse.RANK_LIMIT!r} * {H2}, 9)::DOUBLE AS score FROM postings GROUP BY tf"


def d12_bm25(spark, d):
    return base.block_index(spark, d).bm25(_kept(spark, d), 10)


BM25 = """lens AS (SELECT chunk_id, sum(tf) AS len FROM postings GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM lens), df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
b AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * greatest(len, 1) / avgdl))), 9)::DOUBLE AS score
  FROM postings JOIN (SELECT DISTINCT query_id, term FROM kept) USING (term) JOIN df USING (term) JOIN lens USING (chunk_id), st GROUP BY ALL),
bm25 AS (SELECT query_id, chunk_id, score, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM b) WHERE rn <= 10)"""
D12 = f"WITH {POSTINGS}, {TERMS}, {KEPT}, {BM25} SELECT query_id, chunk_id, score, rank FROM bm25"


def d12_blocks_read(spark, d):
    """How much of the index the searches of d12 score: blocks and postings per query, in all and scored."""
    return base.block_index(spark, d).report(_kept(spark, d), 10)


def d13_prefix_terms(spark, d):
    words = read(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tx.simple_tokens(F.col("text")))).alias("term"))
    out = sparse.prefix_terms(sparse.without_stop_words(sparse.query_terms(base.queries(spark, d), "simple")), words)
    return out.groupBy("query_id").agg(F.count("*").alias("terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


D13 = f"""WITH {base.QUERIES}, {base.words_sql('queries', 'query_id', 'text', 'qw')}, {base.words_sql('documents', 'doc_id', 'text', 'dw')}, stems AS (SELECT DISTINCT query_id, substring(w, 1, 12) AS stem FROM qw WHERE w NOT IN ({STOP})), v AS (SELECT DISTINCT w AS term FROM dw),
m AS (SELECT DISTINCT query_id, term FROM stems JOIN v ON CASE WHEN length(stem) < 2 THEN term = stem ELSE starts_with(term, stem) END)
SELECT query_id, count(*) AS terms, min(term) AS first_term, max(term) AS last_term FROM m GROUP BY query_id"""


def d15_expanded_index(spark, d):
    extra = base.chunks(spark, d).filter("chunk_index = 0").select("chunk_id", F.explode(tx.bigram_tokens(F.lit("expanded index"))).alias("term"))
    p = sparse.with_expansion(base.postings(spark, d), extra)
    return p.filter("term IN ('ex', 'xp', 'nd')").groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("tf"))


D15 = f"WITH {POSTINGS} SELECT term, count(DISTINCT chunk_id) AS chunks, sum(tf)::BIGINT AS tf FROM (SELECT chunk_id, term, tf FROM postings UNION ALL SELECT chunk_id, term, n FROM chunks, (VALUES ('ex', 2), ('xp', 1), ('nd', 2)) x(term, n) WHERE chunk_index = 0) WHERE term IN ('ex', 'xp', 'nd') GROUP BY term"


def _vectors(spark, d):
    e = read(spark, d, "embeddings")
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("item"), "embedding")


_KNN = "knn AS (SELECT query_id, item, score, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rn FROM (SELECT q.vec_id AS query_id, c.vec_id AS item, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0)) WHERE rn <= 10)"


def e1_knn(spark, d):
    q, c = _vectors(spark, d)
    return dense.nearest(q, c, 10, digits=6)


E1 = f"WITH {_KNN} SELECT query_id, item, score, rank FROM knn"


def knn_label_vote(spark, d):
    q, c = _vectors(spark, d)
    labels = read(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "label")
    votes = dense.nearest(q, c, 10, digits=6).filter("item <> query_id").join(labels, "item").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("label"), F.max("votes").alias("votes"))


VOTE = f"WITH {_KNN} SELECT query_id, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS rn FROM (SELECT query_id, label, count(*) AS votes FROM knn JOIN embeddings ON vec_id = item WHERE item <> query_id GROUP BY ALL)) WHERE rn = 1"


def e2_inverted_file(spark, d):
    """Approximate search over every vector, with its recall against the exact search."""
    q, c = _vectors(spark, d)
    index = dense.InvertedFile(c, cells=8)
    return dense.overlap_at(dense.nearest(q, c, 10), index.search(q, 10, probes=6), 10)


def e2_graph_search(spark, d):
    """Approximate search of whole items among all chunks by the stored graphs: recall at ten, and the share of all
    vectors that a query was compared with."""
    graph, asked = base.chunk_graph(spark, d), _hashed(base.queries(spark, d))
    near = graph.search(asked, 10)
    total = graph.pages().agg(F.sum(F.size("items")).alias("total"))
    recall = dense.overlap_at(dense.nearest(asked, base.chunk_vectors(spark, d), 10), near, 10)
    share = near.groupBy("query_id").agg(F.max("scored").alias("scored")).join(F.broadcast(total)).select("query_id", F.round(F.col("scored") / F.col("total"), 6).alias("share"))
    return recall.join(share, "query_id")


def e4_overlap(spark, d):
    q, c = _vectors(spark, d)
    exact = dense.nearest(q, c, 10, digits=6)
    half = dense.nearest(q.withColumn("embedding", F.slice("embedding", 1, 32)), c.withColumn("embedding", F.slice("embedding", 1, 32)), 10, digits=6)
    return dense.overlap_at(exact, half, 10)


E4 = f"WITH {_KNN}, h AS (SELECT query_id, item FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rn FROM (SELECT q.vec_id AS query_id, c.vec_id AS item, round(list_cosine_similarity(q.embedding[1:32]::DOUBLE[], c.embedding[1:32]::DOUBLE[]), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0)) WHERE rn <= 10) SELECT query_id, count(h.item) / 10.0::DOUBLE AS overlap FROM knn LEFT JOIN h USING (query_id, item) GROUP BY query_id"


def e5_small_to_big(spark, d):
    q, c = _vectors(spark, d)
    units = c.select("item", F.floor(F.col("item") / 5).alias("parent"))
    return dense.parents_of(dense.nearest(q, c, 10, digits=6), units).select("query_id", "parent", "unit_rank", "rank")


E5 = f"WITH {_KNN} SELECT query_id, parent, unit_rank, row_number() OVER (PARTITION BY query_id ORDER BY unit_rank, parent)::INT AS rank FROM (SELECT query_id, item // 5 AS parent, min(rank) AS unit_rank FROM knn GROUP BY ALL)"


def e6_within_document(spark, d):
    """Similarity listing inside one document (here: a label), second page of ten."""
    e = read(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"), F.col("label").alias("l"))
    rows = e.join(F.broadcast(q), e["label"] == q["l"]).select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return rows.orderBy(F.desc("score"), "vec_id").offset(10).limit(10)


E6 = "SELECT vec_id, score FROM (SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e JOIN embeddings q ON q.vec_id = 0 AND q.label = e.label) ORDER BY score DESC, vec_id LIMIT 10 OFFSET 10"


def e8_truncate(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", vx.truncate_normalise(F.col("embedding"), 16).alias("v"))
    return e.select("vec_id", F.size("v").alias("width"), F.round(F.element_at("v", 1), 6).alias("first"), F.round(vx.norm(F.col("v")), 6).alias("length"))


E8 = "SELECT vec_id, 16 AS width, round(embedding[1]::DOUBLE / n, 6) AS first, round(sqrt(list_sum([(x::DOUBLE / n) * (x::DOUBLE / n) for x in embedding[1:16]])), 6) AS length FROM (SELECT vec_id, embedding, sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding[1:16]])) AS n FROM embeddings)"


#: Orders in a task.
ORDERS = 100_000


def _arms(spark, d):
    """Three rankings per customer of its orders: by price, by date, by priority; one repeats an item.

    Orders are dealt by customer once, in parts of about ORDERS; what is made of them stays there."""
    from pyspark.sql import Window

    whole = read(spark, d, "orders")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + whole.count() // ORDERS)
    o = whole.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), "o_totalprice", "o_orderdate", "o_orderpriority").repartition(parts, "query_id")
    for k, order in enumerate(("o_totalprice", "o_orderdate", "o_orderpriority")):
        o = o.withColumn(f"at{k}", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "item")))
    place = lambda k, pos, weight: F.struct(F.lit(k).alias("ranking_no"), pos.alias("pos"), F.lit(weight).alias("weight"))
    places = [place(0, F.col("at0"), 1.0), place(1, F.col("at1"), 0.5), place(2, F.col("at2"), 1.0)]
    again = F.array(*places, place(1, F.lit(1000), 0.5))
    rows = o.select("query_id", "item", F.explode(F.when(F.col("at1") == 1, again).otherwise(F.array(*places))).alias("r"))
    return rows.select("query_id", "r.ranking_no", "r.pos", "item", "r.weight")


_ARMS = """rankings AS (SELECT o_custkey AS query_id, 0 AS ranking_no, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS pos, o_orderkey AS item, 1.0::DOUBLE AS weight FROM orders
  UNION ALL SELECT o_custkey, 1, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderkey, 0.5 FROM orders
  UNION ALL SELECT o_custkey, 2, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey), o_orderkey, 1.0 FROM orders)"""
_RRF = "parts AS (SELECT *, weight / (60.0::DOUBLE + pos) AS part FROM rankings), rrf AS (SELECT query_id, item, list_reduce(list_prepend(0.0::DOUBLE, list(part ORDER BY ranking_no)), lambda a, b: a + b) AS score, min(ranking_no * 100000 + pos) AS seen FROM parts GROUP BY ALL), fused AS (SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen)::INT AS rank FROM rrf)"


def f1_rrf(spark, d):
    return fusion.reciprocal_rank_fusion(_arms(spark, d)).withColumn("score", F.round("score", 9))


F1 = f"WITH {_ARMS}, {_RRF} SELECT query_id, item, round(score, 9) AS score, rank FROM fused"


def f2_ranks(spark, d):
    return fusion.deduplicated(_arms(spark, d)).select("query_id", "ranking_no", "item", "pos").filter("pos <= 3")


F2 = f"WITH {_ARMS} SELECT query_id, ranking_no, item, pos::INT AS pos FROM rankings WHERE pos <= 3"


def f3_group_key(spark, d):
    p = read(spark, d, "part")
    strategy = F.when(F.col("p_size") % 3 == 0, "hierarchical").when(F.col("p_size") % 3 == 1, "classification_table").otherwise("semantic")
    key = fusion.group_key(F.concat(F.lit("d"), F.col("p_size")), F.col("p_partkey").cast("string"), strategy, F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")), F.col("p_type"))
    return p.select(key.alias("grp")).groupBy("grp").agg(F.count("*").alias("members"))


F3 = "SELECT grp, count(*) AS members FROM (SELECT CASE WHEN p_size % 3 = 0 AND p_partkey % 5 > 0 THEN 'd' || p_size || '#p:' || p_brand WHEN p_size % 3 = 1 THEN 'd' || p_size || '#s:' || p_type ELSE p_partkey::VARCHAR END AS grp FROM part) GROUP BY grp"


def f4_fold_groups(spark, d):
    a = _arms(spark, d)
    keys = a.select("item").distinct().withColumn("grp", F.floor(F.col("item") / 100))
    return fusion.fuse_groups(a, keys).withColumn("score", F.round("score", 9))


F4 = f"""WITH {_ARMS}, r AS (SELECT *, item // 100 AS grp, weight / (60.0::DOUBLE + pos) AS part, row_number() OVER (PARTITION BY query_id, ranking_no, item // 100 ORDER BY pos) AS nth,
  (row_number() OVER (PARTITION BY query_id, item ORDER BY ranking_no, pos) = 1)::INT AS new FROM rankings), s AS (SELECT *, sum(new) OVER (PARTITION BY query_id ORDER BY ranking_no, pos ROWS UNBOUNDED PRECEDING) AS ord FROM r),
g AS (SELECT query_id, grp, list_reduce(list_prepend(0.0::DOUBLE, list(CASE WHEN nth <= 1 THEN part ELSE 0.0 END ORDER BY ranking_no, pos)), lambda a, b: a + b) AS score, first(item ORDER BY part DESC, ord, item) AS item, count(DISTINCT item) AS members, min(ranking_no * 100000 + pos) AS seen FROM s GROUP BY ALL)
SELECT query_id, grp, round(score, 9) AS score, item, members, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen)::INT AS rank FROM g"""


def f5_cap_floor(spark, d):
    return fusion.cap_and_floor(fusion.reciprocal_rank_fusion(_arms(spark, d)), 5, 0.03).withColumn("score", F.round("score", 9))


F5 = f"WITH {_ARMS}, {_RRF} SELECT query_id, item, round(score, 9) AS score, rank FROM fused WHERE rank <= 5 AND score >= 0.03"


def f6_corroborated(spark, d):
    a = _arms(spark, d).filter("pos <= 4").withColumn("arm", F.when(F.col("ranking_no") == 1, "dense").otherwise("sparse"))
    return fusion.corroborated(a, a.select("item").distinct().withColumn("grp", F.floor(F.col("item") / 100)))


F6 = f"WITH {_ARMS} SELECT query_id, item // 100 AS grp, bool_or(ranking_no = 1) AND bool_or(ranking_no <> 1) AS corroborated FROM rankings WHERE pos <= 4 GROUP BY ALL"


def f7_load_candidates(spark, d):
    fused = fusion.cap_and_floor(fusion.reciprocal_rank_fusion(_arms(spark, d)), 3)
    return fused.join(read(spark, d, "orders").filter("o_orderstatus <> 'P'"), fused["item"] == F.col("o_orderkey")).select("query_id", "item", "rank", "o_orderstatus", "o_totalprice")


F7 = f"WITH {_ARMS}, {_RRF} SELECT query_id, item, rank, o_orderstatus, o_totalprice FROM fused JOIN orders ON o_orderkey = item WHERE rank <= 3 AND o_orderstatus <> 'P'"


def f8_rerank_order(spark, d):
    """Rerankers' answers: a strict permutation is taken, any other keeps the order; score (n - i) / n."""
    answer = F.when(F.col("user_id") % 3 == 0, F.lit("[2, 0, 1]")).when(F.col("user_id") % 3 == 1, F.lit("2 2 1")).otherwise(F.lit("1,0,2 then 9"))
    e = read(spark, d, "events").select("event_id", answer.alias("a"))
    return e.select("event_id", F.posexplode(fusion.parse_permutation(F.col("a"), F.lit(3))).alias("i", "candidate")).withColumn("score", F.round((3 - F.col("i")) / 3, 6)).withColumnRenamed("i", "at")


F8 = "SELECT event_id, i::INT AS at, CASE WHEN user_id % 3 = 0 THEN [2, 0, 1][i + 1] ELSE i END::INT AS candidate, round((3 - i) / 3, 6)::DOUBLE AS score FROM events, (VALUES (0), (1), (2)) x(i)"


def f9_top_n(spark, d):
    fused = fusion.cap_and_floor(fusion.reciprocal_rank_fusion(_arms(spark, d)), 6)
    scores = fused.filter("item % 5 > 0").select("query_id", "item", (F.col("item") % 7).cast("double").alias("rerank_score"))
    return fusion.top_after_rerank(fused, scores, 2).select("query_id", "item", F.col("rank").alias("reranked"))


F9 = f"WITH {_ARMS}, {_RRF} SELECT query_id, item, rn::INT AS reranked FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN item % 5 > 0 THEN item % 7 END DESC NULLS LAST, rank) AS rn FROM fused WHERE rank <= 6) WHERE rn <= 2"


def f10_variants(spark, d):
    """Each query and its rewrite (here its words from the end) give a dense and a sparse ranking each."""
    q = base.queries(spark, d)
    turned = q.select("query_id", F.lit(1).alias("variant"), F.array_join(F.reverse(F.split("text", " ")), " ").alias("text"))
    return fusion.variant_rankings(q.select("query_id", F.lit(0).alias("variant"), "text").unionByName(turned)).drop("variant")


F10 = f"WITH {base.QUERIES} SELECT query_id, CASE v WHEN 0 THEN text ELSE array_to_string(list_reverse(string_split(text, ' ')), ' ') END AS text, arm, weight, 2 * v + (arm = 'sparse')::INT AS ranking_no FROM queries, (VALUES (0), (1)) a(v), (VALUES ('dense', 1.0::DOUBLE), ('sparse', 0.7::DOUBLE)) b(arm, weight)"


def f11_evidence_score(spark, d):
    """A reranker's score is taken, zero included; without one the fused score is."""
    fused = fusion.cap_and_floor(fusion.reciprocal_rank_fusion(_arms(spark, d)), 3)
    scores = fused.filter("item % 3 < 2").select("query_id", "item", (F.col("item") % 3).cast("double").alias("rerank_score"))
    return fusion.top_after_rerank(fused, scores, 3).select("query_id", "item", F.round("score", 9).alias("score"))


F11 = f"WITH {_ARMS}, {_RRF} SELECT query_id, item, CASE WHEN item % 3 < 2 THEN (item % 3)::DOUBLE ELSE round(score, 9) END AS score FROM fused WHERE rank <= 3"


def f12_weak_evidence(spark, d):
    items = read(spark, d, "orders").select((F.col("o_custkey") % 500).alias("query_id"), F.when(F.col("o_orderkey") % 97 == 0, "mcp").otherwise("rag").alias("source_type"), (F.col("o_totalprice") / 1e7).alias("rrf_score"), F.lit(2).alias("variants"), (F.col("o_orderkey") % 11 == 0).alias("corroborated"))
    queries = read(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    return fusion.evidence_is_weak(items, queries, 0.0170)


F12 = """SELECT query_id, CASE WHEN other IS NULL THEN true WHEN other THEN false WHEN best < 0.0170 THEN true ELSE NOT both_arms END AS weak FROM (SELECT c_custkey AS query_id FROM customer) LEFT JOIN (
  SELECT o_custkey % 500 AS query_id, bool_or(o_orderkey % 97 = 0) AS other, max(o_totalprice / 1e7 / 2) AS best, bool_or(o_orderkey % 11 = 0) AS both_arms FROM orders GROUP BY 1) USING (query_id)"""


def f13_retry_weak(spark, d):
    """Queries whose first pass is weak take the second pass; a query has rows of one pass only."""
    a = stored(fusion.reciprocal_rank_fusion(_arms(spark, d)).filter("rank <= 3"))  # read four times
    items = a.select("query_id", F.lit("rag").alias("source_type"), F.col("score").alias("rrf_score"), F.lit(1).alias("variants"), F.lit(True).alias("corroborated"))
    weak = fusion.evidence_is_weak(items, a.select("query_id").distinct(), 0.04)
    return fusion.retried(a, weak, a.filter("rank = 1")).select("query_id", "item", "pass")


F13 = f"WITH {_ARMS}, {_RRF}, a AS (SELECT * FROM fused WHERE rank <= 3), w AS (SELECT query_id FROM a GROUP BY 1 HAVING max(score) < 0.04) SELECT query_id, item, 1 AS pass FROM a WHERE query_id NOT IN (FROM w) UNION ALL SELECT query_id, item, 2 FROM a WHERE query_id IN (FROM w) AND rank = 1"


def f16_cost(spark, d):
    prices = spark.createDataFrame([("click", 0.02, 0.0), ("view", 0.15, 0.60)], "model string, per_in double, per_out double")
    usage = read(spark, d, "events").select("user_id", F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens_in"), F.lit(10).alias("tokens_out"))
    return turns.usage_cost(usage, prices).groupBy("user_id").agg(F.round(F.sum("cost"), 9).alias("cost"))


F16 = "SELECT user_id, round(sum(coalesce((coalesce((props->>'$.k')::BIGINT, 0) * per_in + 10 * per_out) / 1e6, 0.0)), 9)::DOUBLE AS cost FROM events LEFT JOIN (VALUES ('click', 0.02::DOUBLE, 0.0::DOUBLE), ('view', 0.15::DOUBLE, 0.60::DOUBLE)) p(model, per_in, per_out) ON model = event_type GROUP BY user_id"


def f17_route_turn(spark, d):
    e = F.col("event_id")
    flags = {"attached": 2, "picked": 13, "graph": 17, "chat": 5, "external": 7, "table": 4, "web": 9, "weak": 3}
    return turns.route(read(spark, d, "events").select("event_id", *((e % n == 0).alias(c) for c, n in flags.items()))).select("event_id", "route", "clarify")


F17 = """SELECT event_id, route, route = 'search' AND event_id % 3 = 0 AND event_id % 2 > 0 AND event_id % 13 > 0 AS clarify FROM (SELECT event_id,
  CASE WHEN event_id % 17 = 0 THEN 'graph' WHEN event_id % 5 = 0 THEN 'no search' WHEN event_id % 7 = 0 THEN 'tools' WHEN event_id % 9 = 0 THEN 'web' ELSE 'search' END AS route FROM events)"""


def _hashed(texts):
    return dense.hashed_vectors(sparse.postings(texts.withColumnRenamed("query_id", "chunk_id"), text_col="text")).withColumnRenamed("chunk_id", "query_id")


def hybrid_topk(spark, d):
    """Five best chunks per benchmark item: bigram keyword search and hashed-vector search, fused."""
    post = base.postings(spark, d)
    found = hybrid.hybrid_search(base.queries(spark, d), post, base.chunk_vectors(spark, d), _hashed, index=base.block_index(spark, d))
    return found.select("query_id", "rank", F.col("item").alias("chunk_id"), F.round("rrf_score", 9).alias("rrf_score"))


HYBRID = rf"""WITH {POSTINGS}, {TERMS}, {KEPT}, {KEYWORD},
qt AS (SELECT query_id, term FROM query_pairs), places AS (SELECT term, (('0x' || substring(md5(term), 1, 4))::INT % 64) AS p, CASE WHEN substring(md5(term), 5, 1) < '8' THEN 1.0 ELSE -1.0 END::DOUBLE AS s FROM (SELECT DISTINCT term FROM chunk_terms UNION SELECT DISTINCT term FROM qt)),
cv AS (SELECT chunk_id, p, sum(s) AS v FROM chunk_terms JOIN places USING (term) GROUP BY ALL), qv AS (SELECT query_id, p, sum(s) AS v FROM qt JOIN places USING (term) GROUP BY ALL),
cn AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM cv GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY 1),
dots AS (SELECT query_id, chunk_id, sum(qv.v * cv.v) AS x FROM qv JOIN cv USING (p) GROUP BY ALL),
sims AS (SELECT qn.query_id, c.chunk_id, round(coalesce(x / nullif(qn.n * cn.n, 0), 0.0), 9) AS score FROM qn CROSS JOIN chunks c LEFT JOIN cn USING (chunk_id) LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.chunk_id = c.chunk_id),
dense AS (SELECT query_id, chunk_id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM sims) WHERE rn <= 10),
r AS (SELECT query_id, chunk_id, 0 AS ranking_no, rank FROM dense UNION ALL SELECT query_id, chunk_id, 1, rank FROM sparse),
f AS (SELECT query_id, chunk_id, list_reduce(list_prepend(0.0::DOUBLE, list(1.0::DOUBLE / (60.0::DOUBLE + rank) ORDER BY ranking_no)), lambda a, b: a + b) AS score, min(ranking_no * 1000 + rank) AS seen FROM r GROUP BY ALL)
SELECT query_id, rn::INT AS rank, chunk_id, round(score, 9) AS rrf_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rn FROM f) WHERE rn <= 5"""


QUERIES = {f.__name__: (f, sql) for f, sql in ((hybrid_topk, HYBRID), (d5_postings, D5), (d7_lexeme_df, D7), (d8_trim_common, D8), (d9_stop_words, D9), (d10_keyword_search, D10), (d10_keyword_blocks, D10), (d11_ts_rank, D11), (d12_bm25, D12), (d12_blocks_read, None), (d13_prefix_terms, D13), (d15_expanded_index, D15), (e1_knn, E1), (knn_label_vote, VOTE), (e2_inverted_file, None), (e2_graph_search, None), (e4_overlap, E4), (e5_small_to_big, E5), (e6_within_document, E6), (e8_truncate, E8), (f1_rrf, F1), (f2_ranks, F2), (f3_group_key, F3), (f4_fold_groups, F4), (f5_cap_floor, F5), (f6_corroborated, F6), (f7_load_candidates, F7), (f8_rerank_order, F8), (f9_top_n, F9), (f10_variants, F10), (f11_evidence_score, F11), (f12_weak_evidence, F12), (f13_retry_weak, F13), (f16_cost, F16), (f17_route_turn, F17))}
