"""Queries whose results need folds, models or parsers (rows only), and a few more with SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import catalog, chunking, citations, context, edges, hierarchy, history, metrics, providers, sparse
from docweave.plans import base
from docweave.plans.base import read
from docweave.plans.graph_plans import _DELIVERED, _JUDGED, _judged
from docweave.plans.search_plans import STOP
from docweave.sources.keyed_table import KeyedTable
from docweave.sources.storage import shared, stored

SCHEME = citations.resolve_scheme({"preset": "korean_legal"})


def _law(spark, d):
    """Orders as laws: their line items as clauses, some citing others."""
    li = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))
    text = F.when(F.col("n") % 3 == 1, F.concat(F.lit("제"), "n", F.lit("조(목적) 이 조의 사항을 정한다."))).when(F.col("n") % 3 == 2, F.concat(F.lit("① 제"), F.col("p") % 7 + 1, F.lit("조에 따른다."))).otherwise(F.concat(F.lit("② 「법"), F.col("p") % 40, F.lit("」 제1조를 준용하고 이 법 제"), F.col("p") % 5 + 1, F.lit("조제1항에 따른다.")))
    return li.select("doc_id", F.col("n").alias("block_no"), text.alias("text"), F.lit("paragraph").alias("block_type"))


def _law_chunks(spark, d):
    return hierarchy.chunk_hierarchy(_law(spark, d), SCHEME).withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index"))


def c21_hierarchical(spark, d):
    return hierarchy.chunk_hierarchy(_law(spark, d), SCHEME)


def g1_find_citations(spark, d):
    return edges.citation_rows(_law_chunks(spark, d), SCHEME)


def g5_build_edges(spark, d):
    c = stored(_law_chunks(spark, d))
    return edges.build_edges(c, c.select("doc_id").distinct().withColumn("filename", F.concat(F.lit("법 "), "doc_id", F.lit(".pdf"))), SCHEME)


def g11_attach(spark, d):
    c = stored(_law_chunks(spark, d).withColumn("tokens", F.length("content")))
    e = stored(edges.build_edges(c, c.select("doc_id").distinct().withColumn("filename", F.concat(F.lit("법"), "doc_id", F.lit(".pdf"))), SCHEME))
    w = Window.partitionBy("query_id").orderBy("chunk_id")
    picked = c.filter("chunk_index % 3 = 1").withColumn("query_id", F.col("doc_id") % 20).withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("query_id", "rank", "chunk_id")
    return edges.attach(picked, e, c, 900)


def e7_embed_table(spark, d):
    return providers.embed_table(base.chunks(spark, d), lambda texts: [(k, [float(len(t)), float(t.count(" "))]) for k, t in enumerate(texts)], 2)


def c4_token_limited(spark, d):
    rows = base.chunks(spark, d).select("chunk_id", "content")

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(i, k, p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, p in enumerate(chunking.split_to_limit(t, 100, 400))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.string())], names=["chunk_id", "part", "content"])

    return rows.mapInArrow(work, "chunk_id string, part int, content string")


def h5_expand_neighbours(spark, d):
    """Neighbour expansion as an ordered fold per query over the delivered chunks and the chunks beside them."""
    c = base.chunks(spark, d)
    got = sparse.keyword_search_lists(sparse.query_terms(base.queries(spark, d), "simple"), sparse.counted(c, "simple"), 5).join(c.select("chunk_id", "doc_id", "chunk_index", "content"), "chunk_id")
    near = context.neighbours(got, c).select("query_id", F.col("of").alias("chunk_id"), F.lit(0).alias("rank"), "offset", F.col("chunk_id").alias("other"), "content")
    rows = got.select("query_id", "chunk_id", "rank", F.lit(0).alias("offset"), F.lit(None).cast("string").alias("other"), "content").unionByName(near)

    def fold(items):
        own = [{"chunk_id": i["chunk_id"], "content": i["content"], "rank": i["rank"], "query_id": i["query_id"]} for i in items if not i["offset"]]
        beside = {(i["chunk_id"], i["offset"]): {"chunk_id": i["other"], "content": i["content"]} for i in items if i["offset"]}
        return [(i["query_id"], i["rank"], i["chunk_id"], len(i["content"]), len(i["neighbors"])) for i in context.expand(own, beside, "blanket", 4000, 20, 0)]

    return context.fold_by_query(rows, fold, "query_id bigint, rank int, chunk_id string, chars int, attached int", ["rank", "offset"])


def h7_build_prompt(spark, d):
    kind = F.when(F.col("role") == "assistant", "item").when(F.col("role") == "user", "history")
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").cast("int").alias("rank"), kind.alias("kind"), "text")
    return context.prompts(rows.filter("kind IS NOT NULL"), 1500, 40, 400)


def b5_persist_turns(spark, d):
    """One more turn for every third conversation, and one for a conversation that is not there."""
    c = read(spark, d, "conversations")
    messages = c.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("seq"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("model"))
    known = c.select("conv_id", F.lit(5).alias("updated_at")).distinct()
    turns = known.select(F.when(F.col("conv_id") % 3 == 0, F.col("conv_id")).otherwise(-1 - F.col("conv_id")).alias("conv_id"), F.lit(9).alias("at"), F.lit("why?").alias("question"), F.lit("so").alias("answer"), F.lit("m").alias("model"))
    stored, touched = history.persist_turns(messages, known, turns)
    last = stored.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("seq").alias("seq"), F.max_by("role", "seq").alias("last_role"), F.max_by("content", "seq").alias("last_content"))
    return last.join(touched, "conv_id")


B5 = """SELECT conv_id, n + 2 * (conv_id % 3 = 0)::INT AS messages, (n + 2 * (conv_id % 3 = 0)::INT)::INT AS seq, CASE WHEN conv_id % 3 = 0 THEN 'assistant' ELSE role END AS last_role, CASE WHEN conv_id % 3 = 0 THEN 'so' ELSE text END AS last_content, CASE WHEN conv_id % 3 = 0 THEN 9 ELSE 5 END AS updated_at
FROM (SELECT conv_id, role, text, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations) WHERE back = 1"""


def e9_reembed_cost(spark, d):
    return providers.reembed(base.chunks(spark, d), None, 0, 0.02, F.ceil(F.length("content") / 4)).withColumn("cost", F.round("cost", 9))


E9 = f"WITH {base.CHUNKS} SELECT count(*) AS chunks, sum(ceil(length(content) / 4.0))::BIGINT AS tokens, round(sum(ceil(length(content) / 4.0))::BIGINT * 0.02 / 1e6, 9)::DOUBLE AS cost FROM chunks"


def h11_trace(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("ref"), F.lit("rag").alias("source_type"), F.col("o_totalprice").alias("score"))
    return edges.trace(o, o.filter("score > 150000"))


H11 = "SELECT o_custkey AS query_id, o_orderkey AS ref, 'rag' AS source_type, o_totalprice AS score, o_totalprice > 150000 AS included FROM orders"


def i21_ancestors(spark, d):
    e = read(spark, d, "part").select((F.floor(F.col("p_partkey") / 3)).alias("src"), F.col("p_partkey").alias("dst"))
    return edges.ancestors(e.filter("src > 0"), 6)


I21 = "WITH RECURSIVE e AS (SELECT p_partkey // 3 AS src, p_partkey AS dst FROM part WHERE p_partkey >= 3), a AS (SELECT dst AS node, src AS ancestor, 1 AS n FROM e UNION ALL SELECT a.node, e.src, n + 1 FROM a JOIN e ON e.dst = a.ancestor WHERE n < 6) SELECT DISTINCT node, ancestor FROM a"


def d14_prefix_search(spark, d):
    """Keyword search whose terms are prefixes of the indexed words."""
    return sparse.prefix_search(sparse.without_stop_words(sparse.query_terms(base.queries(spark, d), "simple")), base.counted_words(spark, d), 5)


D14 = f"""WITH {base.CHUNKS}, {base.QUERIES}, {base.words_sql('chunks', 'chunk_id', 'content', 'cw')}, {base.words_sql('queries', 'query_id', 'text', 'qw')}, po AS (SELECT chunk_id, w AS term, count(*) AS tf FROM cw GROUP BY ALL), v AS (SELECT DISTINCT term FROM po),
st AS (SELECT DISTINCT query_id, substring(w, 1, 12) AS stem FROM qw WHERE w NOT IN ({STOP})), t AS (SELECT DISTINCT query_id, term FROM st JOIN v ON CASE WHEN length(stem) < 2 THEN term = stem ELSE starts_with(term, stem) END), n AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT query_id, chunk_id, round({0.1 / sparse.RANK_LIMIT!r} * sum(list_sum([1.0 / (j * j) for j in range(1, least(tf, 256) + 1)])) / any_value(n), 9)::DOUBLE AS score FROM po JOIN t USING (term) JOIN n USING (query_id) GROUP BY ALL)
SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5"""


def d6_backfill(spark, d):
    """An index rebuilt for some documents by another tokenizer, the rest kept."""
    old = sparse.postings(base.chunks(spark, d), "simple").withColumn("doc", F.split_part("chunk_id", F.lit("-"), F.lit(1)))
    new = sparse.postings(base.chunks(spark, d).filter("doc_id % 50 = 0")).withColumn("doc", F.split_part("chunk_id", F.lit("-"), F.lit(1)))
    return catalog.replace_groups(old, new, "doc").groupBy("doc").agg(F.count("*").alias("postings"), F.sum("tf").alias("tf"))


D6 = f"WITH {base.POSTINGS}, sp AS (SELECT chunk_id, w AS term, count(*) AS tf FROM chunk_words GROUP BY ALL), u AS (SELECT * FROM postings WHERE split_part(chunk_id, '-', 1)::INT % 50 = 0 UNION ALL SELECT * FROM sp WHERE split_part(chunk_id, '-', 1)::INT % 50 <> 0) SELECT split_part(chunk_id, '-', 1) AS doc, count(*) AS postings, sum(tf)::BIGINT AS tf FROM u GROUP BY 1"


def b3_edge_replacement(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    new = e.filter("document_id % 9 = 0").select("document_id", "src", F.lit(None).cast("bigint").alias("dst")).distinct()
    table = KeyedTable.create(e, shared(spark, "keyed"), ["document_id", "src", "dst"], ["document_id"], buckets=16)
    for _ in range(2):  # the second time changes nothing
        table.replace_groups(new)
    return table.read().groupBy("document_id").agg(F.count("*").alias("edges"), F.count("dst").alias("resolved"))


B3 = "SELECT l_orderkey AS document_id, count(DISTINCT CASE WHEN l_orderkey % 9 = 0 THEN l_linenumber ELSE l_linenumber * 1000000 + l_suppkey END) AS edges, CASE WHEN l_orderkey % 9 = 0 THEN 0 ELSE count(DISTINCT l_linenumber * 1000000 + l_suppkey) END AS resolved FROM lineitem GROUP BY l_orderkey"


def l5_counters(spark, d):
    got, gold, q = _judged(spark, d)
    rows = metrics.per_question(got, gold, q, 5)
    return rows.agg(F.sum("recall").alias("answered"), F.count_if(F.col("delivered") < 5).alias("short"), F.sum("delivered").alias("delivered"), F.round(F.avg("anchor"), 6).alias("anchor"))


L5 = f"WITH {_DELIVERED}, {_JUDGED} SELECT sum((hits > 0)::INT)::BIGINT AS answered, count_if(delivered < 5)::BIGINT AS short, sum(delivered)::BIGINT AS delivered, round(avg(anchor), 6) AS anchor FROM pq"


def f15_output_gates(spark, d):
    """What a completion's answer (here every turn of every conversation) is taken for: a single short line, else nothing."""
    return read(spark, d, "conversations").select("conv_id", "turn", providers.single_line(F.col("text"), providers.MAX_RECAST).alias("recast"))


F15 = r"SELECT conv_id, turn, CASE WHEN length(a) > 0 AND lower(a) <> 'pass' AND NOT contains(a, chr(10)) AND length(a) <= 120 THEN a END AS recast FROM (SELECT conv_id, turn, regexp_replace(text, '^[\s\x22]+|[\s\x22]+$', '', 'g') AS a FROM conversations)"


def j26_new_facts(spark, d):
    """Facts of a turn's lines: bullets off, short, first occurrence per conversation, four at most."""
    return providers.facts(read(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")), "conv_id", ["turn"])


J26 = r"""WITH l AS (SELECT conv_id, turn, i AS n, regexp_replace(regexp_replace(a[i], '^\s*(?:[-*•]|\d+[.)])\s*', ''), '^[\s\x22]+|[\s\x22]+$', '', 'g') AS fact FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS a, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations WHERE role = 'assistant')),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(trim(regexp_replace(fact, '\s+', ' ', 'g'))) ORDER BY turn, n) AS k FROM l WHERE length(fact) BETWEEN 1 AND 300 AND lower(fact) <> 'none') WHERE k = 1)
SELECT conv_id, at_::INT AS at, fact FROM (SELECT conv_id, fact, row_number() OVER (PARTITION BY conv_id ORDER BY turn, n) AS at_ FROM f) WHERE at_ <= 4"""

_ALL = ((c4_token_limited, None), (c21_hierarchical, None), (g1_find_citations, None), (g5_build_edges, None), (g11_attach, None), (e7_embed_table, None), (h5_expand_neighbours, None), (h7_build_prompt, None), (b5_persist_turns, B5), (e9_reembed_cost, E9), (h11_trace, H11), (i21_ancestors, I21), (d14_prefix_search, D14), (d6_backfill, D6), (b3_edge_replacement, B3), (l5_counters, L5), (f15_output_gates, F15), (j26_new_facts, J26))
QUERIES = {f.__name__: (f, sql) for f, sql in _ALL}
