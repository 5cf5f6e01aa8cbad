"""Citation graph, delivery context, workflow, research and metric queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import catalog, citations, context, listings, metrics, research, sparse, turns, workflow
from docweave.plans import base
from docweave.plans.base import read

# --- citation graph: line items are chunks of orders; paths come from line numbers and part keys ------


def _paths(spark, d):
    li = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    path = F.concat(F.lit("a"), F.floor((F.col("l_linenumber") + 1) / 2), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("/b"), F.col("l_linenumber"))).otherwise(F.concat(F.lit("/b"), F.col("l_partkey") % 3)))
    return li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_linenumber").alias("chunk_index"), path.alias("path"), "l_partkey")


_PATHS = "p AS (SELECT l_orderkey AS doc_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_linenumber AS chunk_index, 'a' || (l_linenumber + 1) // 2 || CASE WHEN l_linenumber % 2 = 0 THEN '/b' || l_linenumber ELSE '/b' || l_partkey % 3 END AS path, l_partkey FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL))"
_INDEX = """w AS (SELECT doc_id, path AS key, min(chunk_id) AS chunk_id, count(*) AS n FROM p GROUP BY ALL),
u AS (SELECT doc_id, chunk_id, split_part(path, '/', 1) AS key, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS at_ FROM p),
g AS (SELECT *, at_ - lag(at_) OVER (PARTITION BY doc_id, key ORDER BY at_) AS gap FROM u),
ix AS (SELECT doc_id, key, chunk_id FROM w WHERE n = 1 UNION ALL SELECT doc_id, key, min(chunk_id) FROM g GROUP BY ALL HAVING coalesce(max(gap), 1) = 1)"""


def g3_path_index(spark, d):
    return citations.path_index(_paths(spark, d))


G3 = f"WITH {_PATHS}, {_INDEX} SELECT doc_id, key, chunk_id FROM ix"


def g4_parent_edges(spark, d):
    p = _paths(spark, d)
    wanted = p.select("doc_id", F.col("chunk_id").alias("src"), F.col("path").alias("target"))
    return citations.longest_prefix(wanted, citations.path_index(p), own=False).filter("dst IS NOT NULL AND dst <> src").select("doc_id", "src", "dst")


G4 = f"WITH {_PATHS}, {_INDEX} SELECT p.doc_id, p.chunk_id AS src, ix.chunk_id AS dst FROM p JOIN ix ON ix.doc_id = p.doc_id AND ix.key = split_part(path, '/', 1) WHERE ix.chunk_id <> p.chunk_id"


def g7_resolve(spark, d):
    """Citations resolved by the longest prefix that exists; the others stay with no target."""
    p = _paths(spark, d)
    wanted = p.select("doc_id", F.col("chunk_id").alias("src"), F.concat(F.lit("a"), F.col("l_partkey") % 4, F.lit("/b"), F.col("l_partkey") % 5, F.lit("/c")).alias("target"))
    return citations.longest_prefix(wanted, citations.path_index(p))


G7 = f"""WITH {_PATHS}, {_INDEX}, t AS (SELECT doc_id, chunk_id AS src, 'a' || l_partkey % 4 AS k1, 'a' || l_partkey % 4 || '/b' || l_partkey % 5 AS k2 FROM p)
SELECT t.doc_id, src, k2 || '/c' AS target, coalesce(b.chunk_id, a.chunk_id) AS dst FROM t LEFT JOIN ix a ON a.doc_id = t.doc_id AND a.key = k1 LEFT JOIN ix b ON b.doc_id = t.doc_id AND b.key = k2"""


def g6_document_title(spark, d):
    return read(spark, d, "part").select("p_partkey", tx.document_title(F.concat("p_name", F.lit(" v1."), "p_partkey", F.lit(".pdf"))).alias("title"))


G6 = r"SELECT p_partkey, regexp_replace(p_name || ' v1.' || p_partkey, '\s+', '', 'g') AS title FROM part"


def g8_relink(spark, d):
    p = _paths(spark, d)
    titles = p.select("doc_id").distinct().withColumn("title", F.concat(F.lit("t"), F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("doc_id"))))
    edges = p.select("doc_id", F.col("chunk_id").alias("src"), F.when(F.col("l_partkey") % 2 == 0, F.col("chunk_id")).alias("dst"), F.concat(F.lit("t"), F.col("l_partkey") % 2000, F.lit("#a1/b"), F.col("l_partkey") % 3).alias("target"))
    return citations.relink(edges, citations.path_index(p), titles).select("src", "dst", "target")


G8 = f"""WITH {_PATHS}, {_INDEX}, ti AS (SELECT title, min(doc_id) AS to_doc FROM (SELECT DISTINCT doc_id, 't' || CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id END AS title FROM p) GROUP BY 1 HAVING count(*) = 1),
e AS (SELECT doc_id, chunk_id AS src, CASE WHEN l_partkey % 2 = 0 THEN chunk_id END AS dst, 't' || l_partkey % 2000 AS title, 'a1/b' || l_partkey % 3 AS path FROM p)
SELECT src, CASE WHEN dst IS NOT NULL THEN dst ELSE coalesce(b.chunk_id, a.chunk_id) END AS dst, e.title || '#' || path AS target FROM e LEFT JOIN ti ON ti.title = e.title AND to_doc <> e.doc_id LEFT JOIN ix a ON a.doc_id = to_doc AND a.key = 'a1' LEFT JOIN ix b ON b.doc_id = to_doc AND b.key = path"""


def _edges(spark, d):
    """Suppliers cite suppliers through parts; a few edges lead nowhere."""
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("src"), F.when(F.col("l_partkey") % 10 > 0, F.col("l_partkey") % 100 + 1).alias("dst"), F.concat(F.lit("c"), F.col("l_partkey") % 4).alias("label")).distinct()


_EDGES = "e AS (SELECT DISTINCT l_suppkey AS src, CASE WHEN l_partkey % 10 > 0 THEN l_partkey % 100 + 1 END AS dst, 'c' || l_partkey % 4 AS label FROM lineitem)"


def g9_citation_walk(spark, d):
    roots = read(spark, d, "supplier").select(F.col("s_suppkey").alias("root"))
    return citations.forward_walk(roots, _edges(spark, d), 2)


G9 = f"""WITH RECURSIVE {_EDGES}, w AS (SELECT s_suppkey AS root, s_suppkey AS chunk, 0 AS depth, '' AS label, [s_suppkey] AS path FROM supplier
  UNION ALL SELECT root, dst, depth + 1, e.label, list_append(path, dst) FROM w JOIN e ON e.src = w.chunk WHERE depth < 2 AND dst IS NOT NULL AND NOT list_contains(path, dst))
SELECT root, chunk, depth, min(label) AS label FROM (SELECT *, min(depth) OVER (PARTITION BY root, chunk) AS m FROM w WHERE depth > 0) WHERE depth = m GROUP BY ALL"""


def g10_citers(spark, d):
    chunks = read(spark, d, "supplier").select(F.col("s_suppkey").alias("chunk"), F.col("s_nationkey").alias("doc_id"), (F.col("s_suppkey") % 10).alias("chunk_index"))
    return citations.citers(chunks.select("chunk"), _edges(spark, d), chunks, hub=200).filter("nth <= 2")


G10 = f"""WITH {_EDGES}, x AS (SELECT DISTINCT src, dst FROM e WHERE dst IS NOT NULL), dg AS (SELECT src, count(*) AS out_degree FROM x GROUP BY 1)
SELECT dst, src, out_degree, nth FROM (SELECT dst, x.src, out_degree, row_number() OVER (PARTITION BY dst ORDER BY out_degree DESC, a.s_suppkey % 10, x.src)::INT AS nth FROM x JOIN dg USING (src) JOIN supplier a ON a.s_suppkey = x.src JOIN supplier b ON b.s_suppkey = dst WHERE out_degree <= 200 AND a.s_nationkey <> b.s_nationkey) WHERE nth <= 2"""


# --- delivery context --------------------------------------------------------------------------------


def _delivered(spark, d):
    return sparse.keyword_search_lists(sparse.query_terms(base.queries(spark, d), "simple"), sparse.counted(base.chunks(spark, d), "simple"), 5)


_DELIVERED = f"""{base.CHUNKS}, {base.QUERIES}, {base.words_sql('chunks', 'chunk_id', 'content', 'cw')}, {base.words_sql('queries', 'query_id', 'text', 'qw')}, po AS (SELECT chunk_id, w, count(*) AS tf FROM cw GROUP BY ALL), qd AS (SELECT DISTINCT query_id, w FROM qw), qn AS (SELECT query_id, count(*) AS n FROM qd GROUP BY 1),
sc AS (SELECT query_id, chunk_id, round({0.1 / sparse.RANK_LIMIT!r} * sum(list_sum([1.0 / (j * j) for j in range(1, least(tf, 256) + 1)])) / any_value(n), 9) AS score FROM po JOIN qd USING (w) JOIN qn USING (query_id) GROUP BY ALL),
dl AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= 5)"""


def h1_neighbours(spark, d):
    c = base.chunks(spark, d)
    got = _delivered(spark, d).join(c.select("chunk_id", "doc_id", "chunk_index"), "chunk_id")
    return context.neighbours(got, c).select("query_id", "of", "chunk_id", "offset")


H1 = f"WITH {_DELIVERED} SELECT query_id, a.chunk_id AS of, b.chunk_id, b.chunk_index - a.chunk_index AS offset FROM dl JOIN chunks a USING (chunk_id) JOIN chunks b ON a.doc_id = b.doc_id AND abs(a.chunk_index - b.chunk_index) = 1"


def h4_opening_markers(spark, d):
    m = ("The ", "And", "De ", "Th")
    return base.chunks(spark, d).select("chunk_id", tx.opens_with(F.col("content"), m).alias("marker")).filter("marker IS NOT NULL")


H4 = rf"WITH {base.CHUNKS}, x AS (SELECT chunk_id, regexp_replace(content, '^\s+', '') AS c FROM chunks), y AS (SELECT chunk_id, CASE WHEN starts_with(c, 'The ') THEN 'The ' WHEN starts_with(c, 'And') THEN 'And' WHEN starts_with(c, 'De ') THEN 'De ' WHEN starts_with(c, 'Th') THEN 'Th' END AS marker FROM x) SELECT chunk_id, marker FROM y WHERE marker IS NOT NULL"


def h6_section_heads(spark, d):
    c = base.chunks(spark, d).withColumn("section", F.concat(F.lit("s"), F.floor(F.col("chunk_index") / 3)))
    got = _delivered(spark, d).join(c.select("chunk_id", "doc_id", "section"), "chunk_id")
    return context.section_heads(got, c)


H6 = f"WITH {_DELIVERED}, s AS (SELECT *, chunk_index // 3 AS sec FROM chunks), h AS (SELECT doc_id, sec, arg_min(chunk_id, chunk_index) AS head FROM s GROUP BY ALL) SELECT query_id, dl.chunk_id, head FROM dl JOIN s USING (chunk_id) JOIN h USING (doc_id, sec) WHERE head <> dl.chunk_id AND NOT EXISTS (SELECT 1 FROM dl x WHERE x.query_id = dl.query_id AND x.chunk_id = head)"


def _costs(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return read(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.row_number().over(w).alias("rank"), F.floor(F.col("o_totalprice") / 1000).alias("tokens"))


_COSTS = "c AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, floor(o_totalprice / 1000)::BIGINT AS tokens FROM orders)"


def h5_skip_fill(spark, d):
    return context.skip_fill(_costs(spark, d), 900)


H5 = f"""WITH RECURSIVE {_COSTS}, f AS (SELECT query_id, rank, 71 + tokens <= 900 AS taken, CASE WHEN 71 + tokens <= 900 THEN 71 + tokens ELSE 71 END AS total FROM c WHERE rank = 1
  UNION ALL SELECT c.query_id, c.rank, total + tokens <= 900, CASE WHEN total + tokens <= 900 THEN total + tokens ELSE total END FROM f JOIN c ON c.query_id = f.query_id AND c.rank = f.rank + 1) SELECT query_id, rank::INT AS rank, taken, total::BIGINT AS total FROM f"""


def h7_stop_fill(spark, d):
    return context.stop_fill(_costs(spark, d), 700)


H7 = f"WITH {_COSTS} SELECT query_id, rank::INT AS rank, tokens, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) <= 700 OR rank = 1 AS included FROM c"


def h8_sanitize_history(spark, d):
    """Turns that may be sent again, without marks of the fence; each with a label as evidence. Every third turn has
    such a mark and the conversation's number in it, every fifth says nothing."""
    c, t = read(spark, d, "conversations"), F.col("turn")
    nonce = F.concat(F.lit("N"), "conv_id", F.lit("X"))
    said = F.when(t % 5 == 4, "").when(t % 3 == 0, F.concat(F.lit("<< /end  Evidence 7 >> "), "text", F.lit(" "), nonce, F.lit(" <<EVIDENCE"), nonce, F.lit(">>"))).otherwise(F.col("text"))
    kept = context.sanitize_history(c.withColumn("text", said))
    label = context.evidence_label(F.when(t % 2 == 0, F.concat(F.lit("c"), "conv_id", F.lit(".txt"))), F.concat_ws("-", "conv_id", "turn"), F.when(t % 3 > 0, t), F.when(t > 2, F.col("role")), F.when(t % 4 == 1, "attachment").otherwise("rag"))
    return kept.select("conv_id", "turn", context.without_fences(F.col("text"), nonce).alias("text"), label.alias("label"))


H8 = r"""WITH c AS (SELECT *, 'N' || conv_id || 'X' AS nonce FROM conversations WHERE role IN ('user', 'assistant') AND turn % 5 <> 4 AND length(text) > 0 OR turn % 5 <> 4 AND role IN ('user', 'assistant') AND turn % 3 = 0)
SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 3 = 0 THEN '<< /end  Evidence 7 >> ' || replace(text, nonce, '[redacted]') || ' [redacted] <<EVIDENCE[redacted]>>' ELSE replace(text, nonce, '[redacted]') END, '(?i)<<\s*/?\s*(END\s+)?EVIDENCE[^>]*>>', '[redacted]', 'g') AS text,
  '(' || CASE WHEN turn % 4 = 1 THEN 'user attachment: ' ELSE '' END || CASE WHEN turn % 2 = 0 THEN 'c' || conv_id || '.txt' ELSE conv_id || '-' || turn END || CASE WHEN turn % 3 > 0 THEN ', p.' || turn ELSE '' END || CASE WHEN turn > 2 THEN ', ' || role ELSE '' END || ')' AS label FROM c"""


def h9_citations_used(spark, d):
    a = F.concat(F.lit("see ["), F.col("o_orderkey") % 7, F.lit("] and ["), F.col("o_custkey") % 9, F.lit("], also ["), F.col("o_orderkey") % 7, F.lit("]"))
    used = read(spark, d, "orders").select("o_orderkey", F.explode(context.cited_indices(a)).alias("index"))
    return used.filter("index BETWEEN 1 AND 5")


H9 = "SELECT DISTINCT o_orderkey, i::INT AS index FROM (SELECT o_orderkey, unnest([o_orderkey % 7, o_custkey % 9]) AS i FROM orders) WHERE i BETWEEN 1 AND 5"


def h10_utilization(spark, d):
    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_totalprice") > 100000).alias("delivered"), F.count_if(F.col("o_totalprice") > 300000).alias("cited"))
    return n.select("o_custkey", F.round(context.utilization(F.col("delivered"), F.col("cited")), 6).alias("utilization"))


H10 = "SELECT o_custkey, round(count_if(o_totalprice > 300000) / nullif(count_if(o_totalprice > 100000), 0), 6) AS utilization FROM orders GROUP BY 1"


# --- workflow ------------------------------------------------------------------------------------------


def i7_condition_routing(spark, d):
    c = {"or": [{"and": [{">": ["{{o.price}}", 150000]}, {"==": ["{{o.status}}", "O"]}]}, {"not": {"exists": "{{o.note}}"}}]}
    cols = {"price": F.col("o_totalprice"), "status": F.col("o_orderstatus"), "note": F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority"))}
    return read(spark, d, "orders").select("o_orderkey", workflow.condition_column(c, lambda p: cols[p[1]]).alias("taken"))


I7 = "SELECT o_orderkey, (o_totalprice > 150000 AND o_orderstatus = 'O') OR o_orderkey % 4 = 0 AS taken FROM orders"


def i10_merge_evidence(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 4).alias("node_no"), (F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("pos"), F.when(F.col("l_suppkey") % 4 == 1, "mcp").otherwise("rag").alias("source_type"), (F.col("l_partkey") % 3).alias("ref"))
    return workflow.merge_evidence(li)


I10 = """WITH x AS (SELECT l_orderkey AS run_id, l_suppkey % 4 AS node_no, l_linenumber * 10000 + l_partkey AS pos, CASE WHEN l_suppkey % 4 = 1 THEN 'mcp' ELSE 'rag' END AS source_type, l_partkey % 3 AS ref FROM lineitem),
k AS (SELECT *, (source_type = 'rag')::INT AS a, CASE WHEN source_type = 'rag' THEN pos ELSE node_no END AS b, CASE WHEN source_type = 'rag' THEN node_no ELSE pos END AS c FROM x),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, ref ORDER BY a, b, c) AS n FROM k) WHERE n = 1)
SELECT run_id, node_no, pos, source_type, ref, row_number() OVER (PARTITION BY run_id ORDER BY a, b, c)::INT AS at FROM f"""


def i11_node_value(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 2).alias("node"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("pos"), F.col("l_partkey").alias("ref"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_returnflag")).alias("filename"), F.col("l_linestatus").alias("content"), F.col("l_quantity").alias("score"))
    return turns.node_values(li).select("run_id", "node", "count", "top.title", "text")


I11 = """SELECT run_id, node, count, CASE WHEN filename IS NULL THEN ref::VARCHAR ELSE filename END AS title, content AS text FROM (
  SELECT run_id, node, ref, filename, content, count(*) OVER g AS count, row_number() OVER (g ORDER BY pos, ref, filename NULLS FIRST, content) AS rn
  FROM (SELECT l_orderkey AS run_id, l_suppkey % 2 AS node, l_linenumber * 100000 + l_partkey AS pos, l_partkey AS ref, CASE WHEN l_partkey % 2 = 0 THEN l_returnflag END AS filename, l_linestatus AS content FROM lineitem)
  WINDOW g AS (PARTITION BY run_id, node)) WHERE rn = 1"""


def i14_narrow_scope(spark, d):
    """Segments that a nation's suppliers allow; nations without a list take any."""
    asked = read(spark, d, "customer").select(F.col("c_nationkey").alias("owner"), F.col("c_mktsegment").alias("item"), "c_custkey")
    rich = read(spark, d, "supplier").filter("s_acctbal > 9000")
    return catalog.narrowed(asked, rich.select(F.col("s_nationkey").alias("owner"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("item")), "owner", "item").select("c_custkey")


I14 = """WITH a AS (SELECT DISTINCT s_nationkey AS n, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS seg FROM supplier WHERE s_acctbal > 9000)
SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM a WHERE n = c_nationkey AND seg = c_mktsegment) OR NOT EXISTS (SELECT 1 FROM a WHERE n = c_nationkey)"""


def i15_available_tools(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("tool_id"), F.col("s_nationkey").alias("server_id"), (F.col("s_acctbal") > 0).alias("enabled"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("server_id"), F.col("n_name").alias("server"), F.col("n_regionkey").alias("group_id"))
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("group_id"), F.col("r_name").alias("grp"), (F.col("r_name") != "ASIA").alias("allowed"))
    return listings.available_tools(s, n, r).withColumnsRenamed({"tool_id": "s_suppkey", "server": "n_name", "grp": "r_name"})


I15 = "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0 AND r_name <> 'ASIA'"


def i16_graph_risk(spark, d):
    nodes = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.col("l_suppkey").alias("tool"))
    tools = read(spark, d, "supplier").filter("s_suppkey <> 13").select(F.col("s_suppkey").alias("tool"), F.when(F.col("s_suppkey") % 9 == 0, "destructive").when(F.col("s_suppkey") % 4 == 0, "write").otherwise("read").alias("risk"))
    return workflow.graph_risk(nodes, tools).select("graph_id", "risk", (F.col("level") >= 2).alias("needs_approval"))


I16 = "SELECT graph_id, ['read', 'write', 'destructive'][level] AS risk, level >= 2 AS needs_approval FROM (SELECT l_orderkey AS graph_id, max(CASE WHEN l_suppkey = 13 OR l_suppkey % 9 = 0 THEN 3 WHEN l_suppkey % 4 = 0 THEN 2 ELSE 1 END) AS level FROM lineitem GROUP BY 1)"


def i19_tool_selection(spark, d):
    s = read(spark, d, "supplier")
    tools = s.select(F.col("s_nationkey").alias("owner"), F.col("s_suppkey").alias("tool"), F.when(F.col("s_suppkey") % 4 == 0, "write").otherwise("read").alias("risk"), (F.col("s_acctbal") > 0).alias("enabled"), (-F.col("s_acctbal")).alias("at"))
    return turns.select_tools(tools, 3).select("owner", "tool", "n")


I19 = "SELECT owner, tool, n FROM (SELECT s_nationkey AS owner, s_suppkey AS tool, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)::INT AS n FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 4 > 0) WHERE n <= 3"


def i20_substantive(spark, d):
    e = read(spark, d, "events")
    calls = e.select(F.col("user_id").alias("turn_id"), F.col("event_id").alias("at"), F.col("event_type").alias("tool"), F.when(F.col("event_id") % 5 > 0, F.col("props")).otherwise(" ").alias("content"), F.when(F.col("event_id") % 7 == 0, "timeout").alias("error"))
    return turns.substantive(turns.tool_evidence(calls)).select("turn_id", "at", "tool", "content")


I20 = """SELECT turn_id, at_::INT AS at, tool, content FROM (SELECT user_id AS turn_id, event_id, event_type AS tool, props AS content, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS at_ FROM events)
WHERE event_id % 5 <> 0 AND event_id % 7 <> 0"""


# --- research and metrics --------------------------------------------------------------------------------


def k1_clean_queries(spark, d):
    q = F.array(F.concat(F.lit("  "), "text"), F.lit("x"), F.col("text"), F.lit(" two  words "))
    return read(spark, d, "benchmark").select("item_id", F.posexplode(research.clean_queries(q)).alias("at", "query"))


K1 = r"SELECT item_id, i::INT AS at, CASE i WHEN 0 THEN substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 100) ELSE 'two words' END AS query FROM benchmark, (VALUES (0), (1)) x(i)"


def k2_merge_hits(spark, d):
    o = read(spark, d, "orders")
    pool = o.filter("o_orderkey % 3 > 0").select((F.col("o_orderkey") % 3000).alias("key"), F.col("o_totalprice").alias("score"))
    hits = o.filter("o_orderkey % 5 = 0").select((F.col("o_orderkey") % 4000).alias("key"), (F.col("o_totalprice") * 1.1).alias("score"))
    return research.merge_hits(pool, hits).withColumn("score", F.round("score", 2))


K2 = "SELECT key, round(max(score), 2) AS score, max(old) = 0 AS added FROM (SELECT o_orderkey % 3000 AS key, o_totalprice AS score, 1 AS old FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey % 4000, o_totalprice * 1.1, 0 FROM orders WHERE o_orderkey % 5 = 0) GROUP BY key"


def _pool(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("key"), (F.col("l_suppkey") % 3).alias("doc_id"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_returnflag")).alias("section"), F.col("l_quantity").alias("score"), (F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("seq"))


_POOL = "p AS (SELECT l_orderkey AS query_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS key, l_suppkey % 3 AS doc_id, CASE WHEN l_partkey % 2 = 0 THEN l_returnflag END AS section, l_quantity AS score, l_linenumber * 10000 + l_partkey AS seq FROM lineitem), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, coalesce(section, key) ORDER BY score DESC, seq) AS n FROM p) WHERE n = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq)::INT AS rank FROM b)"


def k3_rank_sources(spark, d):
    return research.rank_sources(_pool(spark, d), 4).select("query_id", "key", "rank")


K3 = f"WITH {_POOL} SELECT query_id, key, rank FROM r WHERE rank <= 4"


def k4_group_by_document(spark, d):
    return research.group_by_document(research.rank_sources(_pool(spark, d), 4)).select("query_id", "key", "at")


K4 = f"WITH {_POOL}, c AS (SELECT *, min(rank) OVER (PARTITION BY query_id, doc_id) AS f FROM r WHERE rank <= 4) SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY f, rank)::INT AS at FROM c"


def k5_evidence_block(spark, d):
    return context.stop_fill(_costs(spark, d), 500).groupBy("query_id").agg(F.count_if("included").alias("used"), F.count_if(~F.col("included")).alias("dropped"))


K5 = f"WITH {_COSTS} SELECT query_id, count_if(i)::BIGINT AS used, count_if(NOT i)::BIGINT AS dropped FROM (SELECT query_id, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) <= 500 OR rank = 1 AS i FROM c) GROUP BY 1"


def k6_cited_numbers(spark, d):
    t = F.concat(F.lit("a ["), F.col("o_orderkey") % 6, F.lit(", "), F.col("o_custkey") % 11, F.lit("] b ["), F.col("o_orderkey") % 6, F.lit("]"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(research.cited_numbers(t, F.lit(8)), ",").alias("cited"))


K6 = "SELECT o_orderkey, array_to_string(list_sort(list_distinct([x for x in [o_orderkey % 6, o_custkey % 11] if x BETWEEN 1 AND 8])), ',') AS cited FROM orders"


def k7_source_snippets(spark, d):
    return read(spark, d, "documents").select("doc_id", "source", F.substring(tx.squeeze(F.col("text")), 1, 300).alias("snippet"))


K7 = r"SELECT doc_id, source, substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 300) AS snippet FROM documents"


def k8_clamp(spark, d):
    v = F.when(F.col("o_orderkey") % 5 == 0, F.lit("many")).otherwise(F.floor(F.col("o_totalprice") / 1000).cast("string"))
    return read(spark, d, "orders").select("o_orderkey", research.clamp(v, 50, 200, 80).alias("budget"))


K8 = "SELECT o_orderkey, greatest(50, least(200, CASE WHEN o_orderkey % 5 = 0 THEN 80 ELSE floor(o_totalprice / 1000)::INT END)) AS budget FROM orders"


def _questions(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 4).cast("string").alias("grp"), F.col("text").alias("anchor"))


def _gold(spark, d):
    """query_id, item: the chunks over which a document's first copy of an item's whole text stands."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    found = metrics.anchor_places(docs, _questions(spark, d))
    start = F.col("chunk_index") * (base.SIZE - base.OVERLAP)
    c = base.chunks(spark, d).select(F.col("chunk_id").alias("item"), "doc_id", "chunk_index")
    return c.join(found, "doc_id").filter((start < F.col("at") + F.col("chars")) & (start + base.SIZE > F.col("at"))).select("query_id", "item", "doc_id", "chunk_index")


def _judged(spark, d):
    c = base.chunks(spark, d).select(F.col("chunk_id").alias("item"), "content")
    return _delivered(spark, d).select("query_id", F.col("chunk_id").alias("item"), "rank").join(c, "item"), _gold(spark, d).select("query_id", "item"), _questions(spark, d)


_GOLD = f"go AS (SELECT query_id, chunk_id, doc_id, chunk_index FROM (SELECT item_id AS query_id, doc_id, instr(d.text, b.text) - 1 AS at_, length(b.text) AS chars FROM benchmark b JOIN documents d ON contains(d.text, b.text)) JOIN chunks USING (doc_id) WHERE chunk_index * {base.SIZE - base.OVERLAP} < at_ + chars AND chunk_index * {base.SIZE - base.OVERLAP} + {base.SIZE} > at_)"
_JUDGED = f"{_GOLD}, pq AS (SELECT item_id AS query_id, (item_id % 4)::VARCHAR AS grp, coalesce(hits, 0) AS hits, coalesce(anchor, 0) AS anchor, coalesce(n, 0) AS delivered FROM benchmark LEFT JOIN (SELECT dl.query_id, count(go.chunk_id) AS hits, max(contains(content, b.text)::INT) AS anchor, count(*) AS n FROM dl JOIN chunks USING (chunk_id) JOIN benchmark b ON b.item_id = dl.query_id LEFT JOIN go ON go.query_id = dl.query_id AND go.chunk_id = dl.chunk_id GROUP BY 1) x ON x.query_id = item_id)"


def l1_metrics(spark, d):
    got, gold, q = _judged(spark, d)
    return metrics.per_question(got, gold, q, 5).withColumn("precision", F.round("precision", 6))


L1 = f"WITH {_DELIVERED}, {_JUDGED} SELECT query_id, grp, (hits > 0)::INT AS recall, round(hits / 5.0::DOUBLE, 6) AS precision, anchor, delivered FROM pq"


def l4_group_means(spark, d):
    got, gold, q = _judged(spark, d)
    return metrics.group_means(metrics.per_question(got, gold, q, 5), ["recall", "precision", "anchor", "delivered"])


L4 = f"WITH {_DELIVERED}, {_JUDGED} SELECT coalesce(grp, 'ALL') AS grp, count(*) AS n, round(avg((hits > 0)::INT), 6) AS recall, round(avg(hits / 5.0::DOUBLE), 6) AS precision, round(avg(anchor), 6) AS anchor, round(avg(delivered), 6) AS delivered FROM pq GROUP BY ROLLUP (grp)"


def l6_sweep(spark, d):
    """Six settings of one arm's depth and floor, over all questions."""
    settings = spark.createDataFrame([(f"{n}/{x}", "keyword", n, x) for n in (1, 3, 5) for x in (0.0, 0.02)], "config string, arm string, top_n int, floor double")
    found = _delivered(spark, d).select(F.lit("keyword").alias("arm"), "query_id", F.col("chunk_id").alias("item"), "rank", "score")
    return metrics.sweep(settings, found, _gold(spark, d), _questions(spark, d))


L6 = f"""WITH {_DELIVERED}, {_GOLD}, cf AS (SELECT n || '/' || x AS config, 'keyword' AS arm, n AS top_n, x AS floor FROM (VALUES (1), (3), (5)) a(n), (VALUES (0.0::DOUBLE), (0.02)) b(x)), gd AS (SELECT DISTINCT query_id, chunk_id FROM go),
e AS (SELECT config, top_n, dl.query_id, count(gd.chunk_id) AS hits, min(CASE WHEN gd.chunk_id IS NOT NULL THEN rank END) AS first FROM dl LEFT JOIN gd ON gd.query_id = dl.query_id AND gd.chunk_id = dl.chunk_id JOIN cf ON rank <= top_n AND score >= floor GROUP BY ALL),
s AS (SELECT config, count_if(hits > 0) AS found, sum(hits / top_n) AS p, sum(coalesce(1 / first, 0.0)) AS r FROM e GROUP BY 1), n AS (SELECT count(DISTINCT item_id) AS n FROM benchmark)
SELECT config, arm, top_n, floor, round(coalesce(found, 0) / n, 6)::DOUBLE AS recall, round(coalesce(p, 0) / n, 6)::DOUBLE AS precision, round(coalesce(r, 0) / n, 6)::DOUBLE AS mrr FROM cf LEFT JOIN s USING (config), n"""


def l7_percentiles(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


L7 = "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1"


def l8_gold_addresses(spark, d):
    return listings.gold_addresses(_gold(spark, d))


L8 = f"WITH {base.CHUNKS}, {_GOLD} SELECT DISTINCT query_id, doc_id || '#' || chunk_index AS address FROM go"


def l9_stale_questions(spark, d):
    return metrics.stale_questions(_questions(spark, d), read(spark, d, "documents").select("doc_id", "text")).select("query_id")


L9 = "SELECT item_id AS query_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))"


_ALL = ((g3_path_index, G3), (g4_parent_edges, G4), (g6_document_title, G6), (g7_resolve, G7), (g8_relink, G8), (g9_citation_walk, G9), (g10_citers, G10), (h1_neighbours, H1), (h4_opening_markers, H4), (h5_skip_fill, H5), (h6_section_heads, H6), (h7_stop_fill, H7), (h8_sanitize_history, H8), (h9_citations_used, H9), (h10_utilization, H10), (i7_condition_routing, I7), (i10_merge_evidence, I10), (i11_node_value, I11), (i14_narrow_scope, I14), (i15_available_tools, I15), (i16_graph_risk, I16), (i19_tool_selection, I19), (i20_substantive, I20), (k1_clean_queries, K1), (k2_merge_hits, K2), (k3_rank_sources, K3), (k4_group_by_document, K4), (k5_evidence_block, K5), (k6_cited_numbers, K6), (k7_source_snippets, K7), (k8_clamp, K8), (l1_metrics, L1), (l4_group_means, L4), (l6_sweep, L6), (l7_percentiles, L7), (l8_gold_addresses, L8), (l9_stale_questions, L9))
QUERIES = {f.__name__: (f, sql) for f, sql in _ALL}
