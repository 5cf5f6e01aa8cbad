"""Catalogue, history, sink and ledger queries. Orders stand for documents, customers for collections and
owners, region, nation and customer for a folder tree, an order's customer for its lineage."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.operators import catalog, history, listings
from docweave.plans import base
from docweave.plans.base import read
from docweave.sources import ledger
from docweave.sources.keyed_table import KeyedTable
from docweave.sources.storage import shared


def j1_document_list(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("collection_id"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("collection_id"), F.col("c_name").alias("collection"), F.col("c_nationkey").alias("owner_id"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("owner_id"), F.col("n_name").alias("owner"))
    parts = read(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("doc_id"))
    return listings.document_list(o, c, n, parts).withColumnsRenamed({"doc_id": "o_orderkey", "collection": "c_name", "owner": "n_name"})


J1 = "SELECT o_orderkey, c_name, n_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) AS chunks FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def j2_explorer(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    stale = catalog.is_stale(F.lit(None), F.col("o_orderdate"), F.lit("1998-01-01").cast("date"), 365)
    text = catalog.like_text(F.col("c_name"), "00001") | catalog.like_text(F.col("o_orderpriority"), "URGENT")
    return catalog.explorer_page(o, filters=[stale, text, F.col("o_orderstatus").isin("O", "F")], sort="o_totalprice", offset=20, limit=30, key="o_orderkey").select("o_orderkey", "c_name", "o_totalprice", "total")


J2 = "SELECT o_orderkey, c_name, o_totalprice, total FROM (SELECT o_orderkey, c_name, o_totalprice, count(*) OVER () AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate::DATE < DATE '1998-01-01' - 365 AND (lower(c_name) LIKE '%00001%' OR lower(o_orderpriority) LIKE '%urgent%') AND o_orderstatus IN ('O', 'F')) ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 20"


def _folders(spark, d):
    r = read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    n = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), F.when(F.col("n_nationkey") == 7, 99).otherwise(F.col("n_regionkey"))).alias("parent_id"), F.col("n_name").alias("name"))
    c = read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("name"))
    return r.unionByName(n).unionByName(c)


_FOLDERS = "folders AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || CASE WHEN n_nationkey = 7 THEN 99 ELSE n_regionkey END, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"
_PATHS = "paths AS (SELECT id, '/' || name || '/' AS path, 1 AS depth FROM folders f WHERE parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM folders p WHERE p.id = f.parent_id) UNION ALL SELECT f.id, p.path || f.name || '/', p.depth + 1 FROM folders f JOIN paths p ON f.parent_id = p.id)"

#: The same without recursion: the tree has three levels.
_LEVELS = """paths AS (SELECT 'r' || r_regionkey AS id, '/' || r_name || '/' AS path, 1 AS depth FROM region
  UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey = 7 THEN '/' ELSE '/' || r_name || '/' END || n_name || '/', CASE WHEN n_nationkey = 7 THEN 1 ELSE 2 END FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'c' || c_custkey, CASE WHEN n_nationkey = 7 THEN '/' ELSE '/' || r_name || '/' END || n_name || '/' || c_name || '/', CASE WHEN n_nationkey = 7 THEN 2 ELSE 3 END FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey)"""

def j3_folder_paths(spark, d):
    return catalog.folder_paths(_folders(spark, d))


J3 = f"WITH RECURSIVE {_FOLDERS}, {_PATHS} SELECT id, path, depth FROM paths"


def j3_deep_paths(spark, d):
    """Chains of a thousand folders: each part lies in the one before, every thousandth begins anew."""
    k = F.col("p_partkey")
    f = read(spark, d, "part").select(k.alias("id"), F.when(k % 1000 > 1, k - 1).alias("parent_id"), F.concat(F.lit("p"), k % 10).alias("name"))
    return catalog.folder_paths(f).select("id", F.md5(F.col("path").cast("binary")).alias("digest"), "depth")


J3_DEEP = """WITH RECURSIVE f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 1000 > 1 THEN p_partkey - 1 END AS parent_id, 'p' || p_partkey % 10 AS name FROM part),
p AS (SELECT id, '/' || name || '/' AS path, 1 AS depth FROM f WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM f) UNION ALL SELECT f.id, p.path || f.name || '/', p.depth + 1 FROM f JOIN p ON f.parent_id = p.id)
SELECT id, md5(path) AS digest, depth FROM p"""


def _doc_folders(spark, d):
    p = catalog.folder_paths(_folders(spark, d))
    o = read(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"), "o_totalprice", F.col("o_orderdate").alias("updated"), "o_orderstatus", "o_orderkey")
    return o.join(p, "id").withColumnRenamed("path", "folder")


_DOCS = "docs AS (SELECT path AS folder, o_totalprice, o_orderdate AS updated, o_orderstatus, o_orderkey FROM orders JOIN paths ON id = 'c' || o_custkey)"


def j4_subtree_totals(spark, d):
    t = catalog.subtree_totals(_doc_folders(spark, d).filter("o_orderstatus = 'F'"), F.round(F.col("o_totalprice")).cast("bigint"))
    return t.withColumn("updated", F.col("updated").cast("date"))


J4 = f"WITH {_LEVELS}, {_DOCS} SELECT p.path AS folder, count(*) AS documents, sum(round(o_totalprice))::BIGINT AS total, max(updated)::DATE AS updated FROM (SELECT DISTINCT path FROM paths) p JOIN docs ON starts_with(docs.folder, p.path) WHERE o_orderstatus = 'F' GROUP BY p.path"


def j5_folder_counts(spark, d):
    return listings.folder_counts(_folders(spark, d), read(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("folder_id")))


J5 = f"WITH {_FOLDERS} SELECT id, name, (SELECT count(*) FROM folders c WHERE c.parent_id = f.id) AS children, (SELECT count(*) FROM orders WHERE 'c' || o_custkey = f.id) AS documents FROM folders f"


def j6_folder_move(spark, d):
    return catalog.move_folder(catalog.folder_paths(_folders(spark, d)), "/ASIA/", "/EUROPE/").select("id", "path", F.coalesce("problem", F.lit("")).alias("problem"))


J6 = f"WITH {_LEVELS} SELECT id, CASE WHEN starts_with(path, '/ASIA/') THEN '/EUROPE/ASIA/' || substring(path, 7) ELSE path END AS path, '' AS problem FROM paths"


def j7_folder_scope(spark, d):
    return listings.in_folders(_doc_folders(spark, d), ["/ASIA/", "/EUROPE/FRANCE/"]).select("o_orderkey")


J7 = f"WITH {_LEVELS}, {_DOCS} SELECT o_orderkey FROM docs WHERE folder LIKE '/ASIA/%' OR folder LIKE '/EUROPE/FRANCE/%'"


def j8_bulk_verdicts(spark, d):
    checks = [(F.col("o_orderstatus") == "P", "busy"), (F.col("o_orderkey") % 13 == 0, "not found")]
    return listings.bulk_verdicts(read(spark, d, "orders"), checks).select("o_orderkey", "verdict")


J8 = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'failed: busy' WHEN o_orderkey % 13 = 0 THEN 'failed: not found' ELSE 'done' END AS verdict FROM orders"


def _versions(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, d, "orders").select(F.col("o_custkey").alias("lineage_id"), "o_orderkey", F.row_number().over(w).alias("version"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("indexed").alias("status"))


_VERSIONS = "v AS (SELECT o_custkey AS lineage_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'indexed' END AS status FROM orders)"


def j9_version_list(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("author"))
    return listings.version_list(_versions(spark, d).withColumn("author_id", F.col("lineage_id")), c).withColumnRenamed("author", "c_name")


J9 = f"WITH {_VERSIONS} SELECT lineage_id, version::INT AS version, status, c_name FROM v LEFT JOIN customer ON c_custkey = lineage_id"


def j10_current_version(spark, d):
    v = catalog.current_versions(_versions(spark, d))
    back = catalog.revert(v).withColumnRenamed("version", "revert_to")
    return v.filter("is_current").join(back, "lineage_id", "left").select("lineage_id", "version", "revert_to")


J10 = f"WITH {_VERSIONS}, i AS (SELECT lineage_id, version, row_number() OVER (PARTITION BY lineage_id ORDER BY version DESC) AS rn FROM v WHERE status = 'indexed') SELECT a.lineage_id, a.version::INT AS version, b.version::INT AS revert_to FROM i a LEFT JOIN i b ON a.lineage_id = b.lineage_id AND b.rn = 2 WHERE a.rn = 1"


def j11_quota(spark, d):
    files = read(spark, d, "orders").select(F.col("o_custkey").alias("owner_id"), F.round("o_totalprice").cast("bigint").alias("size"))
    return listings.quotas(read(spark, d, "customer").select(F.col("c_custkey").alias("owner_id")), files, 2_000_000).withColumnRenamed("owner_id", "c_custkey")


J11 = "SELECT c_custkey, count(o_orderkey) AS files, coalesce(sum(round(o_totalprice)), 0)::BIGINT AS used, coalesce(sum(round(o_totalprice)), 0) > 2000000 AS over FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"


def j12_token_usage(spark, d):
    """Three sources of token counts, JSON fields among them, per user."""
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return listings.token_usage(e.filter(F.col("event_type") == t).select("user_id", (k * m).alias("tokens")) for t, m in (("click", 1), ("view", 2), ("purchase", 5)))


J12 = "SELECT user_id, sum(t)::BIGINT AS tokens, count(*) AS calls FROM (SELECT user_id, coalesce((props->>'$.k')::BIGINT, 0) * m AS t FROM events JOIN (VALUES ('click', 1), ('view', 2), ('purchase', 5)) x(e, m) ON event_type = e) GROUP BY user_id"


def j13_history_window(spark, d):
    return history.last_turns(read(spark, d, "conversations"), 3).select("conv_id", "turn", "role", F.length("text").alias("chars"))


J13 = "SELECT conv_id, turn, role, length(text)::INT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3"


def j14_attachments(spark, d):
    files = read(spark, d, "events").filter("event_type = 'view'").select(F.col("user_id").alias("conv_id"), "event_id")
    return listings.attachments(read(spark, d, "conversations"), files)


J14 = "SELECT user_id AS conv_id, event_id FROM events WHERE event_type = 'view' AND user_id IN (SELECT conv_id FROM conversations)"


def j15_trace_utilization(spark, d):
    t = read(spark, d, "conversations").select("conv_id", (F.col("role") == "user").alias("delivered"), ((F.col("role") == "assistant") & (F.col("turn") > 2)).alias("cited"))
    return listings.trace_utilization(t)


J15 = "SELECT conv_id, delivered, cited, round(cited / nullif(delivered, 0), 6) AS utilization, delivered > 0 AND cited = 0 AS nothing_cited FROM (SELECT conv_id, count_if(role = 'user')::BIGINT AS delivered, count_if(role = 'assistant' AND turn > 2)::BIGINT AS cited FROM conversations GROUP BY conv_id)"


def j16_prompt_versions(spark, d):
    """Latest and next version per name, with the author of the latest."""
    p = read(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("version"), (F.col("p_partkey") % 50 + 1).alias("author_id"))
    return listings.prompt_versions(p, read(spark, d, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("author"))).withColumnRenamed("author", "c_name")


J16 = "SELECT name, versions, latest, latest + 1 AS next, c_name FROM (SELECT p_type AS name, count(*) AS versions, max(p_partkey) AS latest FROM part GROUP BY 1) LEFT JOIN customer ON c_custkey = latest % 50 + 1"


def j17_active_workflows(spark, d):
    v = catalog.current_versions(_versions(spark, d)).filter("is_current")
    return v.join(read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), F.col("lineage_id") == F.col("c_custkey")).select("lineage_id", "version", "c_name")


J17 = f"WITH {_VERSIONS} SELECT lineage_id, max(version)::INT AS version, any_value(c_name) AS c_name FROM v JOIN customer ON c_custkey = lineage_id WHERE status = 'indexed' AND c_mktsegment = 'BUILDING' GROUP BY lineage_id"


def j18_projects(spark, d):
    runs = read(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("day"))
    return listings.projects(runs, ["F", "O"]).withColumnRenamed("project_id", "o_custkey")


J18 = "SELECT o_custkey, count(*) AS runs, max(o_orderdate)::DATE AS last_run, count_if(o_orderstatus NOT IN ('F', 'O'))::BIGINT AS active FROM orders GROUP BY o_custkey"


def j19_servers_tools(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("server_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("owner_id"))
    n = read(spark, d, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("owner_id"), F.col("n_name").alias("owner"))
    return listings.servers(s, n).withColumnsRenamed({"server_id": "s_suppkey", "name": "s_name"})


J19 = "SELECT s_suppkey, s_name, coalesce(n_name, '-') AS owner FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 2"


def j20_settings_overlay(spark, d):
    b = read(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    o = read(spark, d, "nation").filter("n_nationkey % 4 = 0").select(F.col("n_name").alias("key"), F.lit("9").alias("value"))
    return catalog.overlay(b, o)


J20 = "SELECT n_name AS key, CASE WHEN n_nationkey % 4 = 0 THEN '9' ELSE n_regionkey::VARCHAR END AS value, n_nationkey % 4 = 0 AS overridden FROM nation"


def j21_model_catalogue(spark, d):
    return listings.leading(read(spark, d, "part"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "n", "is_default")


J21 = "SELECT p_brand, p_partkey, rn::INT AS n, rn = 1 AS is_default FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3"


def _lookup(spark, d, chunks=None):
    c = base.chunks(spark, d) if chunks is None else chunks
    return c.select("chunk_id", F.concat(F.lit("f"), F.col("doc_id") % 50).alias("filename"), (F.col("doc_id") * 1000 + F.col("chunk_index")).alias("chunk_index"), "content", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("["), F.col("doc_id") % 7, F.lit("] part "), F.col("chunk_index"))).otherwise("").alias("section"))


def j22_table_lookup(spark, d):
    """One keyword is looked up once: its chunks are read as they are, as trigrams of all chunks are many times their size."""
    return catalog.marker_lookup(_lookup(spark, d), "license", 12).select("key", "filename", "chunk_index", "part", "snippet")


J22 = f"""WITH {base.CHUNKS}, t AS (SELECT 'f' || doc_id % 50 AS filename, doc_id * 1000 + chunk_index AS chunk_index, content, CASE WHEN doc_id % 2 = 0 THEN '[' || doc_id % 7 || '] part ' || chunk_index ELSE '' END AS section FROM chunks WHERE contains(lower(content), 'license')),
m AS (SELECT * FROM (SELECT *, split_part(section, ']', 1) || ']' AS key, row_number() OVER (PARTITION BY split_part(section, ']', 1) ORDER BY filename, chunk_index) AS rn FROM t WHERE section <> '') WHERE rn = 1),
u AS (SELECT key, filename, chunk_index, content, 0 AS part FROM m UNION ALL SELECT filename, filename, chunk_index, content, 1 FROM t WHERE section = '')
SELECT key, filename, chunk_index, part, replace(substring(content, greatest(p - 40, 1), p - greatest(p - 40, 1) + 67), chr(10), ' ') AS snippet FROM (SELECT *, instr(lower(content), 'license') AS p FROM u ORDER BY part, key, filename, chunk_index LIMIT 12)"""


def j25_memory_budget(spark, d):
    return history.newest_within(read(spark, d, "conversations"), 2000, "conv_id", "turn", "text").select("conv_id", "turn", "used")


J25 = "SELECT conv_id, turn, used FROM (SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM conversations) WHERE used <= 2000"


def j27_fold_selection(spark, d):
    c = read(spark, d, "conversations")
    through = c.groupBy("conv_id").agg(F.min("turn").alias("summary_through")).filter("conv_id % 3 = 0")
    return history.fold_selection(c, through, 2, 3).select("conv_id", "turn", "role")


J27 = "WITH r AS (SELECT c.* FROM conversations c JOIN (SELECT conv_id, min(turn) AS t FROM conversations GROUP BY 1) m USING (conv_id) WHERE conv_id % 3 <> 0 OR turn > t), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM r) SELECT conv_id, turn, role FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM o WHERE back > 2) WHERE n >= 3"


def j28_unused_collections(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("collection_id"), "c_mktsegment")
    uses = read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("collection_id"))
    return listings.counts_by(listings.unused(c, uses), ["c_mktsegment"]).withColumnRenamed("n", "unused")


J28 = "SELECT c_mktsegment, count(*) AS unused FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1"


def j29_status_counts(spark, d):
    return listings.counts_by(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


J29 = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL"


def b1_upsert(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_size")
    new = p.filter("p_partkey % 10 = 0").select((F.col("p_partkey") + 5).alias("p_partkey"), F.lit(-1).alias("p_size"))
    table = KeyedTable.create(p, shared(spark, "keyed"), ["p_partkey"], buckets=16)
    for _ in range(2):  # the second time changes nothing
        table.upsert(new)
    return table.read()


B1 = "WITH n AS (SELECT p_partkey + 5 AS p_partkey, -1 AS p_size FROM part WHERE p_partkey % 10 = 0) SELECT p_partkey, p_size FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM n) UNION ALL SELECT p_partkey, p_size FROM n"


def b2_replace_document(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("chunk_index"))
    li = li.withColumn("at", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("chunk_index")))  # line numbers repeat
    new = li.filter("l_orderkey % 5 = 0 AND chunk_index = 1").withColumn("chunk_index", F.lit(0))
    table = KeyedTable.create(li, shared(spark, "keyed"), ["l_orderkey", "at"], ["l_orderkey"], buckets=16)
    for _ in range(2):
        table.replace_groups(new)
    return table.read().drop("at")


B2 = "SELECT l_orderkey, l_linenumber AS chunk_index FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber = 1) UNION ALL SELECT l_orderkey, 0 FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber = 1"


def b4_last_write(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return history.latest_per_key(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


B4 = "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


def a16_watch_scan(spark, d):
    docs = read(spark, d, "documents")
    listing = docs.filter("doc_id % 17 <> 0").select(F.concat(F.lit("in/"), F.when(F.col("doc_id") % 31 == 0, "~$").otherwise(""), F.col("doc_id"), F.lit(".txt")).alias("path"), F.col("n_chars").alias("size"), F.lit(1.0).alias("mtime"), F.sha2("text", 256).alias("sha256"))
    seen = docs.filter("doc_id % 2 = 0").select(F.concat(F.lit("in/"), "doc_id", F.lit(".txt")).alias("path"), (F.col("n_chars") + (F.col("doc_id") % 10 == 0).cast("int")).alias("size"), F.lit(1.0).alias("mtime"), F.sha2("text", 256).alias("sha256"), F.when(F.col("doc_id") % 22 == 0, "failed").otherwise("registered").alias("status"))
    return ledger.scan(listing, seen, cap=300).groupBy("action").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


A16 = """WITH li AS (SELECT 'in/' || doc_id || '.txt' AS path, n_chars AS size, sha256(text) AS sha256 FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 31 <> 0),
le AS (SELECT 'in/' || doc_id || '.txt' AS path, n_chars + (doc_id % 10 = 0)::INT AS size, sha256(text) AS sha256, CASE WHEN doc_id % 22 = 0 THEN 'failed' ELSE 'registered' END AS status FROM documents WHERE doc_id % 2 = 0),
b AS (SELECT coalesce(li.path, le.path) AS path, coalesce(li.sha256, le.sha256) AS sha256, li.size IS NULL AS missing, coalesce(li.size = le.size AND status <> 'failed', false) AS same FROM li FULL JOIN le USING (path)),
k AS (SELECT DISTINCT sha256 FROM le WHERE status = 'registered'),
c AS (SELECT *, NOT missing AND NOT same AS fresh, sha256 IN (FROM k) AS known FROM b), f AS (SELECT *, fresh AND NOT known AND row_number() OVER (PARTITION BY sha256, fresh ORDER BY path) = 1 AS candidate FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY path) AS nth FROM f)
SELECT CASE WHEN missing THEN 'missing' WHEN NOT fresh THEN 'unchanged' WHEN candidate AND nth <= 300 THEN 'register' WHEN candidate THEN 'deferred' ELSE 'duplicate' END AS action, count(*) AS files, min(path) AS first_path FROM n GROUP BY 1"""


def a17_ledger_roll_up(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("scanned_at"))
    return ledger.roll_up(rows)


A17 = "SELECT o_orderstatus AS status, count(*) AS files, max(o_orderdate)::DATE AS last_scan FROM orders GROUP BY 1"


def a20_attachment_text(spark, d):
    return listings.attachment_texts(read(spark, d, "conversations").filter("role = 'user'").select("conv_id", F.col("turn").alias("place"), "text"))


A20 = "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, NULL::DOUBLE AS score FROM conversations WHERE role = 'user' AND length(trim(text)) > 0 GROUP BY conv_id"


def a21_tool_discovery(spark, d):
    """Known tools against those that a server lists now: vanished ones are disabled, set fields are kept."""
    p = read(spark, d, "part")
    old = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("tool_id"), F.col("p_brand").alias("risk"))
    new = p.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("tool_id"), F.col("p_name").alias("title"))
    return listings.discovered(old, new).withColumnRenamed("tool_id", "p_partkey")


A21 = "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE 'unset' END AS risk, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS title, p_partkey % 5 <> 0 AS enabled FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 5 <> 0"


_ALL = ((j1_document_list, J1), (j2_explorer, J2), (j3_folder_paths, J3), (j3_deep_paths, J3_DEEP), (j4_subtree_totals, J4), (j5_folder_counts, J5), (j6_folder_move, J6), (j7_folder_scope, J7), (j8_bulk_verdicts, J8), (j9_version_list, J9), (j10_current_version, J10), (j11_quota, J11), (j12_token_usage, J12), (j13_history_window, J13), (j14_attachments, J14), (j15_trace_utilization, J15), (j16_prompt_versions, J16), (j17_active_workflows, J17), (j18_projects, J18), (j19_servers_tools, J19), (j20_settings_overlay, J20), (j21_model_catalogue, J21), (j22_table_lookup, J22), (j25_memory_budget, J25), (j27_fold_selection, J27), (j28_unused_collections, J28), (j29_status_counts, J29), (b1_upsert, B1), (b2_replace_document, B2), (b4_last_write, B4), (a16_watch_scan, A16), (a17_ledger_roll_up, A17), (a20_attachment_text, A20), (a21_tool_discovery, A21))
QUERIES = {f.__name__: (f, sql) for f, sql in _ALL}
