"""Sources, text functions, chunking and tokenisers as queries over the tables."""

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.functions import vectors as vx
from docweave.operators import chunking, ingest, listings, tables
from docweave.plans import base
from docweave.plans.base import read
from docweave.sources import blocks as src
from docweave.sources import html_blocks, page_geometry

_BLOCKS = r"""raw AS (SELECT doc_id, i - 1 AS block_no, regexp_replace(parts[i], '^\s+|\s+$', '', 'g') AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM marked)),
typed AS (SELECT doc_id, block_no::INT AS block_no, line, CASE WHEN starts_with(line, '#') THEN 'heading'
    WHEN starts_with(line, '- ') OR starts_with(line, '* ') THEN 'list_item' ELSE 'paragraph' END AS block_type FROM raw WHERE line <> ''),
blocks AS (SELECT doc_id, block_no, block_type, CASE block_type WHEN 'heading' THEN regexp_replace(line, '^#+\s*', '')
    WHEN 'list_item' THEN regexp_replace(substring(line, 3), '^\s+', '') ELSE line END AS text FROM typed)"""
#: The texts have no headings: every fifth line is marked as one and every seventh as a list item.
_MARKED = """marked AS (SELECT doc_id, string_agg(CASE WHEN i % 5 = 1 THEN '# ' || p WHEN i % 7 = 0 THEN '- ' || p ELSE p END, chr(10) ORDER BY i) AS text
    FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS a, a[i] AS p FROM documents) GROUP BY doc_id)"""


def _marked(spark, d):
    lines = F.split("text", "\n")
    text = F.array_join(F.transform(lines, lambda p, i: F.when((i + 1) % 5 == 1, F.concat(F.lit("# "), p)).when((i + 1) % 7 == 0, F.concat(F.lit("- "), p)).otherwise(p)), "\n")
    return read(spark, d, "documents").select("doc_id", text.alias("text"))


def a2_text_blocks(spark, d):
    return src.text_blocks(_marked(spark, d))


A2 = f"""WITH {_MARKED}, {_BLOCKS}
SELECT doc_id, block_no, text, block_type, last_value(CASE WHEN block_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS section FROM blocks"""


def a3_html_blocks(spark, d):
    return html_blocks.html_blocks(read(spark, d, "pages"))


def a5_row_serialise(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    return rows.select("p_partkey", src.row_line(["brand", "type", "size"]).alias("line"))


A5 = """SELECT p_partkey, concat_ws(' | ', CASE WHEN p_size % 3 <> 0 THEN 'brand: ' || trim(p_brand) END, 'type: ' || trim(p_type), 'size: ' || p_size) AS line FROM part"""


def _placed_words(spark, d):
    """Words of a document on pages of ten rows, five words left and five right of a gutter; a row's words stand up to
    two points apart in height, the second of each half close behind the first."""
    i = F.col("i")
    w = base.dealt_documents(spark, d).select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "word")).filter("word <> ''")
    x0 = F.lit(50.0) + i % 10 * 50 + F.when(i % 10 >= 5, 40).otherwise(0)
    placed = w.select("doc_id", F.floor(i / 100).alias("page"), "word", x0.alias("x0"), (F.lit(20.0) + F.floor(i / 10) % 10 * 12 + i % 3).alias("top"), F.when(i % 100 < 10, 14.0).otherwise(10.0).alias("size"), (i % 37 == 0).alias("bold"), (i % 7 == 1).alias("blank"))
    return placed.withColumn("x1", F.col("x0") + F.when((F.col("x0") - 50) % 100 == 0, 48).otherwise(F.least(F.length("word"), F.lit(12)) * 4))


_PLACED = """w AS (SELECT doc_id, i, i // 100 AS page, word, 50.0::DOUBLE + i % 10 * 50 + CASE WHEN i % 10 >= 5 THEN 40 ELSE 0 END AS x0, 20.0::DOUBLE + i // 10 % 10 * 12 + i % 3 AS top FROM (
  SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(0, len(string_split(text, ' ')))) AS i FROM documents) WHERE word <> ''),
p AS (SELECT *, x0 + CASE WHEN (x0 - 50) % 100 = 0 THEN 48 ELSE least(length(word), 12) * 4 END AS x1 FROM w),
g AS (SELECT doc_id, page, (reach + x0) / 2 AS cut FROM (SELECT doc_id, page, x0, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, min(x0) OVER (PARTITION BY doc_id, page) AS a, max(x1) OVER (PARTITION BY doc_id, page) AS z FROM p) WHERE x0 - reach >= 12 AND reach - a >= 40 AND z - x0 >= 40),
l AS (SELECT doc_id, page, list(DISTINCT cut) AS cuts FROM g GROUP BY ALL),
c AS (SELECT p.*, coalesce(len(list_filter(cuts, lambda c: c < x0)), 0)::INT AS col FROM p LEFT JOIN l USING (doc_id, page))"""


def a8_page_lines(spark, d):
    return page_geometry.page_lines(_placed_words(spark, d)).select("doc_id", "page", "line_no", "band", F.md5(F.col("text").cast("binary")).alias("digest"), "size", "bold")


A8 = f"""WITH {_PLACED}, t AS (SELECT *, lag(x1) OVER (PARTITION BY doc_id, page, col, i // 10 ORDER BY x0) AS before, row_number() OVER (PARTITION BY doc_id, page, col, i // 10 ORDER BY round(top, 1), x0) AS nth FROM c),
r AS (SELECT doc_id, page, col, i // 10 AS line, min(CASE WHEN nth = 1 THEN top END) AS row_top, string_agg(CASE WHEN before IS NOT NULL AND (x0 - before > 3 OR i % 7 = 1) THEN ' ' ELSE '' END || word, '' ORDER BY x0) AS text,
  max(CASE WHEN i % 100 < 10 THEN 14.0::DOUBLE ELSE 10.0 END) AS size, bool_or(i % 37 = 0) AS bold FROM t GROUP BY ALL),
b AS (SELECT *, trim(text, ' ') AS s FROM r)
SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY col, row_top) - 1)::INT AS line_no, round_even(row_top / 10, 0)::BIGINT AS band, md5(s) AS digest, size, bold FROM b WHERE s <> ''"""


def a9_column_gutters(spark, d):
    placed = page_geometry.in_columns(_placed_words(spark, d))
    return placed.groupBy("doc_id", "page", "column").agg(F.count("*").alias("words"), F.min("x0").alias("left"))


A9 = f"WITH {_PLACED} SELECT doc_id, page, col AS column, count(*) AS words, min(x0) AS left FROM c GROUP BY ALL"


def _page_lines(spark, d):
    """Lines of documents on pages of three; each page's first line is its source's running header."""
    n = F.col("n")
    lines = read(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    text = F.when(n % 3 == 0, F.concat(F.lit("Report of "), "source")).otherwise(F.col("line"))
    return lines.select("doc_id", F.floor(n / 3).alias("page"), n.alias("line_no"), F.floor((20 + 12 * (n % 3)) / 10).alias("band"), text.alias("text"), F.when(n % 5 == 1, 14.04).otherwise(10.02).cast("double").alias("size"), (n % 11 == 4).alias("bold"))


_LINES = "lines AS (SELECT doc_id, n // 3 AS page, n, (20 + 12 * (n % 3)) // 10 AS band, CASE WHEN n % 3 = 0 THEN 'Report of ' || source ELSE line END AS text, CASE WHEN n % 5 = 1 THEN 14.04 ELSE 10.02 END::DOUBLE AS size, n % 11 = 4 AS bold FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents))"


def a10_furniture(spark, d):
    found = page_geometry.with_furniture(_page_lines(spark, d))
    return found.groupBy("doc_id").agg(F.count_if("furniture").alias("furniture"), F.count("*").alias("lines"))


A10 = f"""WITH {_LINES}, f AS (SELECT doc_id, band, text FROM lines GROUP BY ALL HAVING count(DISTINCT page) >= 5)
SELECT doc_id, count_if(f.text IS NOT NULL)::BIGINT AS furniture, count(*) AS lines FROM lines LEFT JOIN f USING (doc_id, band, text) GROUP BY doc_id"""


def a11_body_size(spark, d):
    return page_geometry.body_sizes(_page_lines(spark, d))


_BODY = "b AS (SELECT doc_id, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, size) AS rn FROM (SELECT doc_id, round(size, 1) AS size, sum(length(text)) AS chars FROM lines GROUP BY ALL)) WHERE rn = 1)"
A11 = f"WITH {_LINES}, {_BODY} SELECT doc_id, body FROM b"


def a12_headings(spark, d):
    return page_geometry.with_headings(_page_lines(spark, d)).filter("heading").select("doc_id", "line_no")


A12 = rf"""WITH {_LINES}, {_BODY}, t AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s, coalesce(lead(text) OVER (PARTITION BY doc_id, page ORDER BY n), '') AS after FROM lines), w AS (SELECT *, len(regexp_split_to_array(s, '\s+')) AS k FROM t)
SELECT doc_id, n::INT AS line_no FROM w JOIN b USING (doc_id) WHERE length(s) > 0 AND length(s) <= 80 AND NOT regexp_matches(s, '[.!?。！？:;,]$') AND NOT regexp_matches(s, '[.·․‥…]{{4,}}') AND (regexp_matches(s, '^\d+(\.\d+)+\.?\s+\S')
  OR (NOT regexp_matches(s, '[가-힣ᄀ-ᇿ㄰-㆏一-鿿]') AND ((upper(s) = s AND lower(s) <> s AND k <= 12) OR (regexp_matches(s, '\p{{Lu}}') AND NOT regexp_matches(s, '(^|[^\p{{L}}])\p{{Ll}}') AND NOT regexp_matches(s, '\p{{L}}\p{{Lu}}') AND k <= 8 AND NOT regexp_matches(after, '^\p{{Ll}}')))))
  OR (length(text) <= 80 AND (size > body * 1.15 OR bold))"""


def a13_readability(spark, d):
    bad = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("(cid:12)(cid:7)"), "text")).otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.round(tx.cid_garbage_ratio(bad), 9).alias("cid_ratio"), F.length(tx.squeeze(bad)).alias("squeezed"))


A13 = r"""SELECT doc_id, round(CASE WHEN n + rest > 0 THEN n / (n + rest) ELSE 0.0 END, 9)::DOUBLE AS cid_ratio, length(trim(regexp_replace(t, '\s+', ' ', 'g')))::INT AS squeezed FROM (
  SELECT doc_id, t, len(regexp_extract_all(t, '\(cid:\d+\)')) AS n, length(regexp_replace(t, '\(cid:\d+\)', '', 'g')) AS rest FROM (
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '(cid:12)(cid:7)' || text ELSE text END AS t FROM documents))"""


def a14_sanitize(spark, d):
    dirty = F.concat(F.lit("\x07"), F.substring("text", 1, 40), F.lit("\x1b\t\x0b"), F.expr("substring(text, 41)"))
    return read(spark, d, "documents").select("doc_id", tx.clean_text(dirty).alias("text"))


A14 = r"""SELECT doc_id, regexp_replace(chr(7) || substring(text, 1, 40) || chr(27) || chr(9) || chr(11) || substring(text, 41), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS text FROM documents"""


def a15_upload_validation(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("txt", "pdf", "exe", "docx", "csv", "md", "xlsx")])
    files = read(spark, d, "documents").select("doc_id", F.concat(F.lit("in/f"), "doc_id", F.lit("."), F.element_at(kinds, (F.col("doc_id") % 7 + 1).cast("int"))).alias("path"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("%PDF-"), F.substring("text", 1, 50))).otherwise(F.substring("text", 1, 50)).cast("binary").alias("content"), F.lit(None).cast("string").alias("content_type"))
    return src.validated_uploads(files).select("doc_id", "file_type", F.coalesce("problem", F.lit("")).alias("problem"))


A15 = """SELECT doc_id, k AS file_type, CASE WHEN k = 'exe' THEN 'extension' WHEN k = 'pdf' AND doc_id % 2 = 1 THEN 'magic bytes' WHEN k IN ('docx', 'xlsx') THEN 'magic bytes'
  WHEN k IN ('txt', 'md', 'csv') AND doc_id % 2 = 0 THEN 'magic bytes' ELSE '' END AS problem
FROM (SELECT doc_id, ['txt', 'pdf', 'exe', 'docx', 'csv', 'md', 'xlsx'][(doc_id % 7 + 1)::INT] AS k FROM documents)"""


def a18_duplicate_hash(spark, d):
    return listings.duplicate_files(read(spark, d, "documents").select("doc_id", F.col("source").alias("scope"), F.col("text").alias("content"))).withColumnRenamed("scope", "source")


A18 = "SELECT sha256(text) AS sha256, source, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1"


def a19_folder_path(spark, d):
    deep = F.concat_ws("/", *[F.lit(x) for x in "abcdefghij"])
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(deep, F.lit("/f.txt"))).when(F.col("doc_id") % 4 == 1, F.lit("f.txt")).otherwise(F.concat("source", F.lit("//"), "lang", F.lit("/f.txt")))
    return read(spark, d, "documents").select("doc_id", src.folder_path(path).alias("folder"))


A19 = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '/a/b/c/d/e/f/g/h/' WHEN doc_id % 4 = 1 THEN '/' ELSE '/' || source || '/' || lang || '/' END AS folder FROM documents"""


def c1_sentences(spark, d):
    s = read(spark, d, "documents").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("chars"))


C1 = r"""SELECT doc_id, count(*) AS sentences, sum(length(s))::BIGINT AS chars FROM (
  SELECT doc_id, regexp_replace(unnest(string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1))), '^\s+|\s+$', '', 'g') AS s FROM documents) WHERE s <> '' GROUP BY doc_id"""


def c7_fixed_windows(spark, d):
    return base.chunks(spark, d).select("doc_id", "chunk_index", "char_count", F.md5(F.col("content").cast("binary")).alias("digest"))


C7 = f"WITH {base.CHUNKS} SELECT doc_id, chunk_index, length(content)::INT AS char_count, md5(content) AS digest FROM chunks"


def _numbered_lines(spark, d):
    """Every line of a document as a block, twenty to a page and seven to a section."""
    n = F.col("block_no")
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    return lines.select("doc_id", "block_no", "text", F.floor(n / 20).cast("int").alias("page"), F.concat(F.lit("s"), F.floor(n / 7)).alias("section"))


def c7_blocks(spark, d):
    """Windows with the block, page and section that they begin in."""
    found = chunking.fixed_blocks(_numbered_lines(spark, d), base.SIZE, base.OVERLAP)
    return found.select("doc_id", "chunk_index", F.md5(F.col("content").cast("binary")).alias("digest"), "block_no", "page", "section")


_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
C7_BLOCKS = rf"""WITH {base.CHUNKS}, w AS (SELECT *, length(content) - length(regexp_replace(content, '^{_SPACE}+', '')) AS lead FROM chunks),
b AS (SELECT doc_id, w.chunk_index, content, left(text, w.chunk_index * {base.SIZE - base.OVERLAP} + lead) AS before FROM w JOIN documents USING (doc_id) WHERE lead < length(content)),
n AS (SELECT doc_id, chunk_index, content, length(before) - length(replace(before, chr(10), '')) AS block_no FROM b)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1)::INT AS chunk_index, md5(content) AS digest, block_no::INT AS block_no, (block_no // 20)::INT AS page, 's' || block_no // 7 AS section FROM n"""


def c7_token_windows(spark, d):
    """The same windows with at most 120 tokens: what is over the bound is split again, each part with its own block."""
    found = chunking.fixed_blocks(_numbered_lines(spark, d), base.SIZE, base.OVERLAP, max_tokens=120)
    return found.select("doc_id", "chunk_index", "tokens", "char_count", F.md5(F.col("content").cast("binary")).alias("digest"), "block_no", "page", "section")


def c6_size_bounded(spark, d):
    return chunking.chunk_blocks(src.text_blocks(_marked(spark, d)))


def c8_neighbour_similarity(spark, d):
    rows = read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("doc_id"), (F.col("vec_id") % 10).alias("chunk_index"), "embedding")
    return chunking.neighbour_similarity(rows).select("doc_id", "chunk_index", F.round("similarity", 6).alias("similarity"))


C8 = """SELECT doc_id, chunk_index, round(list_cosine_similarity(before::DOUBLE[], embedding::DOUBLE[]), 6) AS similarity FROM (
  SELECT vec_id // 10 AS doc_id, vec_id % 10 AS chunk_index, embedding, lag(embedding) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS before FROM embeddings)"""


def c8_semantic_chunks(spark, d):
    """Neighbouring chunks of a document joined where their vectors are near and both bounds hold."""
    c = base.chunks(spark, d).join(base.chunk_vectors(spark, d).withColumnRenamed("item", "chunk_id"), "chunk_id")
    return chunking.chunk_semantic(c.select("doc_id", "chunk_index", "content", "embedding"), threshold=0.9, target_chars=2400).select("doc_id", "chunk_index", "token_count", "joined")


def c9_cosine(spark, d):
    e = read(spark, d, "embeddings")
    return e.alias("a").join(e.alias("b"), F.col("a.vec_id") + 1 == F.col("b.vec_id")).select(F.col("a.vec_id").alias("vec_id"), F.round(vx.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"))


C9 = "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id"


def c10_row_bundles(spark, d):
    p = read(spark, d, "part").withColumn("doc_id", F.col("p_partkey") % 20)
    rows = p.select("doc_id", F.col("p_partkey").cast("int").alias("block_no"), src.row_line(["p_name", "p_brand", "p_size"]).alias("text"), F.lit("paragraph").alias("block_type"), F.col("p_brand").alias("section"))
    return chunking.chunk_blocks(rows, max_tokens=60, strategy="rows")


#: Every fifth line opens a section of a made-up classification.
_TABLE = {"strategy": "classification_table", "marker": r"^\[C(?P<class_no>\d+)/(?P<code>G\d+)\]\s*(?P<name>\w*)", "head_line": "{name} is in class {class_no}, code {code}.", "break_before": "De "}


def _goods(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "line"))
    mark = F.concat(F.lit("[C"), F.col("block_no") % 9, F.lit("/G"), F.col("doc_id") % 50, F.lit("] "), F.regexp_extract("line", r"^(\w*)", 1))
    text = F.when(F.col("block_no") % 5 == 1, mark).otherwise(F.col("line"))
    return lines.select("doc_id", "block_no", text.alias("text"), F.lit("paragraph").alias("block_type"), F.lit(None).cast("string").alias("section"))


def c11_table_sections(spark, d):
    found = tables.sections(_goods(spark, d), tables.resolve_table(_TABLE))
    return found.groupBy("doc_id", "run_no").agg(F.count("*").alias("blocks"), F.max("marker").alias("marker"), F.max("head").alias("head"))


C11 = r"""WITH l AS (SELECT doc_id, n, CASE WHEN n % 5 = 1 THEN '[C' || n % 9 || '/G' || doc_id % 50 || '] ' || regexp_extract(line, '^(\w*)', 1) ELSE line END AS text, regexp_extract(line, '^(\w*)', 1) AS name FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents)),
r AS (SELECT *, sum((n % 5 = 1 OR starts_with(text, 'De '))::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)::BIGINT AS run_no FROM l)
SELECT doc_id, run_no, count(*) AS blocks, max(CASE WHEN n % 5 = 1 THEN trim(text) END) AS marker, max(CASE WHEN n % 5 = 1 THEN CASE WHEN name <> '' THEN name || ' is in class ' || n % 9 || ', code G' || doc_id % 50 || '.' ELSE '' END END) AS head FROM r GROUP BY ALL"""


def c11_classification_chunks(spark, d):
    return tables.chunk_tables(_goods(spark, d), tables.resolve_table(_TABLE), 400, 600)


#: Provisions of the texts: a line's first letter is its number.
_NUMBERED = {"strategy": "hierarchical", "levels": [["part", r"^(?P<n>[AEIOU])"]], "citations": [r"(?:^| )(?P<part>the) "]}


def _told(spark, d):
    return read(spark, d, "documents").filter("doc_id % 10 < 2").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "reference_dependent").otherwise("no such").alias("override")).distinct()


def c23_fallback(spark, d):
    """Which documents of a hierarchical collection are cut by their numbers, and which as anywhere else."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    made = ingest.chunk_documents(docs, _NUMBERED, _told(spark, d), least=3, high=(0.2, 0.3), low=(0.05, 0.1))
    return made.select("doc_id", "strategy").distinct()


C23 = r"""WITH l AS (SELECT doc_id, n, line, regexp_matches(line, '^[AEIOU]') AS own FROM (SELECT doc_id, n, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents))),
o AS (SELECT *, sum((own OR coalesce(lag_, true))::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS b FROM (SELECT *, lag(own OR line = '') OVER (PARTITION BY doc_id ORDER BY n) AS lag_ FROM l)),
p AS (SELECT doc_id, b, string_agg(line, ' ' ORDER BY n) AS text FROM o WHERE line <> '' GROUP BY ALL),
c AS (SELECT doc_id, count(*) AS nb, count_if(regexp_matches(text, '^[AEIOU]')) AS ns, count_if(regexp_matches(text, '(?:^| )the ')) AS nc FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 10 = 0 OR (ns >= 3 AND ns / nb >= 0.2 AND nc / nb >= 0.3) THEN 'hierarchical' ELSE 'size' END AS strategy FROM c"""


def c19_detect(spark, d):
    b = src.text_blocks(_marked(spark, d))
    out = chunking.detect(b, "^[AEIOU]", "(?:^| )the ", least=3, high=(0.2, 0.3), low=(0.05, 0.1))
    return out.select("doc_id", "n_blocks", "n_spine", "n_cited", F.round("spine_ratio", 6).alias("spine_ratio"), F.round("citation_ratio", 6).alias("citation_ratio"), "verdict", "character")


C19 = f"""WITH {_MARKED}, {_BLOCKS}, n AS (SELECT doc_id, count(*) AS n_blocks, count_if(regexp_matches(text, '^[AEIOU]'))::BIGINT AS n_spine,
  count_if(block_type <> 'heading' AND regexp_matches(text, '(?:^| )the '))::BIGINT AS n_cited FROM blocks GROUP BY doc_id),
v AS (SELECT *, CASE WHEN n_spine < 3 OR (n_spine / n_blocks < 0.05 AND n_cited / n_blocks < 0.1) THEN 'none' WHEN n_spine / n_blocks >= 0.2 AND n_cited / n_blocks >= 0.3 THEN 'high' ELSE 'ambiguous' END AS verdict FROM n)
SELECT doc_id, n_blocks, n_spine, n_cited, round(n_spine / n_blocks, 6) AS spine_ratio, round(n_cited / n_blocks, 6) AS citation_ratio, verdict, CASE verdict WHEN 'high' THEN 'reference_dependent' ELSE 'self_contained' END AS character FROM v"""


def c24_sentence_units(spark, d):
    u = base.chunks(spark, d).select("chunk_id", F.explode(tx.sentences(F.col("content"))).alias("unit")).filter(F.length("unit") >= 20)
    return u.groupBy("unit").agg(F.count_distinct("chunk_id").alias("parents"), F.min("chunk_id").alias("first_parent"))


C24 = rf"""WITH {base.CHUNKS}, u AS (SELECT chunk_id, regexp_replace(unnest(string_split(regexp_replace(content, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1))), '^\s+|\s+$', '', 'g') AS unit FROM chunks)
SELECT unit, count(DISTINCT chunk_id) AS parents, min(chunk_id) AS first_parent FROM u WHERE length(unit) >= 20 GROUP BY unit"""


def d1_simple_tokens(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.explode(tx.simple_tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).filter("docs > 1")


D1 = f"WITH {base.words_sql('documents', 'doc_id', 'text', 'words')} SELECT w AS token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM words GROUP BY w HAVING count(DISTINCT doc_id) > 1"


def d2_bigrams(spark, d):
    return read(spark, d, "documents").select(F.explode(tx.bigram_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


D2 = f"WITH {base.words_sql('documents', 'doc_id', 'text', 'words')}, {base.bigrams_sql('words', 'doc_id', 'terms')} SELECT term, count(*) AS n FROM terms GROUP BY term"


def d4_stems_ngrams(spark, d):
    t = read(spark, d, "benchmark").select("item_id", F.explode(tx.ngrams(F.col("text"), 3)).alias("gram"))
    return t.groupBy("item_id").agg(F.count("*").alias("grams"), F.count_distinct("gram").alias("distinct_grams"))


D4 = f"""WITH {base.words_sql('benchmark', 'item_id', 'text', 'words')}, g AS (SELECT item_id, unnest(CASE WHEN length(w) <= 3 THEN [w] ELSE [substring(w, i, 3) for i in range(1, length(w) - 1)] END) AS gram FROM words)
SELECT item_id, count(*) AS grams, count(DISTINCT gram) AS distinct_grams FROM g GROUP BY item_id"""


QUERIES = {f.__name__: (f, sql) for f, sql in ((a2_text_blocks, A2), (a3_html_blocks, None), (a5_row_serialise, A5), (a8_page_lines, A8), (a9_column_gutters, A9), (a10_furniture, A10), (a11_body_size, A11), (a12_headings, A12), (a13_readability, A13), (a14_sanitize, A14), (a15_upload_validation, A15), (a18_duplicate_hash, A18), (a19_folder_path, A19), (c1_sentences, C1), (c6_size_bounded, None), (c7_fixed_windows, C7), (c7_blocks, C7_BLOCKS), (c7_token_windows, None), (c8_neighbour_similarity, C8), (c8_semantic_chunks, None), (c9_cosine, C9), (c10_row_bundles, None), (c11_table_sections, C11), (c11_classification_chunks, None), (c23_fallback, C23), (c19_detect, C19), (c24_sentence_units, C24), (d1_simple_tokens, D1), (d2_bigrams, D2), (d4_stems_ngrams, D4))}
