"""DuckDB SQL for the results of this package that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"

OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, least(min(b), a) AS root FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

OP7 = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 99)) AS s FROM h WHERE len(x) >= 200),
k AS (SELECT p.doc_id, s, hash(substring(x, 2 * s + 1, 200)) AS g FROM p JOIN h USING (doc_id)),
f AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM k) WHERE n > 1),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS new FROM f)),
spans AS (SELECT doc_id, island, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY ALL),
gaps AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, -1, 0 FROM h)),
kept AS (SELECT doc_id, string_agg(substring(x, 2 * g.a + 1, 2 * (coalesce(g.b, len(x) // 2) - g.a)), '' ORDER BY g.a) AS y FROM gaps g JOIN h USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(y)) AS kept_sha256
FROM h LEFT JOIN t USING (doc_id) JOIN kept USING (doc_id)"""

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY r),
lines AS (SELECT r, host, text, CASE WHEN regexp_matches(x, '\p{{L}}') THEN trim(regexp_replace(lower(x), '[^\p{{L}}]+', ' ', 'g')) ELSE regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') END AS line, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS chars, x
  FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS x FROM d)),
used AS (SELECT * FROM lines WHERE chars > 0),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM used GROUP BY r),
hosts AS (SELECT host, count(DISTINCT text) AS n_texts FROM d GROUP BY host),
often AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM used GROUP BY ALL) JOIN hosts USING (host) WHERE n > 20 AND n > 0.01 * n_texts),
gone AS (SELECT r, sum(chars) AS removed FROM used JOIN often USING (host, line) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_chars
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND word_chars - removed_chars >= 0.5 * word_chars AS kept FROM m"""

_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP11 = rf"""
WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, {_FOLD}), '{_TERMS}')) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
st AS (SELECT count(DISTINCT r) AS docs, count(*) AS terms FROM t),
d AS (SELECT r, doc_id, count(*) AS n FROM t GROUP BY ALL),
p AS (SELECT r, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, st GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {_FOLD}), '{_TERMS}')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (r), st GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 20"""

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), {_FOLD}) AS line FROM l),
often AS (SELECT line, max(doc_id) AS last_id FROM k WHERE length(line) >= 40 GROUP BY line HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id <> last_id) AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (last_id IS NULL OR doc_id = last_id), '')) AS kept_sha256
FROM k LEFT JOIN often USING (line) GROUP BY r, doc_id"""

_H = ", ".join(f"('0x' || substring(x, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))

OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, text, length(text) AS n, {_H} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""

SQL = {"op6_minhash_near_dup": OP6, "op7_suffix_dedup": OP7, "op10_quality_rules": OP10, "op11_lexical_search": OP11, "op12_line_dedup": OP12, "op13_fill_middle": OP13}
