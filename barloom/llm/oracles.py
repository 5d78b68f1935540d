"""DuckDB SQL for the corpus queries that SQL can express."""

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SP = r"[\x20\x09-\x0D]"

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM d, unnest(generate_series(1, len(ws) - 2)) g(i)),
twice AS (SELECT doc_id, w FROM x GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM x JOIN twice USING (doc_id, w), unnest(generate_series(i, i + 2)) g(p) GROUP BY 1),
l AS (SELECT doc_id, line, len(string_split(line, ' ')) AS n FROM (SELECT doc_id, unnest(lines) AS line FROM d)),
f AS (SELECT doc_id, length(line) AS size, CASE WHEN NOT regexp_matches(line, '[^\x20\x09-\x0D]') THEN false
  ELSE length(regexp_replace(line, '[^#*$%&|<>»›•→~^=\\_{{}}\[\]]+', '', 'g')) > 0.25 * n
    OR (n >= 5 AND NOT regexp_matches(line, '[.!?…。！？]["''”’)\]]*({_SP}|$)'))
    OR (n >= 10 AND len(regexp_extract_all(line || ' ', '[.!?]{{2,}}{_SP}')) > 0.5 * n)
    OR (n >= 10 AND regexp_matches(line, '[A-Z]{{3}}') AND length(regexp_replace(line, '[^A-Z]+', '', 'g')) > 2 * n)
    OR (n <= 40 AND regexp_matches(lower(line), 'licensed under|is licensed|all rights reserved|copyright \(c\)|©|cookie policy|accept cookies|privacy policy|terms of (use|service)|subscribe to|sign up for|click here|read more|javascript is disabled|powered by'))
  END AS failed FROM l),
lost AS (SELECT doc_id, coalesce(sum(size) FILTER (failed), 0) / greatest(sum(size), 1) AS share FROM f GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SP}+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(lines, lambda z: regexp_matches(z, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda z: regexp_matches(z, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, share FROM d LEFT JOIN rep USING (doc_id) JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND share <= 0.3 AS kept FROM m
"""

_WORDS = rf"regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, ws, least(10, len(ws)) AS n FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM b, unnest(generate_series(1, len(ws) - n + 1)) g(i)),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM d, (SELECT DISTINCT n FROM bw) s, unnest(generate_series(1, len(ws) - n + 1)) g(i)),
h AS (SELECT doc_id, item, i, n FROM dw JOIN bw USING (n, w)),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM h, unnest(generate_series(i, i + n - 1)) g(k) GROUP BY 1),
q AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item)), ',')) AS s FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages),
g AS (SELECT *, list_transform(generate_series(0, 7), lambda k: CAST('0x' || substr(s, CAST(k * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> b) % 32 + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM g
"""

OP12 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_AZ}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_sort(list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 3], ' ')))) END AS g FROM d),
c AS (SELECT min(doc_id) AS r, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT r, n, unnest(g) AS w FROM c),
p AS (SELECT a.r AS a, b.r AS b, a.n + b.n AS total, count(*) AS shared FROM x a JOIN x b ON a.w = b.w AND a.r < b.r GROUP BY 1, 2, 3),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (total - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT r AS a, r AS b FROM c UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM t GROUP BY 1)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN m ON m.a = c.r
"""

OP13 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

ORACLE_SQL = {"op2_quality_rules": OP2, "op3_decontaminate": OP3, "op7_warc": OP7, "op12_jaccard_join": OP12, "op13_hard_negatives": OP13}
