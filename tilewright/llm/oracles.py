"""DuckDB SQL of the operators whose results it can express by plain means on small tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Everything that can be reached by links (a, b), both ways: a table `reach` of (id, low).
REACH = """closure(id, other) AS (SELECT a, b FROM links UNION SELECT c.id, l.b FROM closure c JOIN links l ON c.other = l.a),
reach AS (SELECT id, least(id, min(other)) AS low FROM closure GROUP BY id)"""

OP1_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT win, min(doc_id) AS first FROM p GROUP BY win),
g AS (SELECT DISTINCT doc_id, i + o AS k FROM p JOIN f USING (win), range(13) r(o) WHERE first < doc_id),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS s FROM t ANTI JOIN g USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

OP3_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
{REACH}, counted AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(low, vec_id) AS component_id, vec_id = coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN counted c ON c.id = vec_id LEFT JOIN reach r ON r.id = vec_id
"""

OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
{REACH}
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low, w.doc_id) AS component_id, w.doc_id = coalesce(low, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach r ON r.id = w.doc_id
"""

# Bytes as pairs of hex digits, since SQL text counts characters; cut from blocks of 500 bytes and the 99 after.
OP7_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, o, substr(h, 1000 * o + 1, 1198) AS part FROM (SELECT doc_id, h, unnest(range(0, (len(h) + 999) // 1000)) AS o FROM t)),
w AS (SELECT doc_id, 500 * o + j AS i, substr(part, 2 * j - 1, 2) AS byte, substr(part, 2 * j - 1, 200) AS win FROM (SELECT *, unnest(range(1, least(500, len(part) // 2) + 1)) AS j FROM k)),
f AS (SELECT doc_id, i, byte, len(win) = 200 AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM w),
c AS (SELECT doc_id, i, byte, coalesce(i - max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < 100, false) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM c),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT t.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM t LEFT JOIN r USING (doc_id)
"""
