"""DuckDB SQL for the operators that SQL can express; plain and quadratic, for small tables."""

from __future__ import annotations

_REACH = """reach(x, y) AS (SELECT id, id FROM ids UNION SELECT r.x, l.b FROM reach r JOIN sym l ON r.y = l.a),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)"""

NGRAM_JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), ids AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, (SELECT count(*) FROM sym WHERE a = d.doc_id) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON x = d.doc_id"""

EMBEDDING_DEDUP = f"""WITH RECURSIVE r AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
f AS (SELECT vec_id, label, e, list_max(list_transform(e, lambda x: abs(x))) AS m FROM r WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT vec_id, label, list_transform(e, lambda x: x / pow(2, floor(log2(m)))) AS e FROM f WHERE m > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), ids AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT vec_id, (SELECT count(*) FROM sym WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON x = vec_id"""

SUFFIX_DEDUP = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM t)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
m AS (SELECT g.doc_id, g.i FROM g JOIN f ON f.s = g.s WHERE f.first < g.doc_id),
k AS (SELECT doc_id, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 50 THEN 1 ELSE 0 END AS new FROM m),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM k),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
o AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM s),
c AS (SELECT o.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM o JOIN t ON t.doc_id = o.doc_id GROUP BY o.doc_id)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM t LEFT JOIN c ON c.doc_id = t.doc_id"""
