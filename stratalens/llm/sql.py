"""DuckDB SQL for the rows of the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op2_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS f FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f <> page_id THEN f END AS refers_to
FROM r
"""

SQL["op3_jaccard"] = r"""
WITH RECURSIVE s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
           FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents)),
e AS (SELECT doc_id, len(g) AS n, md5(unnest(g)) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
      HAVING count(*) >= 0.8 * (max(a.n) + max(b.n) - count(*)) - 1e-9),
c AS (SELECT a AS id, a AS c FROM l UNION SELECT l.b, c.c FROM c JOIN l ON c.id = l.a)
SELECT d.doc_id, coalesce((SELECT min(c) FROM c WHERE c.id = d.doc_id), d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE a = d.doc_id) AS n_links FROM documents d
"""

SQL["op6_embeddings"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE label IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (SELECT a AS id, a AS c FROM l UNION SELECT l.b, c.c FROM c JOIN l ON c.id = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, coalesce((SELECT min(c) FROM c WHERE c.id = vec_id), vec_id) AS component_id,
       coalesce((SELECT min(c) FROM c WHERE c.id = vec_id), vec_id) = vec_id AS kept FROM embeddings
"""

SQL["op7_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

SQL["op10_suffixes"] = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, s, md5(b[s + 1:s + 100]) AS x FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 99)) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g
      FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM r)),
p AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM g GROUP BY doc_id, g),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM p),
k AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(hex(b[y + 1:a]), '' ORDER BY a) AS h FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h || hex(b[last + 1:])) END) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
