"""SQL for another engine that states what the text queries return, where SQL can say it."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"

SQL = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {ALNUM} AS w FROM benchmark),
p AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS phrase, len(w[i:i + 9]) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT x.doc_id, x.i, x.n, p.item FROM x JOIN p USING (phrase)),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r(doc_id, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op13_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ALNUM} AS w FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, {ALNUM} AS w FROM benchmark),
l AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
t AS (SELECT CAST(count(*) AS BIGINT) AS N, CAST(sum(n) AS BIGINT) AS L FROM l),
p AS (SELECT r, x, count(*) AS tf FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY ALL),
a AS (SELECT q, item_id, x, count(*) AS c FROM (SELECT q, item_id, unnest(w) AS x FROM q) GROUP BY ALL),
f AS (SELECT x, CAST(floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS wt FROM (SELECT x, count(*) AS df FROM p GROUP BY x), t),
s AS (SELECT a.q, a.item_id, l.doc_id, l.r, CAST(sum(a.c * f.wt * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * l.n * t.N) // t.L)))) AS BIGINT) AS score
FROM a JOIN p USING (x) JOIN f USING (x) JOIN l ON l.r = p.r, t GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
}


def _clusters(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """The clustering written out round by round; centroids are rows of components."""
    fine = f"len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE {fine})",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) AS INTEGER) - 1 AS c, v FROM (SELECT v, sha256('1:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v, c, CAST(d AS BIGINT) AS d FROM (SELECT v.r, v.vec_id, v.v, c.c, {far} AS d FROM v, c{i} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x FROM (SELECT c, unnest(v) AS x, unnest(range({dim})) AS i FROM a{i}) GROUP BY c, i) GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (c))")
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (c)"""


SQL["op11_clusters"] = _clusters()
