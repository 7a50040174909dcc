"""SQL that gives the rows of the operators that SQL can express, without their methods: all pairs, all windows."""

from __future__ import annotations

_COMPONENTS = """reach AS (SELECT a AS x, a AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a), comp AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x)"""

NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.98), {_COMPONENTS},
n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN comp ON comp.id = vec_id"""

_SPLIT = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(text=_LOWER)} AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)), {_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = d.doc_id"""

SUBSTRINGS = f"""WITH w AS MATERIALIZED (SELECT doc_id, {_SPLIT.format(text="coalesce(text, '')")} AS t FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(t) - 18)) AS i, t FROM w WHERE len(t) >= 20), g AS MATERIALIZED (SELECT doc_id, i, array_to_string(t[i:i + 19], ' ') AS g FROM x),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS p FROM later), word AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS p, unnest(t) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(t) AS n_words, len(t) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
