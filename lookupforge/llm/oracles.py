"""SQL for the operators that SQL can express, over all rows, for DuckDB.

Components are closures of the links (a row for each two documents of a group), so these serve tables of the size of the
tests', not the large ones.
"""

from __future__ import annotations

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _words(name: str, table: str, key: str, text: str, pattern: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT {key}, coalesce(regexp_extract_all({text}, '{pattern}'), []) AS w FROM {table})"


def _components(nodes: str, key: str) -> str:
    """``reach``: the smallest key that each of ``nodes`` reaches through ``links`` (u, v), both ways."""
    return f"both_ AS MATERIALIZED (SELECT u, v FROM links UNION SELECT v, u FROM links), walk(a, b) AS (SELECT {key}, {key} FROM {nodes} UNION SELECT walk.a, both_.v FROM walk JOIN both_ ON walk.b = both_.u), reach AS (SELECT a AS {key}, min(b) AS component_id FROM walk GROUP BY a)"


OP1_SQL = f"""
WITH {_words('d', 'documents', 'doc_id', _LOW.format('text'), _ALNUM)},
{_words('b', 'benchmark', 'item_id', _LOW.format('text'), _ALNUM)},
win AS MATERIALIZED (SELECT DISTINCT item_id, list_slice(w, i, i + least(13, len(w)) - 1) AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT len(x) AS n FROM win) WHERE len(w) >= n),
hits AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS x FROM spots) JOIN win USING (x)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP2_SQL = f"""
WITH RECURSIVE ok AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
{_components('embeddings', 'vec_id')},
n AS (SELECT u AS vec_id, count(*) AS n FROM both_ GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM reach LEFT JOIN n USING (vec_id)
"""

OP6_SQL = f"""
WITH RECURSIVE {_words('d', 'documents', 'doc_id', _LOW.format('text'), _WORD)},
sh AS MATERIALIZED (SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT u, v FROM shared JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * c >= 80 * (p.n + q.n - c)),
{_components('d', 'doc_id')}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM reach LEFT JOIN n USING (doc_id)
"""

OP8_SQL = f"""
WITH {_words('d', 'documents', 'doc_id', 'text', _WORD)},
win AS MATERIALIZED (SELECT doc_id, i, hash(x) AS h, sha256(array_to_string(x, ' ')) AS s FROM (SELECT doc_id, i, list_slice(w, i, i + 34) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35))),
again AS (SELECT h, s FROM win GROUP BY h, s HAVING count(*) > 1),
gone AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(flatten(list(range(i, i + 35))))) AS p FROM win JOIN again USING (h, s) GROUP BY doc_id),
words AS (SELECT d.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d JOIN gone USING (doc_id)),
lost AS (SELECT doc_id, unnest(p) AS i FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed, sha256(CASE WHEN p IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
