"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES, template_pattern
from .queries import URL_RULES

_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)

OP5 = f"""
WITH r(rh, rp, v) AS (VALUES {_RULES}),
p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM p),
u AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT page_id, rh || rp AS rule, v,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS n
      FROM u JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND prefix(path, rp))
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.n = 1
"""

OP9 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0),
d AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id,
             CAST(list_sum(list_transform(list_zip(q.b, n.b), lambda p: CASE WHEN p[1] = p[2] THEN 0 ELSE 1 END)) AS INTEGER) AS distance
      FROM (SELECT * FROM e WHERE vec_id % 100 = 0) q JOIN e n ON q.vec_id <> n.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS n FROM d)
SELECT query_id, CAST(n AS INTEGER) AS rank, neighbor_id, distance FROM r WHERE n <= 10
"""

def _words(text: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


OP1 = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
k AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d)),
m AS (SELECT h, min(doc_id) AS lo FROM k GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM (SELECT doc_id, s FROM k JOIN m USING (h) WHERE lo < doc_id)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM x ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(t.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, here) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.here = e.a),
c AS (SELECT id, min(here) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON d.doc_id = c.id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def _places(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"w[i + {n}] = '{word}'" for n, word in enumerate(words))
    return f"list_filter(range(1, len(w) + 2 - {len(words)}), lambda i: {same})"


_PLACES = ", ".join(f"{_places(phrase)} AS p{n}" for n, phrase in enumerate(PHRASES))
_ALL_PLACES = f"flatten([{', '.join(f'p{n}' for n in range(len(PHRASES)))}])"
_BASE = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, label in enumerate(PHRASES.values()))
_MORE = ", ".join(f"CASE WHEN regexp_matches(t, '{template_pattern(label, markup)}') THEN '{label}' END" for label, markup in TEMPLATES)
OP2 = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce({_LOWER}, ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t, {_PLACES} FROM d),
l AS (SELECT doc_id, len(w) AS n_words, {_ALL_PLACES} AS places, list_filter([{_BASE}], lambda x: x IS NOT NULL) AS base,
             list_filter([{_MORE}], lambda x: x IS NOT NULL) AS more FROM p)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || more)), ',') AS labels,
       CASE WHEN len(more) > 0 THEN 1.0::DOUBLE WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END AS score
FROM l
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op2_license_scan": OP2, "op3_near_dedup": OP3, "op5_url_filter": OP5, "op9_hamming_topk": OP9}
