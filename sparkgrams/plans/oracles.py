"""DuckDB SQL for the registered queries."""

from __future__ import annotations


def grams(source: str, n: int, left: str = "", right: str = "") -> str:
    """CTEs ``t`` (text, p: padded) and ``k`` (text, len, g, c)."""
    return f"""t AS (SELECT DISTINCT text, '{left}' || text || '{right}' AS p FROM ({source}) WHERE text IS NOT NULL),
    gr AS (SELECT text, length(p) AS len, unnest(list_transform(range(1, length(p) - {n} + 2), lambda i: substring(p, i, {n}))) AS g FROM t),
    k AS (SELECT text, len, g, CAST(count(*) AS INTEGER) AS c FROM gr GROUP BY ALL)"""


def counted(source: str, n: int, left: str = "", right: str = "") -> str:
    return f"WITH {grams(source, n, left, right)} SELECT text, g AS gram, c AS cnt FROM k"


def sim(warp: float, same: str = "same", al: str = "al") -> str:
    """Of exact integers for 1, 2 and 3."""
    rest = f"({al} - {same})"
    if warp == 1:
        value = f"CAST({same} AS DOUBLE) / CAST({al} AS DOUBLE)"
    elif warp in (2, 3):
        power = " * ".join([al] * int(warp))
        value = f"CAST({power} - {' * '.join([rest] * int(warp))} AS DOUBLE) / CAST({power} AS DOUBLE)"
    else:
        value = f"(pow({al}, {warp}) - pow({rest}, {warp})) / pow({al}, {warp})"
    return f"CASE WHEN {al} = 0 THEN 0.0 ELSE {value} END"


NAMES = "SELECT p_name AS text FROM part"
VOCABULARY = r"SELECT unnest(string_split_regex(text, '\s+')) AS text FROM documents"
WORDS = f"SELECT text FROM ({VOCABULARY}) WHERE text <> ''"
NAME_GRAMS = grams(NAMES, 2, " ", " ")
FIRST = "split_part(p_name, ' ', 1)"
PAIRS = f"""WITH {NAME_GRAMS},
    n AS (SELECT DISTINCT p_name, {FIRST} AS f FROM part),
    q AS (SELECT x.p_name AS a, y.p_name AS b FROM n x JOIN n y USING (f)),
    s AS (SELECT x.text AS a, y.text AS b, CAST(sum(least(x.c, y.c)) AS BIGINT) AS same FROM k x JOIN k y USING (g) GROUP BY ALL),
    z AS (SELECT q.a, q.b, coalesce(same, 0) AS same, CAST(length(q.a) + 2 + length(q.b) + 2 - 2 - coalesce(same, 0) AS BIGINT) AS al
          FROM q LEFT JOIN s ON q.a = s.a AND q.b = s.b)"""


ALL_PAIRS = PAIRS.replace("JOIN n y USING (f)", "CROSS JOIN n y")


def pair_sim(warp: float, digits: int | None = None) -> str:
    value = sim(warp)
    return f"{PAIRS} SELECT a, b, {value if digits is None else f'round({value}, {digits})'} AS sim FROM z"


def searched(ctes: str, query: str, n: int, left: str, right: str, warp: float, threshold: float, limit: int, digits: int | None = None) -> str:
    """Words of CTE ``k`` for one (transformed) query."""
    value = sim(warp)
    return f"""WITH {ctes},
    q AS (SELECT '{left}{query}{right}' AS p),
    qg AS (SELECT length(p) AS ql, unnest(list_transform(range(1, length(p) - {n} + 2), lambda i: substring(p, i, {n}))) AS g FROM q),
    qk AS (SELECT ql, g, count(*) AS qc FROM qg GROUP BY ALL),
    m AS (SELECT text, len, ql, CAST(sum(least(c, qc)) AS BIGINT) AS same FROM k JOIN qk USING (g) GROUP BY ALL),
    z AS (SELECT text, same, CAST(len + ql - {2 * n - 2} - same AS BIGINT) AS al FROM m),
    v AS (SELECT text, {value} AS similarity FROM z)
    SELECT text, {'similarity' if digits is None else f'round(similarity, {digits}) AS similarity'} FROM v
    WHERE CAST(similarity AS FLOAT) >= CAST({threshold} AS FLOAT) ORDER BY v.similarity DESC, text LIMIT {limit}"""


def by_name(query: str, threshold: float, limit: int, warp: float = 2, digits: int | None = None) -> str:
    return searched(NAME_GRAMS, query, 2, " ", " ", warp, threshold, limit, digits)


def url_join(threshold: float, columns: str) -> str:
    return f"""WITH {grams('SELECT url AS text FROM pages', 2, ' ', ' ')},
    m AS (SELECT x.text AS a, y.text AS b, x.len AS la, y.len AS lb, CAST(sum(least(x.c, y.c)) AS BIGINT) AS same
          FROM k x JOIN k y USING (g) WHERE x.text < y.text GROUP BY ALL),
    z AS (SELECT a, b, same, CAST(la + lb - 2 - same AS BIGINT) AS al FROM m),
    v AS (SELECT a, b, same AS n_same, al AS n_all, {sim(2)} AS sim FROM z)
    SELECT {columns} FROM v WHERE CAST(sim AS FLOAT) >= CAST({threshold} AS FLOAT)"""


_PADDED_NAMES = f"SELECT DISTINCT p_name AS text, ' ' || p_name || ' ' AS p FROM part"
_TYPE_NAMES = "SELECT lower(p_type) AS text FROM part"
_CLEAN_URLS = "SELECT lower(regexp_replace(url, '^.*?://', '')) AS text FROM pages"
_REGIONS = "SELECT r_name AS text FROM region"
_NATIONS = "SELECT n_name AS text FROM nation"
_MIXED = f"""t AS (SELECT r_name AS text, CASE WHEN r_regionkey = 1 THEN '--' || r_name || '++' ELSE ' ' || r_name || ' ' END AS p FROM region
                  UNION ALL SELECT ' ' || r_name || ' ', ' ' || r_name || ' ' FROM region),
    u AS (SELECT min(text) AS text, p FROM t GROUP BY p),
    gr AS (SELECT text, length(p) AS len, unnest(list_transform(range(1, length(p)), lambda i: substring(p, i, 2))) AS g FROM u),
    k AS (SELECT text, len, g, count(*) AS c FROM gr GROUP BY ALL)"""
_ZERO = f"""WITH {grams(_REGIONS, 3)},
    k2 AS (SELECT text, g, count(*) AS c FROM (SELECT text, unnest(list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3))) AS g
           FROM (SELECT DISTINCT n_name AS text FROM nation)) GROUP BY ALL),
    q AS (SELECT r_name AS a, n_name AS b FROM region JOIN nation ON r_regionkey = n_regionkey),
    s AS (SELECT k.text AS a, k2.text AS b, CAST(sum(least(k.c, k2.c)) AS BIGINT) AS same FROM k JOIN k2 USING (g) GROUP BY ALL),
    z AS (SELECT q.a, q.b, coalesce(same, 0) AS same,
                 CASE WHEN least(length(q.a), length(q.b)) < 3 THEN 0 ELSE CAST(length(q.a) + length(q.b) - 4 - coalesce(same, 0) AS BIGINT) END AS al
          FROM q LEFT JOIN s ON q.a = s.a AND q.b = s.b)
    SELECT a, b, {sim(2)} AS sim FROM z"""
def batch(words: str, queries: str, threshold: float) -> str:
    return rf"""WITH {grams(words, 2, ' ', ' ')},
    q AS (SELECT DISTINCT w AS query, ' ' || w || ' ' AS p FROM ({queries}) WHERE w <> ''),
    qg AS (SELECT query, length(p) AS ql, unnest(list_transform(range(1, length(p)), lambda i: substring(p, i, 2))) AS g FROM q),
    qk AS (SELECT query, ql, g, count(*) AS qc FROM qg GROUP BY ALL),
    m AS (SELECT query, text, len, ql, CAST(sum(least(c, qc)) AS BIGINT) AS same FROM k JOIN qk USING (g) GROUP BY ALL),
    z AS (SELECT query, text, same, CAST(len + ql - 2 - same AS BIGINT) AS al FROM m),
    v AS (SELECT query, text, {sim(2)} AS similarity FROM z),
    r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, text) AS rank, text, similarity FROM v
          WHERE CAST(similarity AS FLOAT) >= CAST({threshold} AS FLOAT))
    SELECT * FROM r WHERE rank <= 3"""


def single(found: str) -> str:
    """Similarities as 32-bit floats, to four places."""
    return f"SELECT text, round(CAST(CAST(similarity AS FLOAT) AS DOUBLE), 4) AS similarity FROM ({found})"


_BENCHMARK = r"SELECT unnest(string_split_regex(text, '\s+')) AS w FROM benchmark"
_REPR = "Corpus(GramConfig(arity=2, pad_left=Pad(kind='auto', literal=''), pad_right=Pad(kind='auto', literal='')), transformers=['lower'], words=struct<text:string,text_padded:string,arity:int,n_chars:int>)"
_EMOJI = "SELECT unnest(['😏🍆', 'ba', 'cd']) AS text"

ORACLES = {
    "gram_counts_a2_auto": counted(NAMES, 2, " ", " "),
    "gram_counts_a1_nopad": counted(NAMES, 1),
    "gram_counts_a3_auto": counted(NAMES, 3, "  ", "  "),
    "gram_counts_a5": counted(_REGIONS, 5),
    "gram_counts_custom_pad": counted(_NATIONS, 2, "--", "++"),
    "gram_counts_left_only": counted(_NATIONS, 2, " "),
    "gram_counts_arity_clamped": counted(_REGIONS, 1),
    "count_grams_total": f"SELECT text, CAST(length(p) - 1 AS BIGINT) AS n FROM ({_PADDED_NAMES})",
    "count_gram_lookup": f"SELECT text, CAST(len(list_filter(list_transform(range(1, length(p)), lambda i: substring(p, i, 2)), lambda g: g = 'd ')) AS BIGINT) AS n FROM ({_PADDED_NAMES})",
    "contains_filter": f"SELECT text FROM ({_PADDED_NAMES}) WHERE contains(p, 'ge')",
    "gram_is_empty": "SELECT r_name AS text, length(r_name) < 5 AS empty FROM region",
    "gram_count_unicode": f"WITH {grams('SELECT text FROM benchmark', 3)} SELECT item_id, g AS gram, c AS cnt FROM benchmark JOIN k USING (text)",
    "distinct_ngrams": "SELECT DISTINCT p_type AS text, s || p_type || s AS text_padded, CAST(a AS INTEGER) AS arity, CAST(length(p_type) + 2 * length(s) AS INTEGER) AS n_chars FROM part, (VALUES (2, ' '), (3, '  ')) v(a, s)",
    "pair_counts": f"{PAIRS} SELECT a, b, same AS n_same, al AS n_all, al - same AS n_diff FROM z",
    "pair_similarity_w1": pair_sim(1),
    "pair_similarity_w2": pair_sim(2),
    "pair_similarity_w3": pair_sim(3),
    "pair_similarity_w25": pair_sim(2.5, 6),
    "warp_clamp": f"{PAIRS} SELECT a, b, {sim(1)} AS low, {sim(3)} AS high FROM z",
    "matches_threshold_zero": _ZERO,
    "matches_threshold": f"{ALL_PAIRS}, v AS (SELECT a, b, {sim(2)} AS sim FROM z) SELECT a, b, sim FROM v WHERE CAST(sim AS FLOAT) >= CAST(0.6 AS FLOAT)",
    "postings": f"WITH {grams(WORDS, 2, ' ', ' ')} SELECT g AS gram, text, CAST(len AS INTEGER) AS n_chars, c AS cnt FROM k",
    "gram_df_topk": f"WITH {grams(WORDS, 2, ' ', ' ')} SELECT g AS gram, count(*) AS df FROM k GROUP BY g ORDER BY df DESC, gram LIMIT 20",
    "search_topk": by_name("red wigdet", 0.25, 10),
    "search_warp": by_name("red wigdet", 0.25, 10, 1.5, 6),
    "search_limit": by_name("cold rign", 0.1, 3),
    "search_threshold_zero": by_name("zq wi", 0.0, 1000),
    "search_case_insensitive": searched(grams(_TYPE_NAMES, 2, " ", " "), "economi", 2, " ", " ", 2, 0.1, 10),
    "search_transform_chain": searched(grams(_CLEAN_URLS, 2, " ", " "), "www.example.org/en/", 2, " ", " ", 2, 0.3, 10),
    "search_vocab": searched(grams(WORDS, 2, " ", " "), "pathetik", 2, " ", " ", 2, 0.4, 10),
    "batch_search_topk": batch(WORDS, _BENCHMARK, 0.7),
    "key_lookup": "SELECT q AS query FROM (SELECT r_name AS q FROM region UNION ALL SELECT upper(n_name) FROM nation) WHERE lower(q) IN (SELECT lower(n_name) FROM nation)",
    "corpus_is_empty": "SELECT 'full' AS corpus, count(*) = 0 AS empty FROM region UNION ALL SELECT 'none', count(*) = 0 FROM region WHERE r_regionkey < 0",
    "add_text_incremental": searched(grams(f"{_REGIONS} UNION ALL {_NATIONS}", 2, " ", " "), "AMERIKA", 2, " ", " ", 2, 0.05, 10),
    "add_ngram_mixed_pad": searched(_MIXED, "AMERICA", 2, " ", " ", 2, 0.1, 10),
    "url_similarity_join": url_join(0.5, "a, b, n_same, n_all, sim"),
    "url_similarity_join_pruned": url_join(0.8, "a, b, sim"),
    "corpus_roundtrip": f"WITH {NAME_GRAMS} SELECT g AS gram, text, CAST(len AS INTEGER) AS n_chars, c AS cnt FROM k",
    "saved_corpus_grows": searched(grams(f"SELECT lower(text) AS text FROM ({_REGIONS} UNION ALL {_NATIONS})", 2, " ", " "), "natiom 1", 2, " ", " ", 2, 0.2, 10),
    "fill_par": f"WITH {grams(f'{_REGIONS} UNION ALL {_NATIONS}', 2, ' ', ' ')} SELECT g AS gram, text, CAST(len AS INTEGER) AS n_chars, c AS cnt FROM k",
    "search_par": single(by_name("red wigdet", 0.25, 10)),
    "search_with_warp_par": single(by_name("old wigdet", 0.2, 10, 1.5)),
    "identity_transformer": by_name("cold rign", 0.3, 10),
    "pandas_transformer": searched(grams("SELECT reverse(r_name) AS text FROM region", 2, " ", " "), "AKIREMA", 2, " ", " ", 2, 0.05, 10),
    "corpus_repr": "SELECT '" + _REPR.replace("'", "''") + "' AS value",
    "emoji_search": searched(grams(_EMOJI, 1), "🍆d", 1, "", "", 2, 0.3, 10),
    "streamed_searches": batch(f"{_REGIONS} UNION ALL {_NATIONS}", "SELECT n_name AS w FROM nation", 0.6),
    "streamed_corpus": f"SELECT DISTINCT text, ' ' || text || ' ' AS text_padded, CAST(2 AS INTEGER) AS arity, CAST(length(text) + 2 AS INTEGER) AS n_chars FROM ({_REGIONS} UNION ALL {_NATIONS})",
}
