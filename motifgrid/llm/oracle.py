"""SQL of the training-data queries that SQL can express, over the same tables."""

from __future__ import annotations

from .quality import LEAST_WORDS, MOST_LOST, MOST_REPEATED, NOT_LETTERS, SHORT_WORDS, SIGNS, STOCK, STOCK_PERCENT, WINDOW

_WORD = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), worded AS (
    SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w FROM docs
), windows AS (
    SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS held
    FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM worded WHERE len(w) >= {WINDOW})
), twice AS (
    SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, held) > 1
), covered AS (
    SELECT r, sum(n) AS n FROM (SELECT r, least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -{WINDOW})) AS n FROM twice) GROUP BY r
), lines AS (
    SELECT r, row_number() OVER () AS k, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{_WORD}')
), parts AS (
    SELECT k, i, p[i] AS held, regexp_extract(p[i + 1], '^{_WORD}') AS after
    FROM (SELECT k, p, unnest(range(1, len(p))) AS i FROM (SELECT k, string_split(line, ' ') AS p FROM lines))
), pairs AS (
    SELECT k, i - row_number() OVER (PARTITION BY k ORDER BY i) AS run FROM parts WHERE held = after AND regexp_full_match(held, '{_WORD}')
), stuttered AS (
    SELECT k, sum((n + 1) // 2) AS n FROM (SELECT k, run, count(*) AS n FROM pairs GROUP BY ALL) GROUP BY k
), counted AS (
    SELECT r, line, length(line) - length(replace(line, '|', '')) AS pipes, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
        len(regexp_extract_all(line, '[!?]{{2,}}')) AS shouts, len(regexp_extract_all(line, '{_WORD}')) AS words, coalesce(n, 0) AS stutters,
        length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, len(regexp_extract_all(line, '{SIGNS}')) AS signs,
        ' ' || regexp_replace(lower(line), '{NOT_LETTERS}', '  ', 'g') || ' ' AS stripped, len(regexp_extract_all(stripped, '[^ ]+')) AS plain,
        len(regexp_extract_all(regexp_replace(stripped, '{STOCK}', ' ', 'g'), '[^ ]+')) AS left_
    FROM lines LEFT JOIN stuttered USING (k)
), judged AS (
    SELECT *, (pipes >= 2 AND pipes * 4 >= words) OR symbols * 5 > words * 2 OR shouts * 4 > words OR stutters * 4 > words
        OR (plain > left_ AND (plain - left_ + signs) * 100 >= (plain + signs) * {STOCK_PERCENT})
        OR (words < {SHORT_WORDS} AND NOT regexp_matches(line, '[.!?…:;"''”’)\]][\x20\x09-\x0D]*$')) AS bad
    FROM counted
), by_text AS (
    SELECT r, sum(symbols) AS symbols, count(*) - count(DISTINCT line) AS dup, coalesce(sum(chars) FILTER (bad), 0) AS lost FROM judged GROUP BY r
), whole AS (
    SELECT doc_id, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS chars, coalesce(symbols, 0) AS symbols,
        coalesce(dup, 0) AS dup, coalesce(covered.n, 0) AS repeated, coalesce(lost, 0) AS lost
    FROM worded LEFT JOIN by_text USING (r) LEFT JOIN covered USING (r)
)
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines,
    repeated::BIGINT AS n_repeat_words, n < {LEAST_WORDS} OR 100 * repeated > {MOST_REPEATED} * n AS base_failed,
    NOT (n < {LEAST_WORDS} OR 100 * repeated > {MOST_REPEATED} * n) AND lost <= {MOST_LOST} * chars AS kept, lost::BIGINT AS lost_chars
FROM whole
"""

OP5 = """
WITH held AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM held q JOIN held c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP6 = """
WITH rows AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), first AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM rows
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(hex, (i // 4 * 5 + 1)::INTEGER, 5))::INTEGER >> (15 - i % 4 * 5)::INTEGER) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
    if(page_id = first, 'response', 'revisit') AS record_type, if(page_id = first, NULL, first) AS refers_to
FROM first
"""

OP7 = rf"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents
), placed AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM worded
), shingled AS (
    SELECT doc_id, i, n, word || coalesce(' ' || lead(word) OVER o, '') || coalesce(' ' || lead(word, 2) OVER o, '')
        || coalesce(' ' || lead(word, 3) OVER o, '') || coalesce(' ' || lead(word, 4) OVER o, '') AS held
    FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), filled AS (
    SELECT doc_id, list_sort(list(DISTINCT hash(held))) AS s FROM shingled WHERE i = 1 OR i + 4 <= n GROUP BY doc_id
), sets AS MATERIALIZED (
    SELECT doc_id, coalesce(s, []) AS s, md5(s::VARCHAR) AS k FROM worded LEFT JOIN filled USING (doc_id)
), classes AS MATERIALIZED (
    SELECT min(doc_id) AS id, any_value(s) AS s, k FROM sets WHERE len(s) > 0 GROUP BY k
), held AS MATERIALIZED (
    SELECT id, len(s) AS n, unnest(s) AS x FROM classes
), links AS MATERIALIZED (
    SELECT a.id AS a, b.id AS b FROM held a JOIN held b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
    GROUP BY a.id, b.id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), sides AS MATERIALIZED (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT id AS node, id AS other FROM classes
    UNION SELECT node, b FROM reached JOIN sides ON other = a
), roots AS (
    SELECT k, min(other) AS root FROM reached JOIN classes ON node = id GROUP BY k
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM sets LEFT JOIN roots USING (k)
"""

def op12(k: int = 40, rounds: int = 5, dims: int = 64, seed: str = "2") -> str:
    """An assignment and an update for each round, then one more assignment; integers below 2^53, so inner products of doubles are exact."""
    steps = [
        f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), centroids0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k}
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""apart{i} AS (
    SELECT r, c, list_inner_product(kept.v::DOUBLE[], kept.v::DOUBLE[])::BIGINT + list_inner_product(m.v::DOUBLE[], m.v::DOUBLE[])::BIGINT
        - 2 * list_inner_product(kept.v::DOUBLE[], m.v::DOUBLE[])::BIGINT AS d FROM kept, centroids{i} m
), own{i} AS MATERIALIZED (
    SELECT r, c, d FROM apart{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)""")
        if i < rounds:
            steps.append(f"""centroids{i + 1} AS MATERIALIZED (
    SELECT m.c, coalesce(new.v, m.v) AS v FROM centroids{i} m LEFT JOIN (
        SELECT c, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
            SELECT c, i, sum(x)::HUGEINT AS total, count(*)::HUGEINT AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM own{i} JOIN kept USING (r)) GROUP BY c, i
        ) GROUP BY c
    ) new USING (c)
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, o.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY o.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM own{rounds} o JOIN kept USING (r) JOIN centroids{rounds} m ON o.c = m.c
"""


ORACLE = {"op12_drake_clustering": op12(), "op3_line_quality": OP3, "op5_bit_sliced_topk": OP5, "op6_warc_normaliser": OP6, "op7_minhash_dedup": OP7}
