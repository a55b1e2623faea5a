"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

from embercast.llm import quality_rules

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TEXT = "coalesce(text, '')"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_LINE_WORDS = f"len({_WORDS.format('l')})"
_MARKS = _count("l", quality_rules.NAVIGATION_MARKS)

OP3 = f"""
WITH d AS (SELECT doc_id, {_TEXT} AS t, {_WORDS.format(_TEXT)} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) AS k FROM d),
twice AS (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT win.doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice ON win.doc_id = twice.doc_id AND win.k = twice.k) GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
each AS (SELECT doc_id, unnest(ls) AS l FROM lines),
good AS (SELECT doc_id, sum(len(array_to_string({_WORDS.format('l')}, ''))) AS n FROM each WHERE NOT (
    ({_MARKS} >= 2 AND {_LINE_WORDS} - {_MARKS} <= 3 * {_MARKS})
    OR {_count('l', quality_rules.SYMBOLS)} * 5 >= length(l)
    OR {_count('l', '(!!|[?][?]|[#*$%&|<>][#*$%&|<>])')} * 2 >= {_LINE_WORDS}
    OR ({_LINE_WORDS} >= 40 AND NOT regexp_matches(l, '{quality_rules.CLOSED}'))
    OR (regexp_matches(l, '{quality_rules.BOILERPLATE}') AND {_LINE_WORDS} <= 25)) GROUP BY 1),
base AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    {_count('t', quality_rules.SYMBOLS)}::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(good.n, 0)::BIGINT AS kept_chars
    FROM d JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN good USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_chars >= 0.5 * word_chars AS kept, kept_chars
FROM base
"""

OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_TEXT)} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: ws[i:i + 12])) AS k FROM d),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
bad AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least ON win.k = least.k WHERE m < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM d),
kept AS (SELECT word.doc_id, string_agg(w, ' ' ORDER BY word.p) AS t, count(*) AS n
    FROM word LEFT JOIN bad ON word.doc_id = bad.doc_id AND word.p = bad.p WHERE bad.p IS NULL GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
    sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_LOWER = f"translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3])
    WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS k FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
pair AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, pair.b FROM reach JOIN pair ON pair.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) c ON d.doc_id = c.doc_id
"""


def op12(clusters: int, rounds: int) -> str:
    """Each round's assignment (a0, a1, ...) and the centroids that it leads to (c1, c2, ...)."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT p, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT v.p, c.c, (list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x))::BIGINT AS d FROM v, c{r} c) GROUP BY p)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT best.c AS c, i, sum(e::BIGINT)::BIGINT AS s, count(*) AS n
    FROM (SELECT best, unnest(v.x) AS e, generate_subscripts(v.x, 1) AS i FROM v JOIN a{r} USING (p)) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS x FROM s{r} GROUP BY c
    UNION ALL SELECT c, x FROM c{r} WHERE c NOT IN (SELECT best.c FROM a{r}))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS p, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS c, x FROM v
    QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, x) <= {clusters}),
{", ".join(steps)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
    (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.x, lambda e: e::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (p) JOIN c{rounds} c ON c.c = best.c
"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS p, doc_id, {_TERMS} AS ts FROM documents),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
posting AS (SELECT p, t, count(*) AS tf FROM (SELECT p, unnest(ts) AS t FROM d) GROUP BY ALL),
word AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posting, corpus GROUP BY t, n_docs),
norm AS (SELECT p, doc_id, 75 + (25 * len(ts)::BIGINT * n_docs) // n_terms AS m FROM d, corpus WHERE len(ts) > 0),
item AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
scored AS (SELECT q, item_id, p, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM item JOIN word USING (t) JOIN posting USING (t) JOIN norm USING (p) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) <= 20
"""
