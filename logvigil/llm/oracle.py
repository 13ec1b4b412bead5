"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

EMBEDDING_NEARDUP = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id
          AND a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
home AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, h.component_id, v.vec_id = h.component_id AS kept
FROM v JOIN home h ON h.x = v.vec_id LEFT JOIN degree d ON d.x = v.vec_id
"""

SOURCE_AUDIT = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
vocabulary AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
cells AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang
          LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
shares AS (SELECT c.lang, c.source, c.term, c.n,
                  1 + CAST(1000000000 AS HUGEINT) * (c.n + 2) // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + 2 * v.v) AS p
           FROM cells c JOIN vocabulary v ON v.lang = c.lang),
of_lang AS (SELECT k.lang, k.term, 1 + CAST(1000000000 AS HUGEINT) * (k.lang_n + 2) // (v.lang_total + 2 * v.v) AS q
            FROM kept k JOIN vocabulary v ON v.lang = k.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value
          FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
          LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT s.lang, s.source, s.term AS item, (s.p - l.q) * (s.p - l.q) // (s.p + l.q) AS value
          FROM shares s JOIN of_lang l ON l.lang = s.lang AND l.term = s.term WHERE s.n > 0 AND s.p > l.q),
parts AS (SELECT 'pair' AS part, * FROM every UNION ALL SELECT 'term', * FROM terms),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
                  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLES: dict[str, str] = {
    "op2_int8_embedding_neardup": EMBEDDING_NEARDUP,
    "op13_iceberg_source_audit": SOURCE_AUDIT,
}
