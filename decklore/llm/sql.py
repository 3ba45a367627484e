"""SQL for DuckDB of those operators whose SQL is long: repeated windows, near copies, secrets."""

from __future__ import annotations

from decklore.llm import secrets

WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
firsts AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (g) WHERE f < doc_id),
every AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN len(ws) || '/' || array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT u, b FROM reach JOIN e ON e.a = reach.v),
c AS (SELECT u AS doc_id, min(v) AS class_id FROM reach GROUP BY u),
same AS (SELECT doc_id, count(*) OVER (PARTITION BY k) AS n_copies FROM (SELECT doc_id, md5(string_agg(g, chr(1) ORDER BY g)) AS k FROM s GROUP BY doc_id))
SELECT c.doc_id, class_id, CAST((SELECT count(*) FROM e WHERE e.a = c.doc_id) AS BIGINT) AS n_links, coalesce(n_copies, 1) AS n_copies
FROM c LEFT JOIN same USING (doc_id)
"""


def _matches(k: int, kind: str, pattern: str, group: int, must: list[str]) -> str:
    p = secrets.FAST.get(kind, pattern).replace("'", "''")
    value = "length(vs[i])"
    if must:
        ok = " AND ".join(f"regexp_matches(vs[i], '{m}')" for m in must)
        value = f"CASE WHEN {ok} THEN {value} ELSE 0 END"
    return f"""SELECT r, {k} AS k, i, length(ps[i]) AS gap, length(hs[i]) AS size, {value} AS val FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i
      FROM (SELECT r, string_split_regex(t, '{p}') AS ps, regexp_extract_all(t, '{p}', 0) AS hs, regexp_extract_all(t, '{p}', {group}) AS vs FROM d))"""


def _secrets() -> str:
    kinds = [(*b, []) for b in secrets.BASE] + secrets.WEAK
    found = "\n    UNION ALL ".join(_matches(k, kind, p, g, must) for k, (kind, p, g, _, must) in enumerate(kinds))
    least = "[" + ", ".join(str(k[3]) for k in kinds) + "]"
    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    near = lambda reach: f"x.r = y.r AND x.s < y.e + {reach} AND y.s < x.e + {reach}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
x0 AS (SELECT *, sum(gap + size) OVER (PARTITION BY r, k ORDER BY i) AS e FROM m),
pt AS (SELECT r, k, CAST(e - size AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM x0 WHERE val >= ({least})[k + 1]),
base AS (SELECT * FROM pt WHERE k < 3),
weak AS (SELECT * FROM pt x WHERE k >= 3 AND NOT EXISTS (SELECT 1 FROM base y WHERE {near(0)})),
named AS (SELECT * FROM base WHERE k = 1
  UNION ALL SELECT * FROM pt x WHERE k = 3 AND EXISTS (SELECT 1 FROM base y WHERE y.k = 1 AND {near(0)})),
fin AS (SELECT * FROM base
  UNION ALL SELECT * FROM weak x WHERE k = 4 AND (EXISTS (SELECT 1 FROM weak y WHERE y.k IN (3, 5) AND {near(secrets.SCOPE)})
    OR EXISTS (SELECT 1 FROM named y WHERE {near(secrets.SCOPE)}))
  UNION ALL SELECT * FROM weak x WHERE k IN (3, 5) AND EXISTS (SELECT 1 FROM (SELECT * FROM base UNION ALL SELECT * FROM weak WHERE k = 4) y WHERE {near(secrets.SCOPE)})),
g AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
  string_agg(({names})[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS bs,
  string_agg(({names})[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS sp FROM fin GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


SECRETS = _secrets()
