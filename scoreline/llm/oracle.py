"""SQL (DuckDB dialect) for the queries of this package that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLE: dict[str, str] = {}

ORACLE["op3_jaccard_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, array_to_string(ws[i:i + 2], ' ') AS sh
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3) a
    UNION ALL
    SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2) b),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * i >= 90 * (p.n + q.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents
  UNION
  SELECT reach.d, e.y FROM reach JOIN e ON e.x = reach.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id,
       CAST(coalesce(k.k, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT d, min(r) AS component_id FROM reach GROUP BY d) c ON c.d = d.doc_id
LEFT JOIN (SELECT x, count(*) AS k FROM e GROUP BY x) k ON k.x = d.doc_id"""

ORACLE["op5_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13) a),
firsts AS (SELECT s, min(doc_id) AS a FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j
  FROM win JOIN firsts ON win.s = firsts.s WHERE firsts.a < win.doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.j) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j
  WHERE gone.j IS NULL GROUP BY words.doc_id),
cut AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN cut ON cut.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id"""

_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


def _terms(column: str) -> str:
    return f"regexp_extract_all(translate({column}, '{_UPPER}', '{_LOWER}'), {_TERMS})"


ORACLE["op11_lexical_search"] = f"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS term, len(ws) AS n
  FROM (SELECT doc_id, {_terms('text')} AS ws FROM documents WHERE text IS NOT NULL) a),
tf AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM w GROUP BY doc_id, term),
total AS (SELECT count(DISTINCT doc_id) AS nd, count(*) AS l FROM w),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wanted AS (
  SELECT DISTINCT item_id, unnest({_terms('text')}) AS term FROM benchmark WHERE text IS NOT NULL),
weighed AS (
  SELECT item_id, term, nd, l, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM wanted JOIN df USING (term) CROSS JOIN total),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // l)))) AS BIGINT) AS score
  FROM weighed JOIN tf USING (term) GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

ORACLE["op12_collocations"] = f"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                         '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) a),
pos AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
f1 AS (SELECT lang, ws[i] AS w1, count(*) AS f FROM pos GROUP BY ALL),
f2 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM pos
       WHERE i + 1 <= len(ws) GROUP BY ALL),
f3 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f FROM pos
       WHERE i + 2 <= len(ws) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
c2 AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  WHERE f2.f >= 10 AND NOT EXISTS (
    SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND 100 * f3.f >= 50 * f2.f AND f3.w1 = f2.w1 AND f3.w2 = f2.w2)
  AND NOT EXISTS (
    SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND 100 * f3.f >= 50 * f2.f AND f3.w2 = f2.w1 AND f3.w3 = f2.w2)),
c3 AS (
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a,
         x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1
  JOIN f1 z ON z.lang = f3.lang AND z.w1 = f3.w3
  JOIN f2 xy ON xy.lang = f3.lang AND xy.w1 = f3.w1 AND xy.w2 = f3.w2
  JOIN f2 yz ON yz.lang = f3.lang AND yz.w1 = f3.w2 AND yz.w2 = f3.w3),
s AS (
  SELECT lang, phrase, a, l, r, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM c2
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END,
         least(s1, s2)
  FROM (SELECT *, (1000000::HUGEINT * a * a) // (l1::HUGEINT * r1) AS s1,
               (1000000::HUGEINT * a * a) // (l2::HUGEINT * r2) AS s2 FROM c3) t),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM k JOIN n USING (lang) WHERE rank <= 2000"""

ORACLE["op13_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5"""
