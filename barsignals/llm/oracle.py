"""DuckDB SQL for the queries that SQL can state in full (the others are tested by brute force)."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# Bytes as two hexadecimal digits each, so that positions are bytes; islands of covered bytes.
SUFFIX_ARRAY = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, unnest(range(0, octet_length(encode(h)) // 2 - 399)) AS p, h FROM d),
k AS (SELECT r, p, md5(substr(h, 2 * p + 1, 800)) AS m FROM w),
twice AS (SELECT m FROM k GROUP BY m HAVING count(*) > 1),
hit AS (SELECT r, p FROM k WHERE m IN (SELECT m FROM twice)),
edge AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 400, TRUE) AS fresh FROM hit),
island AS (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS g FROM edge),
span AS (SELECT r, g, min(p) AS s, max(p) + 400 AS e FROM island GROUP BY r, g),
gap AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM span),
cut AS (SELECT r, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS last,
               string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS head
        FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(encode(h)) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""

DECONTAMINATION = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS.format('text')} AS ws FROM benchmark),
win AS (SELECT item_id, least(len(ws), 13) AS n, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1),
               lambda i: array_to_string(ws[i:i + least(len(ws), 13) - 1], ' '))) AS s FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
dw AS (SELECT r, n, unnest(list_transform(range(1, len(ws) - n + 2),
              lambda i: {{'p': i, 's': array_to_string(ws[i:i + n - 1], ' ')}})) AS x FROM d, sizes),
hits AS (SELECT r, n, x.p AS p, item_id FROM dw JOIN win USING (n) WHERE x.s = win.s),
words AS (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM hits),
hit AS (SELECT r, count(*) AS n_hit FROM words GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
          FROM hits GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

TOP_K = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS z
           FROM embeddings WHERE embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
c AS (SELECT r, vec_id, unnest(z) AS z, unnest(range(len(z))) AS i FROM v),
s AS (SELECT q.r, q.vec_id AS query_id, x.r AS cr, x.vec_id, coalesce(sum(q.z * x.z), 0)::BIGINT AS score
      FROM c q JOIN c x ON q.i = x.i AND q.r <> x.r WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr)
QUALIFY row_number() OVER w <= 5
"""

# crc32 byte by byte; the cheapest edits of all conversations row by row, one least (cost, audit) per last role
# (0 none, 1 system, 2 user, 3 assistant) with up to two inserts before each row.
REPAIR = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                                        lambda c: CAST(ord(c) AS BIGINT)),
                         lambda acc, b: list_reduce(range(8), lambda v, n: xor(v >> 1, 3988292384 * (v & 1)), xor(acc, b)),
                         CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS kind
  FROM conversations),
dmg AS (
  SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM src WHERE kind <> 0),
pos AS (
  SELECT k, turn, role, text, substr(role, 1, 1) AS ini, row_number() OVER w AS i,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
         lag(substr(role, 1, 1)) OVER w AS prev
  FROM dmg WINDOW w AS (PARTITION BY k ORDER BY turn NULLS FIRST, role, text)),
seen AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again FROM pos),
r AS (SELECT k, turn, role, text, ini, i, blank, again AND NOT blank AS dup, cut AND NOT blank AND NOT again AS cut,
             coalesce(prev || ini NOT IN ('su', 'ua', 'au'), FALSE) AS bad FROM seen),
ins(s0, s1, c, e) AS (VALUES (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'),
                             (2, 2, 0, ''), (2, 3, 2, 'I'), (2, 2, 4, 'II'), (3, 3, 0, ''), (3, 2, 2, 'I'), (3, 3, 4, 'II')),
act(s1, ini, s2, c, e) AS (VALUES (0, 's', 1, 0, 'K'), (0, 'u', 2, 0, 'K'), (1, 'u', 2, 0, 'K'), (2, 'a', 3, 0, 'K'), (3, 'u', 2, 0, 'K'),
                                  (0, NULL, 2, 2, 'R'), (1, NULL, 2, 2, 'R'), (2, NULL, 3, 2, 'R'), (3, NULL, 2, 2, 'R'),
                                  (0, NULL, 0, 3, 'D'), (1, NULL, 1, 3, 'D'), (2, NULL, 2, 3, 'D'), (3, NULL, 3, 3, 'D')),
walk AS (
  SELECT k, CAST(0 AS BIGINT) AS i, 0 AS s, {'c': CAST(0 AS BIGINT), 'a': ''} AS x FROM (SELECT DISTINCT k FROM r)
  UNION ALL
  SELECT w.k, w.i + 1 AS i, act.s2 AS s,
         min({'c': CAST(w.x.c + ins.c + act.c + CASE WHEN act.e <> 'D' AND r.cut THEN 1 ELSE 0 END AS BIGINT), 'a': w.x.a || ins.e || act.e}) AS x
  FROM walk w JOIN ins ON ins.s0 = w.s JOIN r ON r.k = w.k AND r.i = w.i + 1
  JOIN act ON act.s1 = ins.s1 AND (act.ini IS NULL OR act.ini = r.ini) AND (act.e = 'D' OR NOT (r.blank OR r.dup))
  GROUP BY w.k, w.i + 1, act.s2),
ends AS (
  SELECT w.k, min({'c': CAST(w.x.c + ins.c AS BIGINT), 'a': w.x.a || ins.e}) AS x
  FROM walk w JOIN (SELECT k, max(i) AS n FROM r GROUP BY k) z ON z.k = w.k AND z.n = w.i JOIN ins ON ins.s0 = w.s AND ins.s1 IN (0, 3)
  GROUP BY w.k),
edit AS (SELECT k, j, substr(x.a, j, 1) AS e FROM (SELECT k, x, unnest(range(1, length(x.a) + 1)) AS j FROM ends)),
made AS (SELECT k, j, e, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS m
         FROM edit WINDOW w AS (PARTITION BY k ORDER BY j)),
kept AS (SELECT m.k, m.j, m.e, m.m, CASE WHEN m.e = 'I' THEN '' ELSE r.text END AS text, r.role, r.ini
         FROM made m LEFT JOIN r ON r.k = m.k AND r.i = m.i WHERE m.e <> 'D'),
lead AS (SELECT k, 1 AS has_s FROM kept WHERE m = 1 AND e = 'K' AND ini = 's'),
said AS (SELECT kept.k, string_agg(CASE WHEN e = 'K' THEN role WHEN (m + coalesce(has_s, 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                   || ':' || text, chr(10) ORDER BY j) AS t
         FROM kept LEFT JOIN lead USING (k) GROUP BY kept.k),
stat AS (SELECT k, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
                count(*) FILTER (cut) AS truncated, count(*) FILTER (bad) AS illegal FROM r GROUP BY k)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(x.c, 0) AS cost, coalesce(x.a, '') AS audit,
       sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM src) c LEFT JOIN stat USING (k) LEFT JOIN ends USING (k) LEFT JOIN said USING (k)
"""

ORACLE = {
    "op4_suffix_array_dedup": SUFFIX_ARRAY,
    "op6_benchmark_decontamination": DECONTAMINATION,
    "op11_conversation_repair": REPAIR,
    "op13_exact_top_k": TOP_K,
}
