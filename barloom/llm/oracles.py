"""SQL that gives the rows of the registered queries, where SQL can express them."""

OP2 = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g, least(13, len(w)) AS n FROM starts),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n),
grams AS MATERIALIZED (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM places),
found AS MATERIALIZED (SELECT r, n, s, item FROM grams JOIN wins USING (g, n)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

OP3 = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix') AS draw FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT src, source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
l AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, row_number() OVER o AS k,
  (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(CAST(3 * source_size AS DOUBLE)) OVER (ORDER BY 3 * source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY 3 * source_size / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, src)),
f AS (SELECT arg_min(level, k) AS fill FROM l WHERE level * weight <= cap),
t AS (SELECT src, source_size, least(cap, weight * coalesce(fill, 0.0)) AS target FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target * 100000000 / source_size) AS BIGINT) ELSE 0 END AS rate,
  (CAST('0x' || substr(md5(src || ':mix'), 1, 7) AS BIGINT) * 100000000) // 268435456 AS shift FROM t),
n AS (SELECT d.*, row_number() OVER (PARTITION BY src ORDER BY len(CAST(size AS VARCHAR)) * 100 + CAST(substr(CAST(size AS VARCHAR), 1, 2) AS INTEGER), substr(draw, 1, 2), size, draw, doc_id NULLS FIRST) AS i FROM d)
SELECT doc_id, size, source_size, target, size * ((shift + i * rate) // 100000000 - (shift + (i - 1) * rate) // 100000000) AS taken FROM n JOIN p USING (src)
"""

OP13 = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || d.letter || e.letter || g.letter AS filter_order, [a.bit, b.bit, d.bit, e.bit, g.bit] AS bits FROM x a, x b, x d, x e, x g WHERE a.bit + b.bit + d.bit + e.bit + g.bit = 31 AND a.bit | b.bit | d.bit | e.bit | g.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS own, CAST(list_sum(bits[1:step]) AS BIGINT) - bits[step] AS before FROM o, (SELECT unnest(range(1, 6)) AS step))
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN mask & own > 0 THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
FROM c, s GROUP BY part, filter_order, step
"""

ORACLES: dict[str, str] = {"op2_decontaminate": OP2, "op3_mix_sources": OP3, "op13_filter_audit": OP13}
