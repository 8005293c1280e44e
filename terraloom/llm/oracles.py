"""DuckDB SQL for the queries of this subpackage, where SQL can express them."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {WORDS.format('text')} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(8, len(w)) AS k, array_to_string(list_slice(w, i, i + least(8, len(w)) - 1), ' ') AS win
  FROM b, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS t(i) WHERE len(w) > 0
),
d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM d, (SELECT DISTINCT k FROM bw) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)
),
occ AS (SELECT doc_id, i, dw.k AS k, item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


OP8 = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (
  SELECT page_id, arg_max(h || r.p, length(h || r.p)) AS rule, arg_max(verdict, length(h || r.p)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(p.path, r.p) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (page_id)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
c AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM w),
f AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) AS DOUBLE) - coalesce(sum(cap) OVER o, 0.0) AS rest, (SELECT sum(weight) FROM c) - coalesce(sum(weight) OVER o, 0.0) AS open
  FROM c WINDOW o AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
l AS (SELECT rest, open FROM f WHERE cap > rest * weight / open ORDER BY source_size / weight, rank LIMIT 1),
g AS (SELECT min(source_size / weight) AS first_open FROM f WHERE cap > rest * weight / open),
t AS (
  SELECT source, rank, source_size,
         CASE WHEN source_size / weight >= (SELECT first_open FROM g) THEN (SELECT rest FROM l) * weight / (SELECT open FROM l) ELSE cap END AS target FROM f
),
e AS (
  SELECT *, CAST(sum(CAST(floor(target) AS HUGEINT)) OVER (ORDER BY rank) AS HUGEINT) AS cum, CAST((SELECT sum(CAST(floor(target) AS HUGEINT)) FROM t) AS HUGEINT) AS total FROM t
),
b AS (SELECT rank, (cum * 2147483648) // total AS hi, coalesce(lag((cum * 2147483648) // total) OVER (ORDER BY rank), 0) AS lo, total FROM e),
n AS (SELECT rank, count(*) AS slots FROM (SELECT (i % 2147483648) * 1327217885 % 2147483648 AS point FROM range((SELECT CAST((max(total) + 255) // 256 AS BIGINT) FROM b)) AS t(i)) JOIN b ON point >= lo AND point < hi GROUP BY rank),
a AS (
  SELECT doc_id, size, t.source_size, target, coalesce(slots, 0) * 256 AS upto,
         CAST(sum(size) OVER (PARTITION BY t.rank ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS pos0
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN n ON n.rank = t.rank
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(pos0 + size, upto) - pos0) + greatest(0, least(source_size + pos0 + size, upto) - source_size - pos0)
            + greatest(0, least(2 * source_size + pos0 + size, upto) - 2 * source_size - pos0) AS BIGINT) AS taken
FROM a
"""


OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format('text')} AS w FROM documents),
s AS (
  SELECT doc_id, len(w) = 0 AS bare,
         CASE WHEN len(w) >= 5 THEN list_sort(list_distinct([array_to_string(list_slice(w, i, i + 4), ' ') FOR i IN range(1, len(w) - 3)]))
              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [t] END AS sh FROM d
),
k AS (SELECT doc_id, bare, sh, md5(CASE WHEN bare THEN 'text ' ELSE 'set ' END || array_to_string(sh, '|')) AS key FROM s),
n AS (SELECT key, min(doc_id) AS rep, count(*) AS copies, any_value(sh) AS sh, bool_or(bare) AS bare FROM k GROUP BY key),
x AS (SELECT key, len(sh) AS size, unnest(sh) AS g FROM n WHERE NOT bare),
p AS (SELECT a.key AS ka, b.key AS kb, any_value(a.size) + any_value(b.size) AS sizes, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.key <> b.key GROUP BY 1, 2),
l AS (SELECT ka, kb FROM p WHERE c * 1.8 >= 0.8 * sizes - 1e-9),
r(k, m) AS (SELECT key, key FROM n UNION SELECT r.k, l.kb FROM r JOIN l ON r.m = l.ka),
c AS (SELECT r.k AS key, min(n.rep) AS class_id FROM r JOIN n ON n.key = r.m GROUP BY r.k),
t AS (SELECT ka AS key, count(*) AS n_texts, sum(copies) AS docs FROM l JOIN n ON n.key = l.kb GROUP BY ka)
SELECT k.doc_id, class_id, CAST(copies - 1 + coalesce(docs, 0) AS BIGINT) AS n_links, CAST(copies AS BIGINT) AS n_copies, CAST(coalesce(n_texts, 0) AS BIGINT) AS n_texts
FROM k JOIN n USING (key) JOIN c USING (key) LEFT JOIN t USING (key)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op7_near_duplicates": OP7, "op8_url_filter": OP8, "op9_mix_sources": OP9}
