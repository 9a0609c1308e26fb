"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from .reputation import SUFFIXES

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = r"""
WITH urls AS (
  SELECT page_id, url,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
seen AS (
  SELECT host, l.quality AS good
  FROM (SELECT host, try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT) AS doc_id FROM urls) u
  JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL),
names AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS name FROM urls),
labels_of AS (
  SELECT host, name, regexp_full_match(name, '[0-9]+(\.[0-9]+){3}|\[.*\]') AS address,
         array_to_string(string_split(name, '.')[-2:], '.') AS two, array_to_string(string_split(name, '.')[-3:], '.') AS three FROM names),
hosts AS (
  SELECT h.host, CASE WHEN address THEN '(address)' WHEN two IN (LISTED) THEN two ELSE string_split(name, '.')[-1] END AS suffix,
         CASE WHEN address THEN name WHEN two IN (LISTED) THEN three ELSE two END AS domain, coalesce(n, 0) AS n, coalesce(good, 0) AS good
  FROM labels_of h LEFT JOIN (SELECT host, count(*) AS n, sum(good) AS good FROM seen GROUP BY host) s USING (host)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL),
levels AS (SELECT 'h' AS l, n, good FROM hosts UNION ALL SELECT 'd', n, good FROM domains UNION ALL SELECT 's', n, good FROM suffixes),
sums AS (
  SELECT l, sum(good)::DOUBLE AS x, sum(n)::DOUBLE AS t, count(*) AS k, sum(n * n)::DOUBLE AS nn, sum(good * good / n::DOUBLE) AS pp, sum(good)::DOUBLE / sum(n) AS mean
  FROM levels WHERE n > 0 GROUP BY l),
spreads AS (SELECT *, CASE WHEN t * t > nn THEN (pp - t * mean * mean - (k - 1) * mean * (1 - mean)) / (t - nn / t) END AS spread FROM sums),
priors AS (SELECT l, mean, CASE WHEN spread > 0 THEN greatest(1.0, least(1000.0, mean * (1 - mean) / spread - 1)) ELSE 1000.0 END AS strength FROM spreads),
prior AS (
  SELECT coalesce(max(mean) FILTER (l = 's'), 0.5) AS mean_s, coalesce(max(strength) FILTER (l = 's'), 1000.0) AS strength_s,
         coalesce(max(strength) FILTER (l = 'd'), 1000.0) AS strength_d, coalesce(max(strength) FILTER (l = 'h'), 1000.0) AS strength_h FROM priors),
tops AS (SELECT suffix, (good + mean_s * strength_s) / (n + strength_s) AS top FROM suffixes, prior),
middles AS (SELECT domain, (good + top * strength_d) / (n + strength_d) AS middle FROM domains JOIN tops USING (suffix), prior),
means AS (SELECT host, n, strength_h, (good + middle * strength_h) / (n + strength_h) AS mean FROM hosts JOIN middles USING (domain), prior),
judged AS (SELECT host, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (n + strength_h + 1)) >= 0.5 THEN 'allow' ELSE 'block' END AS by_host FROM means),
rules(verdict, rule, rule_host, rule_path) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
fits AS (
  SELECT DISTINCT host, path, r.rule, r.verdict, length(r.rule) AS size FROM urls, rules r
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT host, path, arg_max(rule, size) AS rule, arg_max(verdict, size) AS verdict FROM fits GROUP BY ALL)
SELECT page_id, u.host, u.path, b.rule, coalesce(b.verdict, j.by_host) AS verdict
FROM urls u JOIN judged j USING (host) LEFT JOIN best b ON b.host = u.host AND b.path = u.path
""".replace("LISTED", ", ".join(f"'{s}'" for s in SUFFIXES))

OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(LOWERED, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, len(coalesce(s, [])) AS n, s FROM sets),
shingles AS (SELECT doc_id, n, unnest(s) AS shingle FROM sizes),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node)
SELECT doc_id, n::BIGINT AS n_shingles, root AS component_id, doc_id = root AS kept
FROM sizes JOIN (SELECT node AS doc_id, min(root) AS root FROM reach GROUP BY node) USING (doc_id)
""".replace("LOWERED", _LOWER.format("text"))

OP10 = r"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS win
  FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS win
  FROM words, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, pos, r.size, item_id FROM runs r JOIN windows v ON r.win = v.win AND r.size = v.size),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""".replace("LOWERED", _LOWER.format("text"))

ORACLE_SQL = {"op2_url_reputation": OP2, "op7_near_dups": OP7, "op10_decontamination": OP10}
