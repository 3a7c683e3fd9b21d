"""SQL of the queries that SQL can express, over the same tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS w FROM documents),
win AS (SELECT r, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d)),
first AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g),
gone AS (SELECT DISTINCT r, i + j AS p FROM win JOIN first USING (g), range(0, 50) t(j) WHERE f < doc_id),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) USING (r) LEFT JOIN kept USING (r)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, x FROM (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS s FROM g GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b, y.s AS s, x.s AS own FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS class_id,
       (SELECT count(*) FROM link WHERE a = doc_id) AS n_links,
       (SELECT count(DISTINCT s) FROM link WHERE a = doc_id AND s <> own) AS n_linked_sets FROM d
"""

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT r, k, n, item_id FROM dw JOIN bw USING (n, g)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN cov USING (r) LEFT JOIN item USING (r)
"""

# Base32 of a SHA-1: eight groups of twenty bits, four digits each.
_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31)::INT, 1)"
    for g in range(8)
    for s in (15, 10, 5, 0)
)

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first, sha1(html) AS h FROM p GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (html)
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r, {WORDS} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM again, range(0, 5) t(j) GROUP BY r),
line AS (SELECT r, source, l FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM line GROUP BY r),
norm AS (SELECT r, source, regexp_replace(trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g') AS x FROM line),
freq AS (SELECT source, x FROM norm GROUP BY source, x HAVING count(DISTINCT r) > 50),
lost AS (SELECT r, sum(len(string_split(norm.x, ' '))) AS n FROM norm JOIN freq ON norm.x = freq.x AND norm.source IS NOT DISTINCT FROM freq.source GROUP BY r),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(coalesce(array_to_string(w, ''), '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_frequent_words
  FROM d LEFT JOIN cov USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_frequent_words <= 0.5 * n_words AS kept FROM base
"""
