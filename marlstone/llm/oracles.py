"""DuckDB SQL for those queries that SQL can express."""

_WORDS10 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_WORDS6 = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(12 + length(role) + 10 + 11 + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars,
  (count(*) FILTER (role = 'assistant' OR i = n))::BIGINT AS n_examples
FROM sized GROUP BY conv_id"""

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS10} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS10} AS w FROM benchmark),
bw AS (SELECT item, w[i:i + 9] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT len(win) AS k FROM bw),
dw AS (SELECT r, i, k, w[i:i + k - 1] AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
hits AS (SELECT dw.r, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.win = bw.win),
words AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS6} AS w FROM documents),
win AS (SELECT r, doc_id, i, w[i:i + 12] AS x FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT x, min(doc_id) AS m FROM win GROUP BY x),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (x) WHERE least.m < win.doc_id),
g AS (SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(d.w, lambda x, i: NOT coalesce(list_contains(g.ps, i), false)), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (r)"""

# SHA-1 in hexadecimal digits -> bits -> base32.
OP9 = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
bits AS (SELECT h, string_agg(right('000' || bin(('0x' || h[i])::INTEGER), 4), '' ORDER BY i) AS b FROM (SELECT DISTINCT h FROM p), range(1, 41) AS r(i) GROUP BY h),
b32 AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * b[5 * i + 1]::INTEGER + 8 * b[5 * i + 2]::INTEGER + 4 * b[5 * i + 3]::INTEGER + 2 * b[5 * i + 4]::INTEGER + b[5 * i + 5]::INTEGER, 1), '' ORDER BY i) AS d FROM bits, range(0, 32) AS r(i) GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN m USING (h) JOIN b32 USING (h)"""

SQL = {"op9_warc_zip": OP9, "op2_prefix_targets": OP2, "op6_substring_dedup": OP6, "op10_decontaminate": OP10}
