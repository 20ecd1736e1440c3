"""DuckDB SQL for the queries that SQL can express, written apart from the Spark code."""

from __future__ import annotations

from tessera.llm.quality import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_WS = "[\\x20\\x09-\\x0D]"
_NUMBER = "('0x' || substr(md5({0}), 1, 6))::INT"

OP2 = f"""
WITH b AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM b, unnest(range(1, len(w) - 1)) AS u(i)),
dup AS (SELECT rid, g FROM g GROUP BY rid, g HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM g JOIN dup USING (rid, g), (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
m AS (
  SELECT rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
    len(list_filter(w, lambda x: regexp_matches(x, '\\pL'))) AS n_letter,
    len(list_filter(w, lambda x: ends_with(x, '!!'))) AS n_emphasis,
    len(list_filter(l, lambda x: regexp_matches(x, '^{_WS}*[-*•]'))) AS n_bullet,
    len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipsis
  FROM b),
f AS (SELECT m.*, coalesce(n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words BETWEEN 50 AND 100000 AND 100 * n_repeat_words <= 50 * n_words
    AND word_chars / n_words BETWEEN 2.0 AND 12.0 AND n_symbols / n_words <= 0.1 AND n_emphasis / n_words <= 0.1
    AND n_letter / n_words >= 0.8 AND n_stop / n_words >= 0.02
    AND (n_lines = 0 OR (n_dup_lines / n_lines <= 0.5 AND n_bullet / n_lines <= 0.9 AND n_ellipsis / n_lines <= 0.3)) AS kept
FROM f
"""

OP9 = f"""
WITH pages_ AS (
  SELECT page_id, url, DATE '2024-01-01' + ({_NUMBER.format("page_id::VARCHAR")}) % 365 AS fetched,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.$', '') AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
named AS (
  SELECT 'domain' AS kind, host AS pattern FROM pages_ WHERE host <> ''
  UNION SELECT 'domain', regexp_replace(host, '^[^.]+\\.', '') FROM pages_ WHERE host <> ''
  UNION SELECT 'prefix', host || '/' || lower(regexp_extract(path, '^/+([^/]+)', 1)) FROM pages_ WHERE host <> '' AND regexp_extract(path, '^/+([^/]+)', 1) <> ''),
listed AS (SELECT kind, pattern, {_NUMBER.format("pattern")} AS b FROM named WHERE ({_NUMBER.format("pattern")}) % 3 = 0),
spans AS (
  SELECT kind, pattern, ['adult', 'malware', 'spam'][b % 5 % 3 + 1] AS list_name, s AS valid_from, e AS valid_to FROM (
    SELECT *, DATE '2024-01-01' + (b // 7) % 300 AS s, DATE '2024-01-01' + ((b // 7) % 300 + b % 90 + 1) AS e FROM listed
    UNION ALL SELECT *, DATE '2024-01-01' + ((b // 7) % 300 + b % 90 + 61), NULL FROM listed)),
parts AS (SELECT page_id, host, list_filter(string_split(lower(path), '/'), lambda x: x <> '') AS p, string_split(host, '.') AS l FROM pages_ WHERE host <> ''),
keys AS (
  SELECT DISTINCT page_id, 'domain' AS kind, array_to_string(l[i:], '.') AS pattern FROM parts, unnest(range(1, len(l) + 1)) AS u(i)
  UNION SELECT DISTINCT page_id, 'prefix', host || '/' || array_to_string(p[:i], '/') FROM parts, unnest(range(1, len(p) + 1)) AS u(i)),
met AS (
  SELECT page_id, count(*) AS n_entries, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists, min(valid_from) AS since,
    arg_max(k.pattern, (length(k.pattern), k.pattern)) AS matched
  FROM keys k JOIN spans s ON k.kind = s.kind AND k.pattern = s.pattern JOIN pages_ USING (page_id)
  WHERE fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to) GROUP BY page_id)
SELECT page_id, url, fetched, host, coalesce(n_entries, 0) AS n_entries, coalesce(lists, '') AS lists, since,
  coalesce(matched, '') AS matched, n_entries IS NOT NULL AS blocked
FROM pages_ LEFT JOIN met USING (page_id)
"""

_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g
  FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(s) WHERE len(w) > 0),
hits AS (
  SELECT rid, s, n, item_id FROM (
    SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
    FROM d, (SELECT DISTINCT n FROM win) AS v, unnest(range(1, len(w) - n + 2)) AS u(s)) JOIN win USING (n, g)),
words AS (SELECT rid, count(DISTINCT s + k) AS n_hit FROM hits, unnest(range(0, n)) AS u(k) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

ORACLES = {
    "op2_quality_rules": OP2,
    "op9_url_filters": OP9,
    "op10_benchmark_decontamination": OP10,
}
