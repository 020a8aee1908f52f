"""The queries that SQL can state, as DuckDB SQL."""

from __future__ import annotations

from linkloom.llm.quality import STOP_WORDS

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)

_QUALITY = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words,
         len(list_filter(words, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS n_shouts
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.1
       AND n_shouts / n_words <= 0.4 AND n_stop_words / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.3 AS kept
FROM judged"""

_URLS = """
WITH cut AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
canon AS (
  SELECT *, CASE WHEN host <> '' THEN
      regexp_replace(host, '^(?:www|m|blog)[.]', '') || regexp_replace(path, '([.]html?)?/?$', '')
      || CASE WHEN len(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '[?](.*)$', 1), '&'),
              lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]*|ref|page)='))) > 0
         THEN '?' || array_to_string(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '[?](.*)$', 1), '&'),
              lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]*|ref|page)=')), '&') ELSE '' END END AS canonical
  FROM parts),
listed AS (
  SELECT DISTINCT canonical FROM canon
  WHERE len(list_intersect(string_split(host, '.'),
    ['ads-track', 'spam-farm', 'casino-win', 'adult-x', 'cheap-pills', 'free-bets'])) > 0),
ruled AS (
  SELECT *, CASE
      WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule,
    canonical IS NOT NULL AND canonical IN (SELECT canonical FROM listed) AS is_listed
  FROM canon)
SELECT page_id, host, path, rule, is_listed,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN is_listed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""

_CONTAMINATION = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
runs AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM runs),
spots AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS run
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, i, spots.size AS size FROM spots JOIN runs ON spots.run = runs.run AND spots.size = runs.size),
words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_PASSAGES = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
runs AS (
  SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
twice AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS later
  FROM (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM runs) WHERE n > 1)
SELECT doc_id, count(DISTINCT j)::BIGINT AS n_repeated, count(DISTINCT CASE WHEN later THEN j END)::BIGINT AS n_copied
FROM (SELECT doc_id, later, unnest(range(i, i + 50)) AS j FROM twice) GROUP BY doc_id"""

_LINES = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, pos, line, keeper IS NULL OR keeper = doc_id AS stays FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

_LOWERED = """translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

#: The CRC is worked out bit by bit for every distinct feature.
_RESAMPLED = f"""
WITH split AS (
  SELECT doc_id AS id, true AS is_doc, regexp_extract_all({_LOWERED}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
  UNION ALL SELECT item_id, false, regexp_extract_all({_LOWERED}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') FROM benchmark),
runs AS (
  SELECT id, is_doc, unnest(w) AS f FROM split
  UNION ALL SELECT id, is_doc, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split),
counted AS (SELECT id, is_doc, f, count(*) AS n FROM runs GROUP BY ALL),
bits AS (
  SELECT f, list_transform(range(4 * length(hex(f))), lambda i:
      (('0x' || substr(hex(f), 2 * (i // 8) + 1, 2))::INT >> (i % 8)::INT) & 1) AS b
  FROM (SELECT DISTINCT f FROM counted)),
hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda c, x:
      xor(c >> 1, 3988292384 * (xor(c, x) & 1)))) % 10000 AS bucket FROM bits),
features AS (SELECT id, is_doc, bucket, n FROM counted JOIN hashed USING (f)),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (is_doc), 0) AS s, coalesce(sum(n) FILTER (NOT is_doc), 0) AS t FROM features GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000)))) AS gain FROM sums, totals),
weighed AS (
  SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
  FROM features JOIN gains USING (bucket) WHERE is_doc GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || id)[1:8])::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (id) WHERE is_doc),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed USING (doc_id)"""

ORACLE = {"op1_quality_rules": _QUALITY, "op3_url_filters": _URLS, "op4_suffix_array_dedup": _PASSAGES,
          "op7_decontamination": _CONTAMINATION, "op11_line_dedup": _LINES, "op12_importance_resampling": _RESAMPLED}
