"""DuckDB SQL of those queries that SQL can express, written from their contracts."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7 = rf"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS size,
         array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
  FROM item_words, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
doc_windows AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM doc_words, (SELECT DISTINCT size FROM item_windows), unnest(range(1, len(w) - size + 2)) AS u(i)),
matches AS (
  SELECT d.doc_id, d.i, d.size, x.item FROM doc_windows d JOIN item_windows x ON d.size = x.size AND d.win = x.win),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM matches, unnest(range(i, i + size)) AS u(p) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM matches) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP2 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(4, len(w)) - 1), ' ') AS s
  FROM words, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
  WHERE 100 * c >= 85 * (sa.n + sb.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS r FROM words
  UNION
  SELECT reached.doc_id, both_ways.b FROM reached JOIN both_ways ON reached.r = both_ways.a)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS win FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM twice, unnest(range(i, i + 8)) AS u(p) GROUP BY doc_id),
counts AS (
  SELECT doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_letters, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters,
         length(regexp_replace(t, '[^!?]', '', 'g')) AS marks, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits,
         len(string_split(t, chr(10))) AS all_lines
  FROM d LEFT JOIN repeats USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND 2 * n_symbols <= n_words
         AND 2 * n_dup_lines <= all_lines AND 10 * upper_letters <= 7 * letters AND 2 * marks <= n_words
         AND 2 * digits <= word_chars AS kept
FROM judged
"""

OP9 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM q
"""

OP12 = r"""
WITH RECURSIVE originals AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS named
  FROM conversations),
checked AS (
  SELECT *, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(named, ''), lambda c: CAST(ord(c) AS BIGINT))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])),
                                 lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS h
  FROM originals),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM checked, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) WHERE h <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
         left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) AS before
  FROM numbered),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
-- the last initial stands for what the pattern allows next: '' (begin), s, u, a
inserted(a, b, price, edits) AS (
  VALUES ('', '', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''), ('', 'u', 2, 'I'), ('s', 'u', 2, 'I'),
         ('u', 'a', 2, 'I'), ('a', 'u', 2, 'I'), ('', 'a', 4, 'II'), ('s', 'a', 4, 'II')),
allowed(b, c) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
moves AS (
  SELECT conv_id, pos, b, b AS c, 3 AS price, 'D' AS edit FROM faulty, (SELECT DISTINCT b FROM inserted)
  UNION ALL
  SELECT conv_id, pos, b, c, CASE WHEN fault IS NULL THEN 0 ELSE 1 END, 'K' FROM faulty JOIN allowed ON initial = c
  WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, pos, b, c, CASE WHEN fault IS NULL THEN 2 ELSE 3 END, 'R' FROM faulty, allowed
  WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate') AND c <> 's'),
steps AS (
  SELECT conv_id, pos, a, c, min({'price': i.price + m.price, 'edits': edits || edit}) AS best
  FROM moves m JOIN inserted i USING (b) GROUP BY ALL),
reached AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, '' AS c, {'cost': 0, 'audit': ''} AS best FROM counts
  UNION ALL
  SELECT s.conv_id, s.pos, s.c, min({'cost': r.best.cost + s.best.price, 'audit': r.best.audit || s.best.edits})
  FROM reached r JOIN steps s ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.pos = r.pos + 1 AND s.a = r.c
  GROUP BY s.conv_id, s.pos, s.c),
done AS (
  SELECT r.conv_id, min({'cost': r.best.cost + i.price, 'audit': r.best.audit || i.edits}) AS best
  FROM reached r JOIN counts k ON k.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = k.n JOIN inserted i ON i.a = r.c
  WHERE i.b IN ('', 'a') GROUP BY r.conv_id),
edits AS (
  SELECT conv_id, i, substr(best.audit, i, 1) AS edit, length(replace(left(best.audit, i), 'I', '')) AS pos
  FROM done, unnest(range(1, length(best.audit) + 1)) AS u(i)),
said AS (
  SELECT e.conv_id, i, edit, role, text, initial, row_number() OVER (PARTITION BY e.conv_id ORDER BY i) AS place,
         first_value(edit || initial) OVER (PARTITION BY e.conv_id ORDER BY i) = 'Ks' AS led
  FROM edits e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.pos WHERE edit <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(
      CASE WHEN edit = 'K' THEN role WHEN (place - CAST(coalesce(led, false) AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS words
  FROM said GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(words, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM originals) o
LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLES: dict[str, str] = {
    "op12_conversation_repair": OP12,
    "op2_ngram_jaccard_join": OP2,
    "op5_quality_rules": OP5,
    "op7_benchmark_decontamination": OP7,
    "op9_warc": OP9,
}
