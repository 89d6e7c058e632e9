"""DuckDB SQL for those contract queries that SQL can express."""

from __future__ import annotations

from tallyhold.llm.lines import BOILERPLATE, NAVIGATION, SEPARATOR, SYMBOLS, TERMINAL

SPACE = r"[\x20\x09-\x0D]"


def _text(pattern: str) -> str:
    return pattern.replace("'", "''")


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS words FROM docs),
t AS (SELECT doc_id, unnest(words) AS w0, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, i, w0, lead(w0, 1) OVER o AS w1, lead(w0, 2) OVER o AS w2 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, CASE WHEN w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w0, w1, w2) > 1 THEN 1 ELSE 0 END AS again FROM g),
n AS (SELECT doc_id, CAST(sum(k) AS BIGINT) AS n_repeat_words FROM (SELECT doc_id, greatest(again, coalesce(lag(again, 1) OVER o, 0), coalesce(lag(again, 2) OVER o, 0)) AS k FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
l1 AS (SELECT * FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l2 AS (SELECT *, bool_or(regexp_matches(line, '{_text(TERMINAL)}')) OVER (PARTITION BY doc_id) AS ends, length(regexp_replace(line, '{SPACE}', '', 'g')) AS chars FROM l1),
l3 AS (SELECT doc_id, line, chars,
  (ends AND NOT regexp_matches(line, '{_text(TERMINAL)}')) OR 10 * len(regexp_extract_all(line, '{SYMBOLS}')) > chars AS punctuation,
  regexp_matches(line, '{NAVIGATION}') OR len(regexp_extract_all(line, '{SEPARATOR}')) >= 3 AS navigation,
  regexp_matches(line, '{BOILERPLATE}') AS boilerplate FROM l2),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (punctuation) AS lines_punctuation, count(*) FILTER (navigation) AS lines_navigation,
  count(*) FILTER (boilerplate) AS lines_boilerplate, coalesce(sum(chars) FILTER (NOT (punctuation OR navigation OR boilerplate)), 0) AS stay FROM l3 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols,
  coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(n.n_repeat_words, 0) AS n_repeat_words, coalesce(l.lines_punctuation, 0) AS lines_punctuation,
  coalesce(l.lines_navigation, 0) AS lines_navigation, coalesce(l.lines_boilerplate, 0) AS lines_boilerplate, coalesce(l.stay, 0) AS stay
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN n ON w.doc_id = n.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN 1 - stay / word_chars ELSE 0.0::DOUBLE END AS lost FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines_punctuation, lines_navigation, lines_boilerplate, CAST(lost AS DOUBLE) AS lost, NOT base_failed AND lost <= 0.5 AS kept FROM v"""

OP3 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + (k // 4) * 5, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

ALNUM = rf"list_filter(regexp_split_to_array(coalesce({LOWER}, ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP4 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {ALNUM} AS words FROM benchmark),
wins AS (SELECT DISTINCT item_id, array_to_string(words[i + 1 : i + 10], ' ') AS win, least(len(words), 10) AS n
  FROM (SELECT item_id, words, unnest(range(0, greatest(len(words) - 10, 0) + 1)) AS i FROM items WHERE len(words) > 0)),
docs AS (SELECT doc_id, {ALNUM} AS words FROM documents),
sizes AS (SELECT DISTINCT n FROM wins),
spot AS (SELECT doc_id, words, n, unnest(range(0, len(words) - n + 1)) AS i FROM docs, sizes WHERE len(words) >= n),
hit AS (SELECT a.doc_id, a.i, a.n, w.item_id FROM (SELECT doc_id, i, n, array_to_string(words[i + 1 : i + n], ' ') AS win FROM spot) a JOIN wins w ON a.win = w.win AND a.n = w.n),
cover AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
toks AS MATERIALIZED (SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM docs),
own AS (SELECT item_id, term, min(pos) AS pos FROM (SELECT item_id, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM items) GROUP BY item_id, term),
ranked AS MATERIALIZED (SELECT item_id, o.term, o.pos, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n, 0), o.term) AS r FROM own o LEFT JOIN (SELECT term, count(*) AS n FROM toks GROUP BY term) f ON o.term = f.term),
lead AS (SELECT * FROM ranked WHERE r = 1),
reach AS (SELECT l.item_id, l.term, greatest(20, max(abs(t.pos - l.pos))) AS reach, count(*) AS want FROM lead l JOIN ranked t ON l.item_id = t.item_id WHERE t.r <= 3 GROUP BY l.item_id, l.term),
lead_at AS MATERIALIZED (SELECT l.item_id, l.reach, l.want, a.doc_id, a.pos FROM reach l JOIN toks a ON a.term = l.term),
top_at AS MATERIALIZED (SELECT t.item_id, t.r, b.doc_id, b.pos FROM ranked t JOIN toks b ON b.term = t.term WHERE t.r <= 3),
met AS (SELECT l.doc_id, l.item_id, l.pos, any_value(l.want) AS want, count(DISTINCT t.r) AS n FROM lead_at l JOIN top_at t ON t.item_id = l.item_id AND t.doc_id = l.doc_id
  WHERE abs(t.pos - l.pos) <= l.reach GROUP BY l.doc_id, l.item_id, l.pos),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM met WHERE n = want GROUP BY doc_id)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated, coalesce(p.n_near, 0) AS n_near
FROM docs d LEFT JOIN cover c ON d.doc_id = c.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id LEFT JOIN near p ON d.doc_id = p.doc_id"""

OP7 = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce({LOWER}, ''), '{SPACE}+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 5, 0) + 1)) AS i FROM docs WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.low AS component_id FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) r ON r.x = d.doc_id"""

OP9 = """
WITH docs AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
wins AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM docs WHERE len(h) >= 400)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM wins) WHERE n > 1),
marked AS (SELECT doc_id, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, -1) THEN 1 ELSE 0 END AS opens FROM again),
runs AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM spans),
cut AS (SELECT g.doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM gaps g JOIN docs d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, sha256(unhex(coalesce(c.kept, d.h))) AS kept_sha256 FROM docs d LEFT JOIN cut c ON d.doc_id = c.doc_id"""
