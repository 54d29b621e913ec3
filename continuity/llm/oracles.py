"""DuckDB SQL that must give the rows of the queries of the same name.

Operators that SQL cannot express (BPE, HTML, SimHash with its components, seeds, chunks,
disclosure) have none; they are tested against brute force.
"""

from __future__ import annotations

# What the operators fix: white space, marks and phrases.
_SPACE = r"[\x20\x09-\x0D]"
_PHRASES = (
    "all rights reserved", "copyright ©", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "uses cookies", "accept cookies", "enable javascript",
    "javascript is disabled", "javascript is required", "lorem ipsum",
    "subscribe to our newsletter", "licensed under ", "released under ",
)
_MENU = (
    "home|menu|search|next|previous|back|back to top|log ?in|log ?out|sign ?in|sign ?up|register"
    "|share|print|contact( us)?|about( us)?|read more|show more|skip to content|site ?map|subscribe"
)
_NOTICE = " OR ".join(f"contains(low, '{p}')" for p in _PHRASES)

QUALITY = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT rid, doc_id, t,
    list_filter(string_split_regex(t, '{_SPACE}+'), lambda w: w <> '') AS ws FROM docs),
placed AS (
  SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM words),
windows AS (
  SELECT rid, i, w AS a, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c FROM placed
  WINDOW p AS (PARTITION BY rid ORDER BY i)),
counted AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
covered AS (
  SELECT rid, count(DISTINCT i + j) AS n_repeat_words
  FROM counted, (VALUES (0), (1), (2)) AS v(j) WHERE n > 1 GROUP BY rid),
lines AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs),
spoken AS (
  SELECT rid, line, lower(line) AS low,
    list_filter(string_split_regex(line, '{_SPACE}+'), lambda w: w <> '') AS ws
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
figured AS (
  SELECT *, len(ws) AS n, length(list_aggregate(ws, 'string_agg', '')) AS chars,
    len(list_filter(ws, lambda w: w IN ('|', '»', '›', '•', '·', '→', '::', '/', '>', '>>'))) AS seps,
    len(list_filter(ws, lambda w: regexp_matches(w, '[!?]{{2,}}$'))) AS shouts,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols
  FROM spoken),
judged AS (
  SELECT *, CASE
    WHEN n <= 30 AND ({_NOTICE}) THEN 'boilerplate'
    WHEN (seps > 0 AND 100 * seps >= 20 * n) OR (n <= 4 AND regexp_matches(
      line, '(?i)^{_SPACE}*({_MENU})[.!:]?{_SPACE}*$')) THEN 'navigation'
    WHEN 100 * symbols > 10 * chars OR (shouts > 1 AND 100 * shouts >= 20 * n)
      OR (n >= 8 AND NOT regexp_matches(line, '[.!?…。！？]["''”’»)\]]*({_SPACE}|$)'))
      THEN 'punctuation' END AS fault
  FROM figured),
by_line AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (fault = 'boilerplate') AS n_boilerplate,
    count(*) FILTER (fault = 'navigation') AS n_navigation,
    count(*) FILTER (fault = 'punctuation') AS n_punctuation,
    CAST(coalesce(sum(chars) FILTER (fault IS NOT NULL), 0) AS BIGINT) AS lost_chars
  FROM judged GROUP BY rid),
figures AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(coalesce(list_aggregate(ws, 'string_agg', ''), '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_boilerplate, 0) AS n_boilerplate,
    coalesce(n_navigation, 0) AS n_navigation, coalesce(n_punctuation, 0) AS n_punctuation,
    coalesce(lost_chars, 0) AS lost_chars
  FROM words LEFT JOIN covered USING (rid) LEFT JOIN by_line USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND 100 * lost_chars <= 30 * word_chars AS kept
FROM figures
"""

# 64 shards and 6421 slots, the least prime of 100 slots a shard. Each step is one turn.
SHARDING = """
WITH RECURSIVE shards AS (
  SELECT k, ('0x' || substr(md5(format('shard-{:02d}:start', k)), 1, 15))::BIGINT % 6421 AS start,
    ('0x' || substr(md5(format('shard-{:02d}:step', k)), 1, 15))::BIGINT % 6420 + 1 AS step
  FROM range(64) AS r(k)),
turns(turn, slots) AS (
  SELECT 0, list_transform(range(6421), lambda x: -1)
  UNION ALL
  SELECT turn + 1, slots[:claimed] || [k] || slots[claimed + 2:]
  FROM (
    SELECT turn, slots, k,
      (start + step * list_first(list_filter(range(6421),
        lambda j: slots[(start + step * j) % 6421 + 1] < 0))) % 6421 AS claimed
    FROM turns JOIN shards ON k = turn % 64 WHERE turn < 6421)),
filled AS (SELECT slots FROM turns WHERE turn = 6421),
lookup AS (
  SELECT unnest(range(6421)) AS slot, CAST(unnest(slots) AS INTEGER) AS shard FROM filled)
SELECT doc_id, slot, shard FROM (
  SELECT doc_id,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % 6421 AS slot
  FROM documents) JOIN lookup USING (slot)
"""

CHAT = """
WITH ordered AS (
  SELECT conv_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST,
      text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
replies AS (
  SELECT conv_id, pos AS ends, text AS reply FROM ordered WHERE role = 'assistant'
  QUALIFY pos = max(pos) OVER (PARTITION BY conv_id)),
pairs AS (
  SELECT a.conv_id AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.ends, b.reply
  FROM replies a JOIN replies b ON b.conv_id = xor(a.conv_id, CAST(1 AS BIGINT))),
sides AS (
  SELECT pair_id, s.side, pos, role,
    CASE WHEN s.side = 1 AND pos = ends THEN reply ELSE text END AS text
  FROM pairs JOIN ordered ON ordered.conv_id = pair_id AND pos <= ends
  CROSS JOIN (VALUES (0), (1)) s(side)),
turns AS (
  SELECT *, '<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) AS head,
    replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' AS tail
  FROM sides),
compared AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos,
    a.pos IS NOT NULL AND b.pos IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role
      AND a.text IS NOT DISTINCT FROM b.text AS same
  FROM (SELECT * FROM turns WHERE side = 0) a
  FULL JOIN (SELECT * FROM turns WHERE side = 1) b ON a.pair_id = b.pair_id AND a.pos = b.pos),
common AS (
  SELECT pair_id, CAST(coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) AS INTEGER) AS n_common
  FROM compared GROUP BY pair_id),
measured AS (
  SELECT t.*, n_common, pos <= n_common AS shared,
    sum(length(head) + length(tail) + 1) OVER (PARTITION BY pair_id, side, pos <= n_common ORDER BY pos)
      - length(tail) - 1 AS begins
  FROM turns t JOIN common USING (pair_id)),
rendered AS (
  SELECT pair_id, n_common,
    coalesce(string_agg(head || tail || chr(10), '' ORDER BY pos) FILTER (shared AND side = 0), '') AS prompt,
    coalesce(string_agg(head || tail || chr(10), '' ORDER BY pos) FILTER (NOT shared AND side = 0), '') AS chosen,
    coalesce(string_agg(head || tail || chr(10), '' ORDER BY pos) FILTER (NOT shared AND side = 1), '') AS rejected,
    coalesce(string_agg(CAST(begins AS VARCHAR) || ':' || CAST(begins + length(tail) AS VARCHAR), ',' ORDER BY pos)
      FILTER (NOT shared AND side = 0 AND role = 'assistant'), '') AS chosen_spans,
    coalesce(string_agg(CAST(begins AS VARCHAR) || ':' || CAST(begins + length(tail) AS VARCHAR), ',' ORDER BY pos)
      FILTER (NOT shared AND side = 1 AND role = 'assistant'), '') AS rejected_spans
  FROM measured GROUP BY pair_id, n_common)
SELECT pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_spans,
  rejected_spans
FROM pairs JOIN rendered USING (pair_id)
"""

INFILL = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
drawn AS (
  SELECT doc_id, t, units, len(units) AS n,
    CAST('0x' || d[1:8] AS BIGINT) % (len(units) + 1) AS a,
    CAST('0x' || d[9:16] AS BIGINT) % (len(units) + 1) AS b,
    CAST('0x' || d[17:24] AS BIGINT) % 100 AS plain_draw,
    CAST('0x' || d[25:32] AS BIGINT) % 100 AS form_draw FROM docs),
cut AS (
  SELECT doc_id, t, n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
      OR plain_draw >= 90 THEN 'plain' WHEN form_draw < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:least(a, b)], '') AS p,
    array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(units[greatest(a, b) + 1:], '') AS s FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut"""

# The digest of a run is worked out byte by byte from the table of the polynomial.
_CRC_TABLE = """
WITH RECURSIVE step AS (
  SELECT b, CAST(b AS BIGINT) AS c, 0 AS k FROM range(256) AS r(b)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
tbl AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8)"""

SPELLING = rf"""{_CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM counted),
digested AS (
  SELECT run, n, xor(list_reduce(
    list_transform(range(0, length(x), 2), lambda i: CAST('0x' || x[i + 1:i + 2] AS BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM bytes, tbl),
spelt AS (
  SELECT CASE WHEN h % 199 = 0
    THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM digested),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6
  GROUP BY word HAVING sum(n) >= 5),
gaps AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS less FROM gaps),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n
  FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.less = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.less = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS near_n, arg_min(near, (-near_n, near)) AS near
  FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= 5 * w.n THEN near END AS form,
    CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS at, form AS following FROM forms
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.following)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word AND c.following IS NULL"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": QUALITY,
    "op6_sharding": SHARDING,
    "op10_chat_formatting": CHAT,
    "op11_fill_in_middle": INFILL,
    "op12_spelling_variants": SPELLING,
}
