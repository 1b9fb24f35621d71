"""DuckDB SQL for the queries that SQL can express."""

OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
coded AS (
  SELECT *, 8 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsb;'), chr(10), '&nl;')) + 1
            + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsb;')) + 8 AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n FROM turns),
placed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM coded)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""

OP10 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {documents}),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS k
  FROM sized GROUP BY source),
aims AS (
  SELECT *, [5.0, 2.0, 1.0][(k % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap,
         (sum(source_size) OVER ())::DOUBLE * 150 / 100.0::DOUBLE AS total FROM per),
rounds AS (
  SELECT 0 AS i, source, source_size, w, cap, total, false AS stopped FROM aims
  UNION ALL
  SELECT i + 1, source, source_size, w, cap, total, stopped OR w * level >= cap FROM (
    SELECT *, (total - coalesce(sum(cap) FILTER (stopped) OVER (), 0)) / nullif(sum(w) FILTER (NOT stopped) OVER (), 0) AS level FROM rounds)
  WHERE i < (SELECT count(*) FROM aims)),
fixed AS (SELECT * FROM rounds WHERE i = (SELECT count(*) FROM aims)),
target AS (
  SELECT source, source_size, CASE WHEN stopped THEN cap ELSE w * ((total - coalesce(sum(cap) FILTER (stopped) OVER (), 0))
         / sum(w) FILTER (NOT stopped) OVER ()) END AS target FROM fixed),
unit AS (
  SELECT s.*, t.source_size, t.target,
         least(round(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END * 1000000), 2000000)::BIGINT AS units,
         ('0x' || substr(md5('0 ' || coalesce(s.source, chr(0) || 'null')), 1, 12))::BIGINT % 1000000 AS shift,
         length(bin(size + 1)) * 32 + ((size + 1) >> greatest(length(bin(size + 1)) - 5, 0)) AS class,
         ((doc_id % 256) + 256) % 256 AS salt
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source),
summed AS (
  SELECT *, (sum(units) OVER (PARTITION BY source ORDER BY class, salt, size, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT + shift AS upto FROM unit)
SELECT doc_id, size, source_size, target, ((upto // 1000000 - (upto - units) // 1000000) * size)::BIGINT AS taken FROM summed
"""

OP12 = r"""
WITH words AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
known AS (SELECT k, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
total AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM known),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
vectors AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM known) GROUP BY k, term HAVING term IN (SELECT term FROM asked)),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(t.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM vectors, total t GROUP BY term),
scored AS (
  SELECT a.item_id, v.k, any_value(d.doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * d.n * t.n) // t.l))))::BIGINT AS score
  FROM asked a JOIN vectors v USING (term) JOIN weights USING (term) JOIN known d ON d.k = v.k, total t GROUP BY a.item_id, v.k)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

OP13 = r"""
WITH RECURSIVE bit AS (SELECT CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS x, v FROM (SELECT range AS v FROM range(256))),
grind AS (
  SELECT 0 AS i, v, v AS x FROM bit
  UNION ALL SELECT i + 1, v, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM grind WHERE i < 8),
crc AS (SELECT list(x ORDER BY v) AS t FROM grind WHERE i = 8),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
coded AS (
  SELECT r.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)),
         lambda a, b: xor(a >> 8, t[(xor(a & 255, b) + 1)::INT])), 4294967295) % 20 AS kind FROM raw r, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS k,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
turns AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (k > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
inserted(p, q, edits, said, price) AS (VALUES
  (0, 0, '', '', 0), (0, 2, 'I', chr(10) || 'user:', 3), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 6),
  (1, 1, '', '', 0), (1, 2, 'I', chr(10) || 'user:', 3), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 6),
  (2, 2, '', '', 0), (2, 3, 'I', chr(10) || 'assistant:', 3), (3, 3, '', '', 0), (3, 2, 'I', chr(10) || 'user:', 3)),
edit(q, letter, initial, r, role) AS (VALUES
  (0, 'D', NULL, 0, NULL), (1, 'D', NULL, 1, NULL), (2, 'D', NULL, 2, NULL), (3, 'D', NULL, 3, NULL),
  (0, 'K', 's', 1, NULL), (0, 'K', 'u', 2, NULL), (1, 'K', 'u', 2, NULL), (2, 'K', 'a', 3, NULL), (3, 'K', 'u', 2, NULL),
  (0, 'R', NULL, 2, 'user'), (1, 'R', NULL, 2, 'user'), (3, 'R', NULL, 2, 'user'), (2, 'R', NULL, 3, 'assistant')),
walk AS (
  SELECT conv_id, 0::BIGINT AS k, 0 AS p, 0 AS cost, '' AS audit, '' AS said FROM counts
  UNION ALL
  SELECT conv_id, k, r, cost, audit, said FROM (
    SELECT t.conv_id, t.k, e.r, w.cost + i.price + CASE e.letter WHEN 'D' THEN 4 ELSE CASE e.letter WHEN 'R' THEN 3 ELSE 0 END
             + CASE t.fault WHEN 'truncated' THEN 3 ELSE 0 END END AS cost,
           w.audit || i.edits || e.letter AS audit,
           w.said || i.said || CASE e.letter WHEN 'D' THEN '' ELSE chr(10) || coalesce(e.role, t.role) || ':' || t.text END AS said
    FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.k = w.k + 1
    JOIN inserted i ON i.p = w.p JOIN edit e ON e.q = i.q
    WHERE (e.initial IS NULL OR left(t.role, 1) = e.initial) AND (e.letter = 'D' OR t.fault NOT IN ('blank', 'duplicate')))
  QUALIFY row_number() OVER (PARTITION BY conv_id, k, r ORDER BY cost, audit) = 1),
ended AS (
  SELECT c.*, w.cost + i.price AS cost, w.audit || i.edits AS audit, w.said || i.said AS said
  FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.k = c.n JOIN inserted i ON i.p = w.p AND i.q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY w.cost + i.price, w.audit || i.edits) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(substr(said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""

SQL = {"op9_chat_formatting": OP9, "op10_source_mixing": OP10.format(documents="documents"),
       "op12_ranked_search": OP12, "op13_conversation_repair": OP13}
