"""DuckDB SQL of the queries that SQL can express; constants are written out anew."""

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
        FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
      FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
x AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM p),
h AS (SELECT x.doc_id, x.i, x.n, g.item FROM x JOIN g ON x.n = g.n AND x.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM d
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, len(regexp_extract_all(text, '\p{L}{1,4}|\p{N}{1,3}|[^\x00-\x20\p{L}\p{N}]')) + 8 AS tokens,
    4 + length(role) + 2 + length(text) + 8 + (length(text) - length(replace(text, '\', '')))
      + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + length(array_to_string(regexp_extract_all(text, '####*'), ''))
      - 2 * len(regexp_extract_all(text, '####*')) AS chars
  FROM c),
n AS (
  SELECT *, row_number() OVER w - 1 AS number, coalesce(sum(tokens) OVER (
      PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    count(*) OVER (PARTITION BY conv_id) AS turns
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
y AS (SELECT conv_id, tokens, chars FROM n WHERE number = 0 AND role = 'system'),
r AS (
  SELECT n.*, n.before - coalesce(y.tokens, 0) AS start, y.chars AS kept,
    greatest(1024 - coalesce(y.tokens, 0), 512) AS room
  FROM n LEFT JOIN y ON y.conv_id = n.conv_id
  WHERE n.turns = 1 OR n.number > 0 OR n.role <> 'system'),
s AS (SELECT *, CASE WHEN number = 0 THEN 0 ELSE start END AS beg, least(256, room // 2) AS past FROM r),
k AS (SELECT *, CAST(beg + tokens - 1 AS BIGINT) // CAST(room - past AS BIGINT) AS k FROM s),
f AS (
  SELECT conv_id, chars, kept, turns, 2 * k + CASE WHEN beg < k * (room - past) - past THEN 0 ELSE 1 END AS win,
    CASE WHEN beg >= (k + 1) * (room - past) - past THEN 2 * k + 3 END AS again
  FROM k),
d AS (SELECT conv_id, win, max(CASE WHEN turns > 1 THEN kept END) AS kept FROM f GROUP BY conv_id, win),
p AS (
  SELECT conv_id, chars FROM f
  UNION ALL SELECT conv_id, coalesce(kept, 0) FROM d
  UNION ALL SELECT f.conv_id, f.chars FROM f JOIN d ON d.conv_id = f.conv_id AND d.win = f.again),
q AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM p GROUP BY conv_id),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    coalesce(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn), '') AS said,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM c GROUP BY conv_id)
SELECT g.conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars
FROM g JOIN q ON q.conv_id = g.conv_id
"""

COLLOCATIONS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
o AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
  FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
g AS (
  SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM o)
  GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS v, unnest(range(1, k)) AS cut FROM g WHERE k > 1),
s AS (
  SELECT c.lang, c.phrase, c.f AS a, c.cut, h.f AS l, e.f AS r, t.n,
    CAST((CAST(1000 AS HUGEINT) * c.f * t.n) // (CAST(h.f AS HUGEINT) * e.f) AS BIGINT) AS score
  FROM c JOIN g h ON h.lang = c.lang AND h.phrase = array_to_string(c.v[1:c.cut], ' ')
  JOIN g e ON e.lang = c.lang AND e.phrase = array_to_string(c.v[c.cut + 1:], ' ')
  JOIN t ON t.lang = c.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS first FROM s),
i AS (
  SELECT DISTINCT lang, f, array_to_string(v[x:x + y - 1], ' ') AS phrase
  FROM (SELECT lang, f, k, v, y, unnest(range(1, k - y + 2)) AS x
        FROM (SELECT DISTINCT lang, f, k, v, unnest(range(2, k)) AS y FROM c WHERE k > 2))),
d AS (
  SELECT lang, phrase, a, l, r, n, score FROM b
  WHERE first = 1 AND NOT EXISTS (
    SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 100 * b.a)),
x AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, rank, phrase, a, l, r, n, score FROM x WHERE rank <= 2000
"""
