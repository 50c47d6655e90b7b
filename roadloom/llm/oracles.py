"""SQL of the operators whose results SQL can express, by plain joins instead of their methods."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), c AS (
  SELECT doc_id AS node, doc_id AS component FROM documents UNION SELECT e.b, c.component FROM c JOIN e ON e.a = c.node
), m AS (
  SELECT node, min(component) AS component_id FROM c GROUP BY node
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

PASSAGES = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL
), iw AS (
  SELECT DISTINCT item, least(len(words), 10) AS size, unnest(CASE WHEN len(words) >= 10 THEN list_transform(range(1, len(words) - 8), lambda k: array_to_string(words[k:k + 9], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS part FROM i
), dw AS (
  SELECT r, size, k, array_to_string(words[k:k + size - 1], ' ') AS part
  FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM iw))
), h AS (
  SELECT r, k, iw.size, item FROM dw JOIN iw ON iw.part = dw.part AND iw.size = dw.size
), p AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS place FROM h) GROUP BY r
), f AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
), v AS (
  SELECT part, any_value(size) AS size, list_distinct(string_split(part, ' ')) AS need FROM iw GROUP BY part
), vw AS (
  SELECT part, size, len(need) AS needed, unnest(need) AS word FROM v
), dt AS (
  SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos, len(words) AS n FROM d
), c AS (
  SELECT r, part, any_value(size) AS size, any_value(needed) AS needed FROM (SELECT DISTINCT r, word FROM dt) JOIN vw USING (word) GROUP BY r, part HAVING count(*) = any_value(needed)
), st AS (
  SELECT r, part, s, any_value(size) AS size, any_value(n) AS n FROM (
    SELECT c.r, c.part, c.size, c.needed, dt.n, dt.word, unnest(range(greatest(1, pos - c.size - 4), pos + 1)) AS s
    FROM c JOIN vw ON vw.part = c.part JOIN dt ON dt.r = c.r AND dt.word = vw.word)
  GROUP BY r, part, s HAVING count(DISTINCT word) = any_value(needed)
), np AS (
  SELECT r, count(DISTINCT place) AS n_near FROM (SELECT r, unnest(range(s, least(s + size + 5, n + 1))) AS place FROM st) GROUP BY r
), nf AS (
  SELECT r, count(DISTINCT item) AS n_near_items FROM st JOIN iw USING (part) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(coalesce(n_near_items, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN p USING (r) LEFT JOIN f USING (r) LEFT JOIN np USING (r) LEFT JOIN nf USING (r)
"""

#: Every window of 100 bytes by its digest; bytes as hexadecimal digits.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(greatest(n - 99, 0))) AS p FROM d)),
f AS (SELECT k, min(CAST(doc_id AS HUGEINT) * 4294967296 + p) AS first FROM w GROUP BY k HAVING count(*) > 1),
l AS (SELECT doc_id, p FROM w JOIN f USING (k) WHERE CAST(doc_id AS HUGEINT) * 4294967296 + p <> first),
m AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM l),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM m),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, g),
c AS (SELECT doc_id, b - a AS size, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM s),
r AS (SELECT doc_id, sum(size) AS n_removed, count(*) AS n_spans, max(a + size) AS last, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept FROM c JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN r.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
