"""DuckDB SQL for the text queries that SQL can express."""

_SPACE = "[\\x20\\x09-\\x0D]+"

_OP6 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1, 's') AS raw_host, rest FROM cut
), urls AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^([^?#]*)', 1, 's') AS path FROM parts
), rules(verdict, root, begins) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
  SELECT page_id, host, path, max_by(root || begins, length(root || begins)) AS rule, max_by(verdict, length(root || begins)) AS verdict
  FROM urls JOIN rules ON (host = root OR suffix(host, '.' || root)) AND prefix(path, begins) GROUP BY ALL
)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN best b ON u.page_id = b.page_id AND u.host = b.host AND u.path = b.path
"""

_OP7 = rf"""
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS body FROM documents
), groups AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY body
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM norm n JOIN groups g ON n.body = g.body
"""

_OP8 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(
    list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
), sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), classes AS (
  SELECT min(doc_id) AS id, any_value(n) AS n, list(doc_id) AS ids, any_value(k) AS k
  FROM (SELECT doc_id, any_value(n) AS n, list_sort(list(g)) AS k FROM sh GROUP BY doc_id) GROUP BY hash(k), k
), shc AS (SELECT id, n, unnest(k) AS g FROM classes
), pairs AS (
  SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM shc a JOIN shc b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id
), links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (na + nb - shared)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(v, r) AS (
  SELECT id, id FROM classes UNION SELECT e.b, x.r FROM reach x JOIN edges e ON e.a = x.v
), comp AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v
), named AS (SELECT unnest(c.ids) AS doc_id, m.component_id FROM classes c JOIN comp m ON c.id = m.v)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(n.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(n.component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN named n ON s.doc_id = n.doc_id
"""

_OP11 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), i AS (
  SELECT item_id, row_number() OVER () AS item_no, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark
), totals AS (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d
), tf AS (SELECT row_no, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM (SELECT row_no, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY row_no, term
), w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, n_docs
), scores AS (
  SELECT i.item_no, any_value(i.item_id) AS item_id, tf.row_no, any_value(tf.doc_id) AS doc_id,
    sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * tf.n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN tf ON i.term = tf.term JOIN w ON w.term = tf.term, totals GROUP BY i.item_no, tf.row_no
), best AS (SELECT item_id, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM best WHERE rank <= 10
"""

_OP12 = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(0, 256)) AS i))
), d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size, coalesce(doc_id::VARCHAR, '') AS doc, row_number() OVER () AS row_no,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32
  FROM documents, crc
), leaves AS (
  SELECT shard, 'r' || (shard // 20) AS region, 'r' || (shard // 20) || '/k' || (shard % 20 // 5) AS rack FROM (SELECT unnest(range(0, 40)) AS shard)
  UNION ALL SELECT 40, 'added40', 'added40/k0'
), nodes AS (
  SELECT larger, '' AS parent, region AS name, count(*) AS weight FROM leaves, (VALUES (false), (true)) x(larger) WHERE larger OR shard < 40 GROUP BY ALL
  UNION ALL SELECT larger, region, rack, count(*) FROM leaves, (VALUES (false), (true)) x(larger) WHERE larger OR shard < 40 GROUP BY ALL
  UNION ALL SELECT larger, rack, rack || '/' || shard, 1 FROM leaves, (VALUES (false), (true)) x(larger) WHERE larger OR shard < 40
), path AS (
  SELECT row_no, doc, larger, '' AS node, 0 AS depth FROM d, (VALUES (false), (true)) x(larger)
  UNION ALL
  SELECT p.row_no, p.doc, p.larger, arg_min(n.name, -ln((('0x' || substr(md5(n.name || '|' || p.doc), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / n.weight), p.depth + 1
  FROM path p JOIN nodes n ON n.larger = p.larger AND n.parent = p.node WHERE p.depth < 3 GROUP BY ALL
), put AS (
  SELECT row_no, max(split_part(node, '/', 3)::INTEGER) FILTER (NOT larger) AS shard, max(split_part(node, '/', 3)::INTEGER) FILTER (larger) AS grown_shard
  FROM path WHERE depth = 3 GROUP BY row_no
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard
    ORDER BY substr(md5('slot|' || doc || '|' || size || '|' || text_crc32), 1, 13), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM d JOIN put USING (row_no)
"""

_OP13 = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row_no,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), w AS (SELECT lang, source, row_no, unnest(terms) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT row_no) >= 3
), groups AS (SELECT DISTINCT lang, source FROM d
), langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), cells AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (SELECT lang, source, sum(c)::HUGEINT AS total FROM cells GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(t.total, 0) + l.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v))::BIGINT AS lang_p
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - lang_p) * (p - lang_p)) // lang_p AS value FROM shares WHERE c > 0 AND p > lang_p
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLES: dict[str, str] = {
    "op6_url_filter": _OP6, "op7_exact_dedup": _OP7, "op8_near_dup": _OP8, "op11_lexical_search": _OP11, "op12_hash_tree_shards": _OP12,
    "op13_source_audit": _OP13,
}
