"""The registered queries in SQL, where SQL can say what they return.

The queries that draw, encode with a tokenizer or hash with XXH64 have none; tests
hold them against brute force.
"""

from __future__ import annotations

_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"

WARC = """
WITH digested AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages),
roles AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS response,
         unhex(hex)::BIT::VARCHAR AS bits
  FROM digested)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + list_sum(list_transform(range(0, 5), lambda k:
           substr(bits, (5 * i + k + 1)::INT, 1)::INT * (16 >> k::INT))))::INT, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < response THEN response END AS refers_to
FROM roles
"""

URL_LISTS = r"""
WITH captures AS (
  SELECT page_id, lower(trim(url)) AS url,
         TIMESTAMP '2016-01-01 00:00:00' + to_minutes((page_id * 373) % 1051200) AS fetched_at
  FROM pages),
seen AS (
  SELECT page_id, fetched_at, nullif(rtrim(regexp_extract(
    url, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.'), '') AS host
  FROM captures),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM seen WHERE host IS NOT NULL),
domains AS (
  SELECT host AS domain FROM hosts
  UNION SELECT array_to_string(labels[2:], '.') FROM hosts WHERE len(labels) > 2),
drawn AS (
  SELECT domain, strpos('0123456789abcdef', substr(md5(domain), 1, 1)) - 1 AS a,
         strpos('0123456789abcdef', substr(md5(domain), 2, 1)) - 1 AS b,
         strpos('0123456789abcdef', substr(md5(domain), 3, 1)) - 1 AS c
  FROM domains),
entries AS (
  SELECT domain, 'block' AS action, TIMESTAMP '2016-01-01 00:00:00' + to_days((30 * a)::INT) AS dated FROM drawn
  UNION ALL SELECT domain, 'remove', TIMESTAMP '2016-01-01 00:00:00' + to_days((30 * a + 40 + 10 * b)::INT) FROM drawn
  UNION ALL SELECT domain, CASE WHEN c % 2 = 0 THEN 'allow' ELSE 'block' END,
    TIMESTAMP '2016-01-01 00:00:00' + to_days((30 * a + 200 + 10 * c)::INT) FROM drawn WHERE c < 12),
last AS (
  SELECT domain, dated, arg_max(action, CASE action WHEN 'block' THEN 1 WHEN 'allow' THEN 2 ELSE 3 END) AS action
  FROM entries GROUP BY domain, dated),
looked_up AS (
  SELECT page_id, host, fetched_at, i - 1 AS place,
         array_to_string(string_split(host, '.')[i:], '.') AS domain
  FROM (SELECT *, unnest(range(1, greatest(2, len(string_split(host, '.'))))) AS i
        FROM seen WHERE host IS NOT NULL)),
matched AS (
  SELECT l.page_id, l.place, l.domain, e.action, e.dated
  FROM looked_up l ASOF JOIN last e ON l.domain = e.domain AND l.fetched_at >= e.dated),
best AS (
  SELECT page_id, arg_min(struct_pack(domain := domain, action := action, dated := dated), place) AS e
  FROM matched WHERE action <> 'remove' GROUP BY page_id)
SELECT s.page_id, s.host, strftime(s.fetched_at, '%Y-%m-%d %H:%M') AS fetched_at, e.domain AS domain,
       e.action AS action, strftime(e.dated, '%Y-%m-%d %H:%M') AS since,
       coalesce(e.action <> 'block', true) AS kept
FROM seen s LEFT JOIN best USING (page_id)
"""

VECTORS = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(b, vec_id), vec_id) AS component_id,
       coalesce(least(b, vec_id), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counted ON counted.a = vec_id LEFT JOIN least ON least.a = vec_id
"""

HOSTS = rf"""
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w
  FROM documents),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS l
  FROM texts),
windows AS (
  SELECT doc_id, i, w[i:i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
repeated AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS place
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM repeated GROUP BY doc_id),
measured AS (
  SELECT t.doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '{_BLANK}', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM texts t JOIN lines USING (doc_id) LEFT JOIN covered c ON c.doc_id = t.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
hosts AS (
  SELECT source, count(*)::DOUBLE AS docs, count(*) FILTER (base_failed)::DOUBLE AS failures
  FROM judged GROUP BY source),
fitted AS (
  SELECT m, CASE WHEN spread - chance > 0
    THEN greatest(m * (1 - m) / (spread - chance) - 1, 0.0) END AS k
  FROM (SELECT sum(failures) / sum(docs) AS m,
               sum(failures * failures / docs) / sum(docs) - m * m AS spread,
               count(*) * m * (1 - m) / sum(docs) AS chance FROM hosts)),
rates AS (
  SELECT source, coalesce((failures + k * m) / (docs + k), m) AS rate FROM hosts, fitted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.5 AS kept
FROM judged j JOIN rates r ON j.source IS NOT DISTINCT FROM r.source
"""

TRIE = r"""
WITH crc AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(
    list_prepend(n, range(0, 8)),
    lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(
           length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
    lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1]))) % 4 AS h
  FROM (SELECT c, count(*) AS n FROM turns GROUP BY c), crc),
rebuilt AS (
  SELECT v.c, b.pos, b.role, b.text FROM convs v JOIN turns b ON b.c = v.c - v.c % 20 AND b.pos <= v.h
  UNION ALL
  SELECT v.c, o.pos - v.h + least(v.h, coalesce(b.n, 0)), o.role, o.text
  FROM convs v JOIN turns o ON o.c = v.c AND o.pos > v.h LEFT JOIN convs b ON b.c = v.c - v.c % 20),
members AS (
  SELECT c, 0 AS depth, [] AS path, 0 AS words FROM convs
  UNION ALL
  SELECT c, pos, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY pos),
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
  FROM rebuilt),
lengths AS (SELECT c, max(depth) AS length FROM members GROUP BY c),
grouped AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = length) AS ends
  FROM members JOIN lengths USING (c) GROUP BY path, depth),
placed AS (SELECT m.c, m.depth, g.conv_id FROM members m JOIN grouped g USING (path, depth)),
nodes AS (
  SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, n_convs, words, ends
  FROM grouped g LEFT JOIN placed p ON p.c = g.conv_id AND p.depth = g.depth - 1),
kids AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children
  FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (conv_id, depth)),
below AS (
  SELECT p.conv_id, p.depth, count(*) FILTER (k.n_children = 0) AS n_leaves,
         sum((k.n_convs - 1) * k.words) AS saved_tokens
  FROM counted k JOIN placed p ON p.c = k.conv_id AND p.depth <= k.depth GROUP BY ALL)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM counted JOIN below USING (conv_id, depth)
"""

AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good,
         bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id),
failing AS (
  SELECT texts.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         concat(
           CASE WHEN len(words) < 200 THEN 'A' END,
           CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
           CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t)
             THEN 'C' END,
           CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
           CASE WHEN texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails
  FROM texts LEFT JOIN marks ON texts.doc_id = marks.doc_id),
counted AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failing GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f,
         left(filter_order, step - 1) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
met AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails,
         contains(fails, f) AS failing,
         fails <> '' AND before <> ''
           AND len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AS gone
  FROM steps, counted),
summed AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (failing AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (failing AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost,
       toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM summed
"""

ORACLES = {
    "op2_warc_chunks": WARC,
    "op4_temporal_lists": URL_LISTS,
    "op6_pivot_index": VECTORS,
    "op7_host_rules": HOSTS,
    "op11_prefix_trie": TRIE,
    "op12_filter_audit": AUDIT,
}
