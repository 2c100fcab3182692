"""DuckDB SQL of the queries that SQL can express."""

OP6 = r"""
WITH base AS (
  SELECT page_id AS n, url, html, (page_id * 7919) % 1000003 AS first,
    (page_id * 7919) % 1000003 + ((page_id * 31) % 9) * 3600 - 3600 AS again,
    '"' || substr(md5(html), 1, 12) || '"' AS tag, 'day ' || (page_id % 50) AS modified
  FROM pages),
responses AS (
  SELECT 'r' || n AS rid, url, (1700000000 + first) * 1000000 AS us, html,
    {'content-type': 'text/html', 'date': CAST(first AS VARCHAR), 'etag': tag,
     'last-modified': modified} AS h FROM base),
revisits AS (
  SELECT 'v' || n AS record_id,
    regexp_replace(url, '^https?://', 'HTTP://www.') || '#again' AS url,
    (1700000000 + again) * 1000000 AS us,
    CASE WHEN n % 4 < 2 THEN 'W/' || tag WHEN n % 8 = 2 THEN '"changed"' END AS etag,
    CASE WHEN n % 4 = 2 AND n % 8 <> 2 THEN modified END AS modified,
    CASE WHEN n % 4 = 2 AND n % 8 <> 2 THEN 'max-age=60' END AS cache,
    CASE WHEN n % 4 < 2 OR n % 4 = 3 THEN CAST(again AS VARCHAR) END AS date
  FROM base),
keyed AS (
  SELECT kind, id, us, regexp_extract(u, p, 1) AS h0, regexp_extract(u, p, 2) AS p0,
    regexp_extract(u, p, 3) AS q0
  FROM (SELECT 'r' AS kind, rid AS id, url AS u, us FROM responses
        UNION ALL SELECT 'v', record_id, url, us FROM revisits),
       (SELECT '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)([^?#\s]*)(?:\?([^#\s]*))?' AS p)),
keys AS (
  SELECT kind, id, us,
    CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END
    END AS url_key
  FROM (SELECT kind, id, us,
      regexp_replace(regexp_replace(lower(h0), '^.*@', ''), '^www\.|:(80|443)$', '', 'g') AS host,
      regexp_replace(p0, '(/index\.html?)?/*$', '') AS path,
      array_to_string(list_sort(list_filter(string_split(q0, '&'), lambda x: x <> '' AND
        NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=.*)?$'))), '&') AS query
    FROM keyed)),
resp AS (SELECT k.url_key, r.* FROM responses r JOIN keys k ON k.kind = 'r' AND k.id = r.rid),
rev AS (SELECT k.url_key, v.* FROM revisits v JOIN keys k ON k.kind = 'v' AND k.id = v.record_id),
pairs AS (
  SELECT v.*, r.rid, r.html, r.h, row_number() OVER (
    PARTITION BY v.record_id ORDER BY r.us DESC NULLS LAST, r.rid DESC) AS place
  FROM rev v LEFT JOIN resp r ON r.url_key = v.url_key AND r.us < v.us),
judged AS (
  SELECT *, CASE WHEN url_key IS NULL THEN 'unusable' WHEN rid IS NULL THEN 'no_response'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^[Ww]/', '') = h.etag
      THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN modified IS NULL THEN 'no_validator'
    WHEN modified = h."last-modified" THEN 'resolved' ELSE 'validator_mismatch' END AS resolution
  FROM pairs WHERE place = 1)
SELECT record_id, url_key, us AS captured_us, resolution,
  CASE WHEN resolution = 'resolved' THEN rid END AS resolved_id,
  CASE WHEN resolution = 'resolved' THEN CAST(200 AS INTEGER) END AS status,
  CASE WHEN resolution = 'resolved' THEN
    CASE WHEN cache IS NOT NULL THEN 'cache-control: ' || cache || chr(10) ELSE '' END ||
    'content-type: text/html' || chr(10) || 'date: ' || coalesce(date, h.date) || chr(10) ||
    'etag: ' || coalesce(etag, h.etag) || chr(10) ||
    'last-modified: ' || coalesce(modified, h."last-modified") END AS headers,
  CASE WHEN resolution = 'resolved' THEN sha256(html) END AS payload_sha256,
  CASE WHEN resolution = 'resolved' THEN CAST(strlen(html) AS BIGINT) END AS payload_bytes
FROM judged
"""

OP9 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
    replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g') AS erole,
    replace(replace(text, '\', '\s'), '<', '\l') AS etext FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, etext))
    AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn, role, etext)) AS loss_sha256,
  CAST(sum(length('<turn ' || erole || '>' || chr(10) || etext || '</turn>' || chr(10))) AS BIGINT)
    AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP8 = r"""
WITH RECURSIVE vecs AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT a AS node, a AS seen FROM links UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen),
comps AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
  coalesce(component_id, e.vec_id) AS component_id,
  coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN comps ON node = e.vec_id LEFT JOIN counts ON a = e.vec_id
"""

OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b
    ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach AS (
  SELECT a AS node, a AS seen FROM links UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen),
comps AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
  coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN comps ON node = d.doc_id
"""


def _round(k: int) -> str:
    return f'''
a{k} AS MATERIALIZED (
  SELECT vec_id, part, any_value(s) AS s, min(d * 64 + e) AS de FROM (
    SELECT p.vec_id, p.part, p.s, c.e, list_sum(list_transform(range(1, len(p.s) + 1),
      lambda i: (p.s[i] - c.c[i]) * (p.s[i] - c.c[i]))) AS d
    FROM p JOIN c{k} c ON p.part = c.part) GROUP BY vec_id, part),'''


def _moved(k: int) -> str:
    return f'''
m{k} AS (SELECT part, e, i, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM (
    SELECT part, de % 64 AS e, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM a{k})
  GROUP BY part, e, i),
n{k} AS (SELECT part, e, list((t - ((t % n) + n) % n) // n ORDER BY i) AS c FROM m{k}
  GROUP BY part, e),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(n{k}.c, c.c) AS c
  FROM c{k} c LEFT JOIN n{k} ON n{k}.part = c.part AND n{k}.e = c.e),'''


OP11 = r'''
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding,
    lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS z FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, part, z[part * (len(z) // 16) + 1:(part + 1) * (len(z) // 16)] AS s
  FROM v, range(16) t(part)),
c0 AS MATERIALIZED (
  SELECT part, place - 1 AS e, s AS c FROM (
    SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS place FROM p)
  WHERE place <= 64),''' + _round(0) + _moved(0) + _round(1) + _moved(1) + _round(2) + r'''
books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS digest FROM c2),
coded AS MATERIALIZED (
  SELECT vec_id, string_agg(printf('%02x', de % 64), '' ORDER BY part) AS code,
    CAST(sum(de // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error,
  CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  digest AS codebooks_sha256
FROM coded JOIN v USING (vec_id), books
'''

_WORDS = r'''regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')'''

OP12 = r'''
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS t
  FROM range(256) r(n)),
texts AS (
  SELECT 'd' AS kind, doc_id AS id, ''' + _WORDS + r''' AS w FROM documents
  UNION ALL SELECT 'b', item_id, ''' + _WORDS + r''' FROM benchmark),
grams AS MATERIALIZED (
  SELECT kind, id, g, count(*) AS n FROM (
    SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)),
      lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM texts) GROUP BY kind, id, g),
buckets AS MATERIALIZED (
  SELECT g, xor(list_reduce(list_transform(range(0, len(h), 2),
      lambda i: CAST('0x' || h[i + 1:i + 2] AS BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)),
    4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT g, hex(encode(g)) AS h FROM grams), crc),
counts AS (
  SELECT bucket, CAST(sum(CASE WHEN kind = 'd' THEN n ELSE 0 END) AS DOUBLE) AS s,
    CAST(sum(CASE WHEN kind = 'b' THEN n ELSE 0 END) AS DOUBLE) AS t
  FROM grams JOIN buckets USING (g) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000)
    / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000)))) AS BIGINT) AS gain FROM counts),
sums AS (
  SELECT id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS g
  FROM grams JOIN buckets USING (g) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS words, coalesce(n, 0) AS n_features,
    CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight,
    CAST('0x' || sha256('7:' || id)[1:8] AS BIGINT) AS h
  FROM texts LEFT JOIN sums USING (id) WHERE kind = 'd'),
final AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT)
    AS score FROM scored),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
    25 * count(*) OVER () // 100 AS drawn FROM final WHERE words >= 20)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN place <= drawn THEN place END AS rank
FROM final LEFT JOIN ranked USING (doc_id)
'''

OP13 = r'''
WITH items AS (SELECT item_id, ''' + _WORDS + r''' AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(
    range(1, len(w) - least(len(w), 10) + 2),
    lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM items WHERE len(w) > 0),
docs AS MATERIALIZED (SELECT doc_id, ''' + _WORDS + r''' AS w FROM documents),
runs AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(
    range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM docs, (SELECT DISTINCT k FROM windows)),
hits AS MATERIALIZED (SELECT doc_id, i, runs.k AS k, item_id FROM runs JOIN windows USING (k, g)),
places AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits))
  GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
'''

ORACLES = {"op7_ngram_jaccard": OP7, "op8_embedding_near_dedup": OP8, "op6_warc_revisits": OP6,
           "op9_chat_format": OP9, "op11_vector_codes": OP11,
           "op12_importance_resampling": OP12, "op13_decontamination": OP13}
