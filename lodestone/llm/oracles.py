"""DuckDB SQL for the queries that SQL can express on whole tables.

Written from the contracts alone: patterns and constants are spelled out here.
"""

MIX = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1])::DOUBLE AS weight
  FROM sizes GROUP BY source),
filling AS (
  SELECT *, 3.0::DOUBLE * source_size AS bound, 3.0::DOUBLE * source_size / weight AS full_at FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(bound) OVER earlier, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM filling
  WINDOW earlier AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
         least(bound, weight * coalesce((SELECT max(level) FROM levels WHERE level <= full_at), 'inf'::DOUBLE)) AS target
  FROM levels),
rates AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size::DOUBLE, 3.0::DOUBLE) ELSE 0 END AS expected,
         (('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
parts AS (
  SELECT *, floor(expected) AS whole, CASE WHEN size > 0 THEN expected - floor(expected) ELSE 0 END AS p FROM rates),
ranks AS (
  SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS rank,
         target - sum(size * whole) OVER (PARTITION BY source) AS budget FROM parts),
open AS MATERIALIZED (
  SELECT *, row_number() OVER () AS nr,
         budget - sum(CASE WHEN size > budget / 32 THEN 0 ELSE size END) OVER (PARTITION BY source) AS need
  FROM ranks WHERE p > 0),
longest AS (
  SELECT *, size > budget / 32 AND size <= budget AS turn FROM open),
placed AS (
  SELECT *, sum(CASE WHEN turn THEN size ELSE 0 END)
            OVER (PARTITION BY source ORDER BY rank, doc_id, size, nr ROWS UNBOUNDED PRECEDING) AS up_to
  FROM longest),
passes AS (
  SELECT 0 AS n, nr, doc_id, source, size, target, rank, budget,
         turn AND up_to <= budget AND (u <= p OR up_to - size < need) AS taken
  FROM placed
  UNION ALL
  SELECT n + 1, nr, doc_id, source, size, target, rank, budget, taken OR (turn AND up_to <= gap)
  FROM (
    SELECT *, bool_or(turn) OVER () AS more,
           sum(CASE WHEN turn THEN size ELSE 0 END)
           OVER (PARTITION BY source ORDER BY rank, doc_id, size, nr ROWS UNBOUNDED PRECEDING) AS up_to
    FROM (
      SELECT *, NOT taken AND size <= gap AND (n = 0 OR gap > 0.001 * target) AS turn
      FROM (SELECT *, budget - sum(CASE WHEN taken THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM passes)))
  WHERE more),
finished AS (
  SELECT *, budget - sum(CASE WHEN taken THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap
  FROM passes WHERE n = (SELECT max(n) FROM passes)),
lasts AS (
  SELECT nr, row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), rank, doc_id, nr) = 1 AS last
  FROM finished WHERE NOT taken AND abs(size - gap) < gap)
SELECT o.doc_id, o.size, o.source_size, o.target,
       (o.size * (o.whole + CASE WHEN f.taken OR coalesce(l.last, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM open o JOIN finished f ON f.nr = o.nr LEFT JOIN lasts l ON l.nr = o.nr
UNION ALL
SELECT doc_id, size, source_size, target, (size * whole)::BIGINT FROM ranks WHERE NOT p > 0
"""

COVER = """
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reached AS (
  SELECT x AS id, x AS other FROM links
  UNION SELECT r.id, l.y FROM reached r JOIN links l ON r.other = l.x),
smallest AS (SELECT id, min(other) AS least FROM reached GROUP BY id),
degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(s.least, v.vec_id) AS component_id,
       coalesce(s.least, v.vec_id) = v.vec_id AS kept
FROM embeddings v LEFT JOIN degrees d ON d.x = v.vec_id LEFT JOIN smallest s ON s.id = v.vec_id
"""

JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * k >= 90 * (p.n + q.n - k)),
reached AS (
  SELECT x AS id, x AS other FROM links
  UNION SELECT r.id, l.y FROM reached r JOIN links l ON r.other = l.x)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, coalesce(min(r.other), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reached r ON r.id = d.doc_id
GROUP BY d.doc_id
"""

WINDOWS = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS MATERIALIZED (
  SELECT doc_id, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(w[i:i + 34], ' ')) END AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
marked AS (
  SELECT doc_id, i, word, g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 AS again FROM places),
covered AS (
  SELECT doc_id, i, word, max(again::INT) OVER
         (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM marked),
kept AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS k, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS rest
  FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

SUFFIXES = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS MATERIALIZED (
  SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * i + 200 <= length(h) THEN md5(substr(h, 2 * i + 1, 200)) END AS g
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM bytes)),
marked AS (
  SELECT doc_id, i, b, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM places),
covered AS (
  SELECT doc_id, i, b, max(again::INT) OVER
         (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) = 1 AS gone FROM marked),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM covered),
kept AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS k, count(*) FILTER (begins) AS s,
         string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS rest
  FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(k, 0)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

FILL_MIDDLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || doc_id) AS d
  FROM documents),
draws AS (
  SELECT doc_id, t, u, len(u) AS n, [('0x' || substr(d, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM units),
cuts AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90
              THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM draws),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s
  FROM cuts)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

QUARTILES = r"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS t,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first(coalesce(text, '')) OVER (ORDER BY doc_id)) AS f
  FROM documents),
texts AS (
  SELECT doc_id, 0 AS k, t FROM ordered
  UNION ALL
  SELECT doc_id, 1, t[1:length(t) - length(t) // 2] || f[1:length(t) // 2] FROM ordered),
bytes AS (SELECT doc_id, k, hex(encode(t)) AS h FROM texts),
numbers AS (
  SELECT doc_id, k, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS u FROM bytes),
triplets AS (
  SELECT doc_id, k, z[1] + 256 * z[2] + 65536 * z[3] AS v
  FROM (SELECT doc_id, k, unnest(list_zip(u, u[2:], u[3:])) AS z FROM numbers) WHERE z[3] IS NOT NULL),
filled AS (
  SELECT doc_id, k, ((v * 2654435761) % 4294967296) // 8388608 AS b, count(*) AS n FROM triplets GROUP BY ALL),
counts AS (
  SELECT doc_id, k, b, coalesce(n, 0) AS n
  FROM (SELECT doc_id, k, unnest(range(512)) AS b FROM bytes) LEFT JOIN filled USING (doc_id, k, b)),
ranked AS (SELECT doc_id, k, list(n ORDER BY b) AS c, list(n ORDER BY n) AS o FROM counts GROUP BY ALL),
coded AS MATERIALIZED (
  SELECT r.doc_id, r.k, length(h) // 2 AS size,
         list_transform(c, lambda x: (x > o[128])::INT + (x > o[256])::INT + (x > o[384])::INT) AS c
  FROM ranked r JOIN bytes USING (doc_id, k)),
digests AS MATERIALIZED (
  SELECT doc_id, k, c, CASE WHEN size = 0 THEN 0 ELSE 8 * length(bin(size)) + (size * 8 >> (length(bin(size)) - 1)) % 8 END AS l
  FROM coded),
shown AS (
  SELECT doc_id, k, printf('%04x', l) || array_to_string(list_transform(range(256),
         lambda i: '0123456789abcdef'[4 * c[2 * i + 1] + c[2 * i + 2] + 1]), '') AS p FROM digests),
sides AS (
  SELECT o.doc_id, length(o.t) AS n_chars, a.c AS ac, a.l AS al, b.c AS bc, b.l AS bl,
         coalesce(lead(a.c) OVER w, first(a.c) OVER w) AS nc, coalesce(lead(a.l) OVER w, first(a.l) OVER w) AS nl
  FROM ordered o JOIN digests a ON a.doc_id = o.doc_id AND a.k = 0 JOIN digests b ON b.doc_id = o.doc_id AND b.k = 1
  WINDOW w AS (ORDER BY o.doc_id))
SELECT s.doc_id, n_chars, sha256(x.t) AS edited_sha256, p.p AS fingerprint, q.p AS edited_fingerprint,
       1 - least(768, list_sum(list_transform(list_zip(ac, bc), lambda z: abs(z[1] - z[2]))) + 30 * abs(al - bl))::DOUBLE / 768 AS near_edited,
       1 - least(768, list_sum(list_transform(list_zip(ac, nc), lambda z: abs(z[1] - z[2]))) + 30 * abs(al - nl))::DOUBLE / 768 AS near_next
FROM sides s JOIN texts x ON x.doc_id = s.doc_id AND x.k = 1
JOIN shown p ON p.doc_id = s.doc_id AND p.k = 0 JOIN shown q ON q.doc_id = s.doc_id AND q.k = 1
"""

NEGATIVES = """
WITH vectors AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s
  ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
