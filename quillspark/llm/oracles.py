"""DuckDB statements for the training-data operators that SQL can state."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source AS host FROM documents
), w AS (
  SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), pos AS (
  SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w
), win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM pos
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM win, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY r
), line AS (
  SELECT r, unnest(string_split(t, chr(10))) AS l FROM d
), worded AS (
  SELECT r, l, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n
  FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dups AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM worded GROUP BY r
), content AS (
  SELECT host, t, min(coalesce(doc_id, 9223372036854775807)) AS first, min(r) AS r FROM d GROUP BY host, t
), limits AS (
  SELECT host, greatest(10, 0.05 * count(*)) AS most FROM content GROUP BY host
), uses AS (
  SELECT c.r, c.host, c.first, norm, sum(n) AS n
  FROM content c JOIN worded USING (r) GROUP BY c.r, c.host, c.first, norm
), often AS (
  SELECT u.host, norm, min(first) AS first
  FROM uses u JOIN limits l ON u.host IS NOT DISTINCT FROM l.host
  GROUP BY u.host, norm, most HAVING count(*) > most
), lost AS (
  SELECT u.r, sum(u.n) AS n FROM uses u
  JOIN often o ON u.norm = o.norm AND u.host IS NOT DISTINCT FROM o.host AND u.first <> o.first GROUP BY u.r
), gone AS (
  SELECT c.host, c.t FROM content c JOIN w USING (r) JOIN lost USING (r) WHERE lost.n > 0.5 * len(ws)
), facts AS (
  SELECT d.doc_id, d.host, d.t, len(ws) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN dups USING (r) LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (
         SELECT 1 FROM gone g WHERE g.t = judged.t AND g.host IS NOT DISTINCT FROM judged.host) AS kept
FROM judged
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap FROM s
), ordered AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS used, sum(w) OVER after AS share,
         (SELECT sum(source_size) FROM s) AS total
  FROM weighed
  WINDOW before AS (ORDER BY cap::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY cap::DOUBLE / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT total - used AS rest, share FROM ordered
  WHERE w * (total - used) <= cap * share ORDER BY used LIMIT 1
), aims AS (
  SELECT o.source, o.source_size,
         CASE WHEN o.w * (o.total - o.used) > o.cap * o.share THEN o.cap::DOUBLE
              ELSE l.rest::DOUBLE * o.w / l.share::DOUBLE END AS target
  FROM ordered o LEFT JOIN level l ON true
), spared AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM aims
), keyed AS (
  SELECT doc_id, d.source, size, source_size, target, whole,
         greatest(target - whole * source_size, 0) AS spare, md5(concat_ws('|', 'mix', doc_id)) AS m
  FROM d JOIN spared s ON d.source IS NOT DISTINCT FROM s.source
), placed AS (
  SELECT *, CASE WHEN size * 100 <= spare THEN '1'
                 WHEN ('0x' || m[1:8])::BIGINT * source_size::DOUBLE < spare * 4294967296.0 THEN '0'
                 ELSE '2' END || m || lpad(size::VARCHAR, 15, '0') AS k
  FROM keyed
), run AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS running FROM placed
), cuts AS (
  SELECT source, max(k) AS cut FROM run WHERE 2 * running - size <= 2 * spare GROUP BY source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN k <= cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run LEFT JOIN cuts ON run.source IS NOT DISTINCT FROM cuts.source
"""

# kind, pattern, characters that the text of the group must have, that group
SECRETS = (
    (
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
    ),
    ("access", "AKIA[A-Z0-9]+", 20, 0),
    ("hex", "[0-9a-f]+", 24, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("pem", "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 0, 0),
)


def _secrets() -> str:
    found = []
    for number, (kind, pattern, least, group) in enumerate(SECRETS):
        p = "'" + pattern.replace("'", "''") + "'"
        found.append(f"""
          SELECT r, {number} AS number, '{kind}' AS kind, {least} AS least, unnest(range(len(hits))) + 1 AS i,
                 unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(owns) AS own
          FROM (SELECT r, regexp_split_to_array(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS hits,
                       regexp_extract_all(t, {p}, {group}) AS owns
                FROM d WHERE regexp_matches(t, {p}))""")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), hits AS ({" UNION ALL ".join(found)}
), placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, number ORDER BY i) AS stop FROM hits
), kept AS (
  SELECT r, number, kind, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop
  FROM placed WHERE length(own) >= least
), joined AS (
  SELECT r, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access,
         count(*) FILTER (number = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) FILTER (number < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) AS spans
  FROM kept GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (r)
"""


WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), o AS (
  SELECT *, count(*) OVER same AS n, max(page_id) OVER same AS original FROM p WINDOW same AS (PARTITION BY payload_digest)
), r AS (
  SELECT *, n > 1 AND payload_bytes >= 1000 AND original IS NOT NULL AND page_id IS DISTINCT FROM original AS again FROM o
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN original END AS refers_to
FROM r
"""

MERKLE = r"""
WITH RECURSIVE d AS (
  SELECT *, concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
                          CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                          CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
                          CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         list_reduce(
           list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
           lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda crc, z: CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END),
           4294967295::BIGINT) AS crc
  FROM documents
), hashed AS (
  SELECT doc_id, lang, crc,
         sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(lowered) || ':' || lowered END) AS low
  FROM d
), leaves AS (
  SELECT doc_id, lang, leaf, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN low ELSE leaf END AS used,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n
  FROM hashed
), nodes(lang, level, i, h, n) AS (
  SELECT lang, 0, i, leaf, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY lang, level, i // 8, n
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), upper_nodes(level, i, h, n) AS (
  SELECT 0, i, subroot, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8
  FROM upper_nodes WHERE n > 1 GROUP BY level, i // 8, n
), every AS (
  SELECT lang, 0 AS part, level, i, h, n FROM nodes
  UNION ALL SELECT NULL, 1, level, i, h, n FROM upper_nodes
), flanks AS (
  SELECT lang, part, level, i, n,
         coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM every WINDOW run AS (PARTITION BY lang, part, level, i // 8 ORDER BY i)
), walk(doc_id, lang, leaf, part, level, i, n, proof, h) AS (
  SELECT doc_id, lang, leaf, 0, 0, i, n, '', used FROM leaves
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf,
         CASE WHEN w.n > 1 THEN w.part ELSE 1 END, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END,
         CASE WHEN w.n > 1 THEN w.i // 8 ELSE s.i END, CASE WHEN w.n > 1 THEN (w.n + 7) // 8 ELSE s.n END,
         CASE WHEN w.n > 1 THEN w.proof || f.l || f.r ELSE w.proof END,
         CASE WHEN w.n > 1 THEN sha256(f.l || w.h || f.r) ELSE w.h END
  FROM walk w
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang
  JOIN flanks f ON f.part = w.part AND f.level = w.level AND f.i = w.i
               AND (w.part = 1 OR f.lang IS NOT DISTINCT FROM w.lang)
  WHERE w.n > 1 OR w.part = 0
)
SELECT w.doc_id, w.leaf, s.subroot, root.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root,
       w.h = root.h AS verified
FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang
CROSS JOIN (SELECT h FROM upper_nodes WHERE n = 1) AS root
WHERE w.part = 1 AND w.n = 1
"""

COLLOCATIONS = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS v(k))
), f AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY lang, k, phrase
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, k AS size FROM f WHERE k > 1 AND f >= 10
), keyed AS (
  SELECT lang || chr(31) || phrase AS key, f FROM f WHERE f >= 10
), cut AS (
  SELECT p.*, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score
  FROM (SELECT c.*, v.k, lang || chr(31) || array_to_string(w[1:v.k], ' ') AS part,
               lang || chr(31) || array_to_string(w[v.k + 1:size], ' ') AS rest
        FROM c JOIN (VALUES (1), (2)) AS v(k) ON v.k < size) AS p
  JOIN keyed x ON x.key = part JOIN keyed y ON y.key = rest
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covers AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE size = 3)
  GROUP BY lang, phrase
), kept AS (
  SELECT b.* FROM best b LEFT JOIN covers v ON v.lang = b.lang AND v.phrase = b.phrase AND b.size = 2
  WHERE v.most IS NULL OR 100 * v.most < 50 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

ORACLES = {
    "op7_secret_scan": _secrets(),
    "op8_quality": QUALITY,
    "op9_warc": WARC,
    "op10_mixing": MIXING,
    "op12_merkle": MERKLE,
    "op13_collocations": COLLOCATIONS,
}
