"""Expected results as DuckDB SQL, for the queries that SQL can express."""

from __future__ import annotations

# Words: runs of anything but space and 0x09 to 0x0D.
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

_BIT = "CAST(substr(bits, 5 * i + {0}, 1) AS INTEGER)"
_FIVE = " + ".join(f"{16 >> place} * {_BIT.format(place + 1)}" for place in range(5))

WARC_INDEX = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), digests AS (
  SELECT page_id, html, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS responder FROM payloads
), spelled AS (
  SELECT *, array_to_string(list_transform(range(40), lambda k:
    substr('0000000100100011010001010110011110001001101010111100110111101111',
           4 * CAST(instr('0123456789abcdef', substr(hex, CAST(k AS INTEGER) + 1, 1)) AS INTEGER) - 3, 4)), '') AS bits
  FROM digests
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}), 1)), '') AS payload_digest,
  CASE WHEN page_id = responder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> responder THEN responder END AS refers_to
FROM spelled""".replace("), 1)), '') AS payload_digest", ", 1)), '') AS payload_digest")

SUBSTRING_DEDUP = f"""
WITH words AS (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(ws, i, i + 12) AS seq
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM words WHERE len(ws) >= 13)
), firsts AS (
  SELECT seq, min(doc_id) AS first_doc FROM windows GROUP BY seq
), gone AS (
  SELECT DISTINCT doc_id, pos FROM (
    SELECT doc_id, unnest(range(i, i + 13)) AS pos FROM windows JOIN firsts USING (seq) WHERE first_doc < doc_id)
), placed AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM words
), marked AS (
  SELECT placed.doc_id, placed.pos, word, gone.pos IS NOT NULL AS removed
  FROM placed LEFT JOIN gone ON placed.doc_id = gone.doc_id AND placed.pos = gone.pos
), summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed,
    string_agg(word, ' ' ORDER BY pos) FILTER (NOT removed) AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN summed USING (doc_id)"""

MINHASH = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM words WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.other = links.a
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""
