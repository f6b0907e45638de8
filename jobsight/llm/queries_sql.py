"""DuckDB SQL of the queries that SQL can express, written apart from the Spark code."""

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first FROM d GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(d.hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '')
    AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM d JOIN f USING (hex)
"""


def op9(limit: int) -> str:
    """A row's bucket is the shallowest hash prefix whose bytes fit; the tables hold no
    bucket that is too large at the last bit."""
    return f"""
WITH r AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS bits
  FROM documents),
x AS (SELECT doc_id, n_bytes, d AS depth, bits >> CAST(60 - d AS INTEGER) AS bucket
      FROM r, (SELECT unnest(range(0, 31)) AS d) AS depths),
b AS (SELECT depth, bucket, sum(n_bytes) AS shard_bytes FROM x GROUP BY depth, bucket),
leaf AS (SELECT doc_id, min(depth) AS depth FROM x JOIN b USING (depth, bucket)
         WHERE shard_bytes <= {limit} GROUP BY doc_id)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(depth AS INTEGER) AS depth, bucket, CAST(0 AS BIGINT) AS part,
  depth || '-' || bucket || '-0' AS shard_id, CAST(shard_bytes AS BIGINT) AS shard_bytes
FROM leaf JOIN x USING (doc_id, depth) JOIN b USING (depth, bucket)
"""


_WORDS10 = f"regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS10} AS w FROM documents),
i AS (SELECT item_id, {_WORDS10} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s + 1, s + least(len(w), 10)), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s + 1, s + n), ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, s, n, item_id FROM dw JOIN iw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM m)) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_WORDS7 = f"regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\\x20\\x09-\\x0D]+')"

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS7} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + least(len(w), 3)), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS na ON a = na.doc_id JOIN n AS nb ON b = nb.doc_id
      WHERE 100 * n_both >= 90 * (na.n + nb.n - n_both)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) AS c USING (doc_id)
"""

OP12 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
g AS (SELECT lang, k, array_to_string(list_slice(w, s + 1, s + k), ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(0, len(w) - k + 1)) AS s
            FROM p, (SELECT unnest([1, 2, 3]) AS k) AS sizes WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
parts AS (SELECT lang, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS lp, array_to_string(list_slice(w, j + 1, k), ' ') AS rp
          FROM c, (SELECT unnest([1, 2]) AS j) AS places WHERE j < k),
scored AS (SELECT x.lang, x.phrase, x.a, x.j, fl.f AS l, fr.f AS r,
             CAST((CAST(1000000 AS HUGEINT) * x.a * x.a) // (CAST(fl.f AS HUGEINT) * fr.f) AS BIGINT) AS score
           FROM parts x JOIN f fl ON fl.lang = x.lang AND fl.phrase = x.lp JOIN f fr ON fr.lang = x.lang AND fr.phrase = x.rp),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(list_slice(w, s, s + 1), ' ') AS phrase, max(a) AS longest
           FROM c, (SELECT unnest([1, 2]) AS s) AS ends WHERE k = 3 GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE NOT coalesce(100 * longest >= 50 * a, false))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang)
WHERE rank <= 2000
"""
