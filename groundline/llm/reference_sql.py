"""DuckDB statements with the results of those numbered queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

LINE_DEDUP = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM lines),
shared AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(shared.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE shared.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN shared ON keyed.key = shared.key GROUP BY r, doc_id
"""

# The table of CRC-32 comes from its polynomial; each distinct word is hashed byte by byte.
RESAMPLING = rf"""
WITH RECURSIVE shifted(b, n, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, n + 1, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) FROM shifted WHERE n < 8),
crcs AS (SELECT list(v ORDER BY b) AS crc FROM shifted WHERE n = 8),
texts AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS text FROM documents),
docs AS (SELECT r, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
goals AS (SELECT regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
used AS (SELECT r, unnest(words) AS word FROM docs),
wanted AS (SELECT unnest(words) AS word FROM goals),
spelt AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM used UNION SELECT word FROM wanted)),
bytes AS (SELECT word, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM spelt),
buckets AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b),
  lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) % 10000 AS bucket FROM bytes, crcs),
s AS (SELECT bucket, count(*) AS n FROM used JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN buckets USING (word) GROUP BY bucket),
sizes AS (SELECT (SELECT count(*) FROM used) + 10000 AS whole_s, (SELECT count(*) FROM wanted) + 10000 AS whole_t),
gains AS (SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * whole_s)::DOUBLE / ((s.n + 1) * whole_t)::DOUBLE))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), sizes),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM used JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
  + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE n_features >= 20),
drawn AS (SELECT 10 * count(*) // 100 AS n FROM placed)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= drawn.n THEN place END AS rank
FROM scored LEFT JOIN placed USING (r), drawn
"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assignment and floored means as a chain of steps over all pairs of part and entry."""
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
  list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"cut AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) AS t(p))",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM cut WHERE r <= {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(f"""near{n} AS MATERIALIZED (SELECT r, cut.p, any_value(x) AS x, min({{'d': list_sum(list_transform(list_zip(x, c),
  lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS best FROM cut JOIN book{n} AS b ON cut.p = b.p GROUP BY r, cut.p)""")
        if n < rounds:
            steps.append(f"""sums{n} AS (SELECT p, e, i, sum(y) AS total, count(*) AS n FROM (
  SELECT p, best.e AS e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{n}) GROUP BY p, e, i)""")
            steps.append(f"mean{n} AS (SELECT p, e, list(floor(total::DOUBLE / n)::BIGINT ORDER BY i) AS c FROM sums{n} GROUP BY p, e)")
            steps.append(f"book{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{n} AS b LEFT JOIN mean{n} AS m ON b.p = m.p AND b.e = m.e)")
    last = rounds
    steps.append(f"""coded AS (SELECT r, string_agg(lpad(lower(hex(best.e)), 2, '0'), '' ORDER BY p) AS code,
  sum(best.d)::BIGINT AS error FROM near{last} GROUP BY r)""")
    steps.append(f"spelt AS (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM book{last})")
    steps.append("books AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM spelt)")
    return (
        "WITH "
        + ",\n".join(steps)
        + """
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books"""
    )


VECTOR_CODES = vector_codes()
