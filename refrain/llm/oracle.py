"""DuckDB statements for the queries that SQL can express over whole tables."""

OP5 = r"""
WITH hashed AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS u,
    row_number() OVER (PARTITION BY source, doc_id, text) AS i
  FROM documents),
sized AS (
  SELECT doc_id, source, size, floor(sqrt(size))::BIGINT AS w, CASE WHEN i = 1 THEN u ELSE ('0x' || substr(md5(u || '|' || i), 1, 15))::BIGINT END AS u FROM hashed),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM src),
stepped AS (
  SELECT *,
    (sum(source_size) OVER upto - source_size)::BIGINT AS before_size,
    (sum(weight) OVER () - sum(weight) OVER upto + weight)::BIGINT AS rest_weight,
    (sum(source_size) OVER ())::BIGINT AS all_size, row_number() OVER upto AS rn
  FROM weighed
  WINDOW upto AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT *, (1.5::DOUBLE * all_size - 2.0::DOUBLE * before_size) / rest_weight AS level FROM stepped),
common AS (
  SELECT arg_min(level, rn) FILTER (level * weight <= 2.0::DOUBLE * source_size) AS common FROM levels),
plan AS (
  SELECT source, source_size,
    CASE WHEN common IS NULL THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size, common * weight) END AS target
  FROM levels, common),
rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM plan),
goal AS (
  SELECT source, source_size, target, floor(rate)::BIGINT AS whole, target - floor(rate) * source_size AS rest FROM rated),
weights AS (SELECT source, w, sum(size)::BIGINT AS words FROM sized WHERE size > 0 GROUP BY ALL),
rates AS (
  SELECT g.source, x.w, (g.rest - coalesce(sum(words) OVER (heavy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(x.w * words) OVER (heavy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rate
  FROM weights x JOIN goal g ON x.source IS NOT DISTINCT FROM g.source WINDOW heavy AS (PARTITION BY x.source ORDER BY x.w DESC)),
rate_of AS (SELECT source, arg_max(rate, w) AS rate FROM rates WHERE rate * w <= 1 AND rate > 0 GROUP BY source),
chances AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.rest, r.rate, least(1.0::DOUBLE, r.rate * d.w) AS p, (d.u::DOUBLE + 0.5::DOUBLE) / 1152921504606846976::DOUBLE AS x
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN rate_of r ON d.source IS NOT DISTINCT FROM r.source),
ranked AS (SELECT *, CASE WHEN p >= 1 THEN 0 ELSE x * (1 - p) / (x * (1 - p) + p * (1 - x)) END AS rank FROM chances),
cumulated AS (SELECT *, sum(size) OVER (PARTITION BY source, size > 0 ORDER BY rank, u, doc_id, size) AS upto FROM ranked)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN rate IS NOT NULL AND (upto <= rest OR upto - rest <= rest - upto + size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM cumulated
"""

OP6 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words),
sized AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM shingled),
sets AS (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS x FROM shingled),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sets a JOIN sets b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
linked AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM sized
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN linked l ON r.other = l.a)
SELECT s.doc_id, s.n_shingles, min(r.other)::BIGINT AS component_id, s.doc_id = min(r.other) AS kept
FROM sized s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.n_shingles
"""

OP9 = r"""
WITH sized AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM sized),
firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM hashed WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM hashed LEFT JOIN firsts USING (payload_digest)
"""

OP1 = r"""
WITH RECURSIVE good AS (
  SELECT r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM (SELECT row_number() OVER () AS r, * FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS (SELECT r, vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM good),
links AS (
  SELECT a.r AS a, b.r AS b
  FROM normed a JOIN normed b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
  WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.98::DOUBLE),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a),
reach AS (
  SELECT r, r AS other FROM good
  UNION
  SELECT x.r, l.b FROM reach x JOIN links l ON x.other = l.a),
lows AS (SELECT x.r, min(g.vec_id) AS low FROM reach x JOIN good g ON x.other = g.r GROUP BY x.r)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(l.low, e.vec_id)::BIGINT AS component_id, e.vec_id = coalesce(l.low, e.vec_id) AS kept
FROM (SELECT row_number() OVER () AS r, * FROM embeddings) e LEFT JOIN lows l USING (r) LEFT JOIN counts c USING (r)
"""

OP2 = r"""
WITH RECURSIVE docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
lines AS (
  SELECT doc_id, i - 1 AS line_no, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM docs)
  WHERE regexp_matches(parts[i], '[^\x20\x09-\x0D]')),
exact AS (SELECT line, min({'d': doc_id, 'n': line_no}) AS first, row_number() OVER () AS id FROM lines GROUP BY line),
cut AS (
  SELECT id, list_distinct(CASE WHEN length(l) < 8 THEN [l] ELSE [substr(l, i, 8) FOR i IN range(1, length(l) - 6)] END) AS s
  FROM (SELECT id, lower(line) AS l FROM exact)),
sets AS (SELECT id, len(s) AS n, hash(unnest(s)) AS x FROM cut),
links AS (
  SELECT a.id AS a, b.id AS b
  FROM sets a JOIN sets b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
linked AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT id, id AS other FROM exact
  UNION
  SELECT r.id, l.b FROM reach r JOIN linked l ON r.other = l.a),
keep AS (SELECT r.id, min(e.first) AS keep FROM reach r JOIN exact e ON r.other = e.id GROUP BY r.id),
gone AS (
  SELECT l.doc_id, list(l.line_no ORDER BY l.line_no) AS gone FROM lines l JOIN exact e USING (line) JOIN keep k USING (id)
  WHERE {'d': l.doc_id, 'n': l.line_no} <> k.keep GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed, coalesce(array_to_string(gone, ','), '') AS removed,
  sha256(CASE WHEN gone IS NULL THEN coalesce(d.text, '') ELSE array_to_string([parts[i] FOR i IN range(1, len(parts) + 1) IF NOT list_contains(gone, i - 1)], chr(10)) END) AS text_sha256
FROM documents d LEFT JOIN docs USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

_TEXT = "SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum([(CASE WHEN i % 2 = 1 THEN d ELSE 2 * d - CASE WHEN 2 * d > 9 THEN 9 ELSE 0 END END)
    FOR d, i IN list_transform(string_split(reverse({_DIGITS}), ''), lambda x: x::INTEGER)]) % 10 = 0"""


def _pii_kind(n: int, name: str, pattern: str, valid: str, context: str, base: float, least: float, texts: str = "t", shape: str = "true") -> str:
    """Valid matches of a kind: r, kind, name, start, end_, score. ``texts`` is the text to search, of the same length as t; what lacks the shape is no match."""
    return f"""
SELECT r, {n} AS kind, '{name}' AS name, s AS start, e AS end_, score FROM (
  SELECT r, m, s, e, {base}::DOUBLE + CASE WHEN regexp_matches(lower(substr(t, greatest(0, s - 48) + 1, s - greatest(0, s - 48)) || chr(10) || substr(t, e + 1, least(48, coalesce(nxt, length(t)) - e))), '{context}') THEN 0.2 ELSE 0 END::DOUBLE AS score
  FROM (
    SELECT r, t, m, s, s + length(m) AS e, lead(s) OVER (PARTITION BY r ORDER BY i) AS nxt FROM (
      SELECT r, t, i, m, (sum(length(g)) OVER w + sum(length(m)) OVER w - length(m))::BIGINT AS s FROM (
        SELECT r, t, unnest(found) AS m, unnest(gaps[1:len(found)]) AS g, unnest(range(len(found))) AS i
        FROM (SELECT r, t, regexp_extract_all({texts}, '{pattern}') AS found, regexp_split_to_array({texts}, '{pattern}') AS gaps FROM docs))
      WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE {shape}))
WHERE {valid} AND score >= {least}"""


#: The patterns are those of the contract; those of iban and ssn say by word bounds and whole runs what the operator says by what stands around.
_KINDS = (
    _pii_kind(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", "mail|contact|correo|courriel", 0.8, 0),
    _pii_kind(1, "ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda x: try_cast(x AS HUGEINT) IS NULL OR try_cast(x AS HUGEINT) > 255)) = 0", r"(?:^|[^\pL\pN_])ip(?:[^\pL\pN_]|$)|address|host|server", 0.7, 0),
    _pii_kind(2, "card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN, "card|visa|credit|karte|carte|tarjeta", 0.8, 0),
    _pii_kind(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15", "phone|call|tel|mobile|fax", 0.8, 0),
    _pii_kind(
        4, "iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
        "length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(array_to_string([CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::VARCHAR ELSE c END FOR c IN string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), '')], ''), ''), lambda x: x::INTEGER), lambda a, x: (10 * a + x) % 97) = 1",
        "iban|account|konto|compte|cuenta", 0.6, 0.55, "translate(t, '_', '~')",
    ),
    _pii_kind(5, "ssn", r"[0-9-]+", "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')", r"(?:^|[^\pL\pN_])ssn(?:[^\pL\pN_]|$)|social security", 0.4, 0.55, shape="regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"),
)
OP8 = f"""
WITH docs AS ({_TEXT}),
spans AS ({" UNION ALL ".join(_KINDS)})
SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_email, count(*) FILTER (WHERE kind = 1) AS n_ip, count(*) FILTER (WHERE kind = 2) AS n_card, count(*) FILTER (WHERE kind = 3) AS n_phone,
  sha256(coalesce(string_agg(name || ':' || start || ':' || end_, ',' ORDER BY kind, start) FILTER (WHERE kind < 4), '')) AS base_sha256,
  coalesce(string_agg(name || ':' || start || ':' || end_, ',' ORDER BY kind, start) FILTER (WHERE kind IS NOT NULL), '') AS spans,
  coalesce(string_agg(printf('%.2f', score), ',' ORDER BY kind, start) FILTER (WHERE kind IS NOT NULL), '') AS scores
FROM docs LEFT JOIN spans USING (r) GROUP BY r, doc_id
"""
