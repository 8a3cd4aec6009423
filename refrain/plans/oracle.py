"""DuckDB statements equal to the registered queries, in textbook SQL without their shortcuts."""

from __future__ import annotations

from refrain.functions import lsh

SIX = "round(({})::DOUBLE, 6)"
NORM = "list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE))"
VEC = f"""
norms AS (SELECT vec_id, embedding, {NORM.format('embedding')} AS n2 FROM embeddings),
units AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: (x * (1.0::DOUBLE / sqrt(n2))::FLOAT)::FLOAT) AS unit FROM norms),
quant AS (SELECT *, list_transform(unit, lambda x: round((x * 127::FLOAT)::FLOAT)::TINYINT) AS q FROM units),
vecs AS (SELECT *, sqrt({NORM.format('q')})::FLOAT AS qn FROM quant)"""
SCORE = "(list_sum(list_transform(list_zip({0}.unit, {1}.q), lambda p: (p[1] * p[2])::FLOAT::DOUBLE)) / {1}.qn::DOUBLE)::FLOAT"
REC = f"""{VEC},
grid AS (SELECT vec_id // 60 AS rec, vec_id % 60 AS t FROM embeddings),
rec AS (
  SELECT g.rec, g.t, 'rec-' || g.rec AS source_id, g.t::DOUBLE AS start_s, v.unit, v.q, v.qn
  FROM grid g JOIN vecs v ON v.vec_id = CASE WHEN t BETWEEN 10 AND 24 OR (t BETWEEN 30 AND 37 AND rec % 2 = 0) THEN (rec - rec % 8) * 60 + t
    WHEN t BETWEEN 50 AND 56 THEN rec * 60 + t - 10 ELSE rec * 60 + t END)"""


def ranked(where: str, k: int) -> str:
    return f"""
scored AS (SELECT a.source_id, a.rec, a.start_s, b.source_id AS ref_source_id, b.start_s AS ref_start_s, b.rec AS seq, {SCORE.format('a', 'b')} AS similarity FROM rec a, rec b WHERE {where}),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY source_id, start_s ORDER BY similarity DESC, seq, ref_source_id, ref_start_s) AS rank FROM scored WHERE similarity >= 0.985::FLOAT
  QUALIFY rank <= {k})"""


def aligned(anchors: str, similarity: str = SIX.format("avg(similarity::DOUBLE)::FLOAT")) -> str:
    """From anchors(source_id, ref_source_id, start_s, ref_start_s, similarity) to spans."""
    return f"""
binned AS (SELECT *, round(ref_start_s - start_s)::BIGINT AS offset_bin FROM ({anchors})),
best AS (
  SELECT * FROM binned
  QUALIFY row_number() OVER (PARTITION BY source_id, ref_source_id, offset_bin, start_s ORDER BY similarity DESC, ref_start_s) = 1),
stepped AS (
  SELECT *, start_s - lag(start_s) OVER g AS dq, ref_start_s - lag(ref_start_s) OVER g AS dr FROM best
  WINDOW g AS (PARTITION BY source_id, ref_source_id, offset_bin ORDER BY start_s, ref_start_s, similarity)),
runs AS (
  SELECT *, sum(CASE WHEN dq > 0 AND dr > 0 AND dq <= 2.5 AND dr <= 2.5 AND abs(dq - dr) <= 1.5 THEN 0 ELSE 1 END) OVER (
    PARTITION BY source_id, ref_source_id, offset_bin ORDER BY start_s, ref_start_s, similarity ROWS UNBOUNDED PRECEDING) AS run
  FROM stepped)
SELECT source_id, ref_source_id AS reference_id, 'video_perceptual' AS kind, offset_bin, min(start_s) AS q_start, max(start_s) + 1 AS q_end, min(ref_start_s) AS r_start,
  max(ref_start_s) + 1 AS r_end, count(*) AS anchor_count, (min(start_s) * 1000)::BIGINT AS q_start_byte, (max(start_s) * 1000 + 999)::BIGINT AS q_end_byte,
  (min(ref_start_s) * 1000)::BIGINT AS r_start_byte, (max(ref_start_s) * 1000 + 999)::BIGINT AS r_end_byte, {similarity} AS similarity
FROM runs GROUP BY source_id, ref_source_id, offset_bin, run
HAVING count(*) >= 3 AND least(max(start_s) + 1 - min(start_s), max(ref_start_s) + 1 - min(ref_start_s)) >= 5"""


CROSS = "SELECT source_id, ref_source_id, start_s, ref_start_s, similarity FROM hits WHERE source_id <> ref_source_id"
SELF = f"""
own AS (
  SELECT a.source_id, b.source_id AS ref_source_id, a.start_s, b.start_s AS ref_start_s, {SCORE.format('a', 'b')} AS similarity FROM rec a JOIN rec b ON a.source_id = b.source_id),
own_hits AS (
  SELECT * FROM own WHERE similarity >= {{0}}::FLOAT
  QUALIFY row_number() OVER (PARTITION BY source_id, start_s ORDER BY similarity DESC, ref_start_s) <= 64)"""
FORWARD = "SELECT source_id, ref_source_id, start_s, ref_start_s, similarity FROM own_hits WHERE ref_start_s - start_s + 1e-6 >= 5"

_PLANES = ", ".join(f"({r // lsh.BITS}, {r % lsh.BITS}, {list(map(int, row))})" for r, row in enumerate(lsh.planes(64)))
HASHES = f"""{VEC},
planes(tab, bit, w) AS (VALUES {_PLANES}),
hash_of AS (
  SELECT vec_id, tab, sum(CASE WHEN list_sum(list_transform(list_zip({{0}}, w), lambda p: p[1]::DOUBLE * p[2])) >= 0 THEN (1 << bit) ELSE 0 END)::BIGINT AS hash
  FROM vecs, planes GROUP BY vec_id, tab)"""
PROBES = f"""{HASHES.format('unit')},
stored_of AS (
  SELECT vec_id, tab, sum(CASE WHEN list_sum(list_transform(list_zip(q, w), lambda p: p[1]::DOUBLE * p[2])) >= 0 THEN (1 << bit) ELSE 0 END)::BIGINT AS hash
  FROM vecs, planes GROUP BY vec_id, tab),
away AS (SELECT a.vec_id, b.vec_id AS ref, min(bit_count(xor(a.hash, b.hash))) AS bits FROM hash_of a JOIN stored_of b USING (tab) GROUP BY ALL)"""

INT = """
iv AS (
  SELECT {0} AS k, event_id, event_type, epoch_us(ts) / 1e6::DOUBLE - 1704067200.0::DOUBLE AS start_s, value,
    epoch_us(ts) / 1e6::DOUBLE - 1704067200.0::DOUBLE + value * 60 AS end_s FROM events)"""


def blocks(rows: str, by: str, gap: str, order: str = "start_s, end_s", start: str = "start_s", end: str = "end_s") -> str:
    return f"""(
  SELECT *, sum(opens) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS block FROM (
    SELECT *, CASE WHEN {start} <= max({end}) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS opens
    FROM {rows} WHERE {end} > {start}))"""


MATCHES = """
m AS (
  SELECT event_id AS match_id, 'rec-' || (user_id % 20) AS source_id, event_type AS reference_id, CASE WHEN event_id % 29 = 0 THEN 'advertisement' ELSE 'unknown' END AS reference_type,
    CASE WHEN event_id % 2 = 0 THEN 'audio_spectrum' ELSE 'video_perceptual' END AS kind, (0.955::DOUBLE + (event_id % 5) * 0.01::DOUBLE)::FLOAT AS similarity,
    (event_id * 7 % 600)::DOUBLE AS q_start, (event_id * 7 % 600)::DOUBLE + (5 + event_id % 17) AS q_end, (event_id * 7 % 300)::DOUBLE AS r_start, (event_id * 7 % 300)::DOUBLE + (5 + event_id % 17) AS r_end
  FROM events),
pairs AS (
  SELECT a.match_id AS am, v.match_id AS vm FROM m a JOIN m v USING (source_id, reference_id)
  WHERE a.kind = 'audio_spectrum' AND v.kind = 'video_perceptual' AND a.similarity::DOUBLE >= 0.985::DOUBLE - 0.02::DOUBLE AND v.similarity::DOUBLE >= 0.985::DOUBLE - 0.02::DOUBLE
    AND abs(a.q_start - v.q_start) <= 3 AND abs(a.r_start - v.r_start) <= 3
    AND least(a.q_end, v.q_end) - greatest(a.q_start, v.q_start) >= 0.7::DOUBLE * least(a.q_end - a.q_start, v.q_end - v.q_start)
    AND least(a.r_end, v.r_end) - greatest(a.r_start, v.r_start) >= 0.7::DOUBLE * least(a.r_end - a.r_start, v.r_end - v.r_start)),
sure AS (SELECT am AS match_id FROM pairs UNION SELECT vm FROM pairs)"""

ADS = f"""WITH {INT.format('user_id')},
rows AS (SELECT k AS source_id, event_id, start_s, end_s, event_id % 7 AS family, 0.8::DOUBLE + (event_id % 3) * 0.05::DOUBLE AS confidence, event_id % 4 = 0 AS confirmed, event_id % 11 = 0 AS known_ad FROM iv),
b AS {blocks('rows', 'source_id', '3000', 'start_s, end_s, family, event_id')},
ev AS (
  SELECT source_id, block, min(start_s) AS start_s, max(end_s) AS end_s, max(confidence) AS confidence, bool_or(confirmed) AS confirmed, bool_or(known_ad) AS known_ad, count(DISTINCT family) AS families
  FROM b GROUP BY ALL HAVING (bool_or(known_ad) OR count(DISTINCT family) >= 2) AND max(end_s) - min(start_s) <= 40000)"""

MARKERS = f"""WITH {INT.format('user_id')},
mk AS (SELECT k AS source_id, start_s AS m_start, end_s AS m_end, event_id AS family, 'f' || event_id AS family_id, event_id % 2 = 0 AS out FROM iv WHERE event_type IN ('click', 'view', 'purchase'))"""

FAMILIES = f"""WITH RECURSIVE spans AS (
  WITH {REC}, {ranked('true', 12)}, {SELF.format('0.985')}, {aligned(f'{CROSS} UNION ALL {FORWARD}', 'avg(similarity::DOUBLE)::FLOAT')}),
found AS (SELECT *, row_number() OVER () AS id, 'recording' AS reference_type, 'audio_spectrum' AS sort FROM spans),
chosen AS (SELECT * FROM found WHERE similarity::DOUBLE >= 0.985::DOUBLE AND least(q_end - q_start, r_end - r_start) > 0),
media AS (SELECT DISTINCT source_id, 700.0::DOUBLE AS duration FROM found),
node AS (
  SELECT 2 * id AS node, source_id, source_id AS src, q_start AS s, q_end AS e, q_start_byte AS first, q_end_byte AS last, 'p' AS path, 'recording' AS type FROM chosen
  UNION ALL SELECT 2 * id + 1, source_id, reference_id, r_start, r_end, r_start_byte, r_end_byte, '', reference_type FROM chosen),
edge AS (
  SELECT 2 * id AS a, 2 * id + 1 AS b FROM chosen
  UNION SELECT a.node, b.node FROM node a JOIN node b ON a.source_id = b.source_id AND a.src = b.src AND a.node <> b.node AND abs(a.s - b.s) <= 3
  WHERE least(a.e, b.e) - greatest(a.s, b.s) >= 0.7::DOUBLE * least(a.e - a.s, b.e - b.s)),
ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT node AS a, node AS b FROM node UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
part AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
lined AS (
  SELECT n.*, component, row_number() OVER (PARTITION BY source_id, component, src ORDER BY s, e, first, last, path, type) AS rn FROM node n JOIN part USING (node)),
fold AS (
  SELECT source_id, component, src, rn, s, e, type, 1 AS place FROM lined WHERE rn = 1
  UNION ALL
  SELECT source_id, component, src, rn, CASE WHEN joins THEN least(ms, s) ELSE s END, CASE WHEN joins THEN greatest(me, e) ELSE e END,
    CASE WHEN joins AND mtype <> 'unknown' THEN mtype ELSE type END, CASE WHEN joins THEN place ELSE place + 1 END
  FROM (
    SELECT l.*, f.s AS ms, f.e AS me, f.type AS mtype, f.place, least(f.e - f.s, l.e - l.s) > 0
      AND greatest(0, least(f.e, l.e) - greatest(f.s, l.s)) >= 0.7::DOUBLE * least(f.e - f.s, l.e - l.s) AND (abs(f.s - l.s) <= 3 OR abs(f.e - l.e) <= 3) AS joins
    FROM fold f JOIN lined l ON l.source_id = f.source_id AND l.component = f.component AND l.src = f.src AND l.rn = f.rn + 1)),
occurrence AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY source_id, component, src, place ORDER BY rn DESC) = 1),
facts AS (
  SELECT c.source_id, component, bool_or(sort = 'audio_spectrum') AS has_audio, avg(similarity::DOUBLE) AS score FROM chosen c JOIN part ON node = 2 * id GROUP BY ALL),
sized AS (
  SELECT source_id, component, count(*) AS n, median(e - s) AS typical, bool_or(type = 'advertisement') AS ad, bool_or(type = 'programme') AS prog, bool_or(type = 'break_out') AS m_out,
    bool_or(type = 'break_in') AS m_in, arg_min((src, s), (src, place)) AS head, coalesce(min(s) FILTER (WHERE src = source_id), 701) AS first_own, count(*) FILTER (WHERE src = source_id) AS own
  FROM occurrence GROUP BY ALL HAVING count(*) >= 2),
named AS (
  SELECT *, CASE WHEN ad THEN 'advertisement' WHEN prog THEN 'programme' WHEN m_out AND NOT m_in THEN 'break_out' WHEN m_in AND NOT m_out THEN 'break_in' END AS known,
    CASE WHEN typical > 180 THEN 'programme_repeat' WHEN NOT has_audio THEN 'visual_reuse' ELSE 'short_repeat' END AS form,
    CASE WHEN ad THEN 0.94 WHEN prog THEN 0.90 WHEN m_out OR m_in THEN 0.92 WHEN has_audio THEN 0.76 ELSE 0.48 END::DOUBLE
      + 0.15::DOUBLE * greatest(0, score - 0.90::DOUBLE) / 0.10::DOUBLE + least(0.07::DOUBLE, (n - 2) * 0.02::DOUBLE) AS sure
  FROM sized JOIN facts USING (source_id, component)),
judged AS (
  SELECT *, coalesce(known, 'unknown') AS known_type, CASE WHEN prog AND NOT ad THEN 'programme_repeat' ELSE coalesce(known, form) END AS classification, greatest(0, least(0.99::DOUBLE, sure)) AS confidence FROM named),
family AS (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY first_own, classification, typical, head[1], head[2]) AS family FROM judged)"""


def evidence(rows: str) -> str:
    return f"""(
  SELECT source_id, block, min(start_s) AS start_s, max(end_s) AS end_s, max(confidence) AS confidence, bool_or(known_ad) AS known_ad, count(DISTINCT family) AS families FROM {rows}
  GROUP BY source_id, block HAVING (bool_or(known_ad) OR count(DISTINCT family) >= 2) AND max(end_s) - min(start_s) <= 360)"""


TIMELINE = f"""{FAMILIES},
seen AS (SELECT o.source_id, family, s AS start_s, e AS end_s FROM occurrence o JOIN family USING (source_id, component) WHERE src = o.source_id),
ads AS (
  SELECT source_id, family, confidence, known_type = 'advertisement' AS known_ad, greatest(0, least(start_s, duration)) AS start_s, greatest(0, least(end_s, duration)) AS end_s
  FROM family JOIN seen USING (source_id, family) JOIN media USING (source_id)
  WHERE (known_type = 'advertisement' OR (classification = 'short_repeat' AND n >= 2 AND typical <= 180)) AND confidence >= 0.75::DOUBLE),
dealt AS {blocks('ads', 'source_id', '20', 'start_s, end_s, family')},
extent AS (SELECT source_id, block, family, min(start_s) AS s, max(end_s) AS e FROM dealt WHERE (source_id, block) IN (SELECT (source_id, block) FROM {evidence('dealt')} WHERE families >= 3) GROUP BY ALL),
edges AS (
  SELECT source_id, family, row_number() OVER w AS n, abs(lead(s) OVER w - s) AS lead, lead(family) OVER w AS nxt, true AS leads FROM extent WINDOW w AS (PARTITION BY source_id, block ORDER BY s, e, family)
  UNION ALL
  SELECT source_id, family, row_number() OVER w, abs(lead(e) OVER w - e), lead(family) OVER w, false FROM extent WINDOW w AS (PARTITION BY source_id, block ORDER BY e DESC, s DESC, family DESC)),
sides AS (SELECT source_id, family, leads FROM edges WHERE n = 1 AND lead > 1e-6 GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT nxt) >= 2),
one_side AS (SELECT source_id, family, bool_or(leads) AS leads FROM sides GROUP BY ALL HAVING count(*) = 1),
labelled AS (
  SELECT f.* EXCLUDE (classification),
    CASE WHEN leads IS NOT NULL AND classification = 'short_repeat' AND typical <= 30 AND own >= 3 THEN CASE WHEN leads THEN 'break_out' ELSE 'break_in' END ELSE classification END AS classification
  FROM family f LEFT JOIN one_side USING (source_id, family)),
marker AS (
  SELECT source_id, family, start_s AS m_start, end_s AS m_end, classification = 'break_out' AS out, known_type = classification AS catalogue, confidence
  FROM labelled JOIN seen USING (source_id, family) WHERE classification IN ('break_out', 'break_in')),
others AS (SELECT * FROM ads WHERE (source_id, family) NOT IN (SELECT (source_id, family) FROM marker)),
parts AS (SELECT * FROM {evidence(blocks('others', 'source_id', '20', 'start_s, end_s, family'))}),
bef AS (
  SELECT p.source_id, block, m_end FROM parts p JOIN marker USING (source_id) WHERE out AND m_start <= start_s AND m_end <= start_s + 3 AND start_s - m_end <= 20
  QUALIFY row_number() OVER (PARTITION BY p.source_id, block ORDER BY m_end DESC, m_start, family) = 1),
aft AS (
  SELECT p.source_id, block, m_start FROM parts p JOIN marker USING (source_id) WHERE NOT out AND m_end >= end_s AND m_start >= end_s - 3 AND m_start - end_s <= 20
  QUALIFY row_number() OVER (PARTITION BY p.source_id, block ORDER BY m_start, m_end, family) = 1),
nxt AS (
  SELECT a.source_id, a.m_end AS start_s, b.m_start AS end_s, least(a.confidence, b.confidence) + 0.06::DOUBLE AS confidence, b.out FROM marker a JOIN marker b ON a.source_id = b.source_id AND b.m_start >= a.m_end
    AND (b.m_start, b.m_end, b.family) > (a.m_start, a.m_end, a.family)
  WHERE a.out AND a.catalogue AND b.catalogue QUALIFY row_number() OVER (PARTITION BY a.source_id, a.family, a.m_start, a.m_end ORDER BY b.m_start, b.m_end, b.family) = 1),
proposal AS (
  SELECT source_id, coalesce(m_end, start_s) AS start_s, coalesce(m_start, end_s) AS end_s, confidence + 0.04::DOUBLE + CASE WHEN known_ad THEN 0.05 ELSE 0 END::DOUBLE AS confidence, known_ad AS exempt
  FROM parts LEFT JOIN bef USING (source_id, block) LEFT JOIN aft USING (source_id, block)
  UNION ALL SELECT source_id, start_s, end_s, confidence, true FROM nxt WHERE NOT out AND end_s - start_s <= 360),
breaks AS (
  SELECT source_id, min(start_s) AS start_s, max(end_s) AS end_s, max(confidence) AS confidence FROM {blocks('proposal', 'source_id', '3')}
  GROUP BY source_id, block HAVING bool_or(exempt) OR max(end_s) - min(start_s) >= 10),
gaps AS (
  SELECT source_id, greatest(0, coalesce(max(end_s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS start_s, start_s AS end_s, row_number() OVER w > 1 AS preceded, end_s IS NOT NULL AS followed
  FROM (SELECT source_id, start_s, end_s FROM breaks UNION ALL SELECT source_id, duration, NULL FROM media) WINDOW w AS (PARTITION BY source_id ORDER BY end_s IS NULL, start_s, end_s)),
segment AS (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_s, end_s) AS seg FROM (
    SELECT source_id, 'ad_break' AS label, start_s, end_s, confidence FROM breaks
    UNION ALL
    SELECT source_id, CASE WHEN end_s - start_s >= 120 THEN 'programme' ELSE 'unknown' END, start_s, end_s,
      CASE WHEN end_s - start_s >= 120 THEN 0.55::DOUBLE + (CASE WHEN preceded THEN 0.15 ELSE 0 END)::DOUBLE + (CASE WHEN followed THEN 0.15 ELSE 0 END)::DOUBLE + (CASE WHEN end_s - start_s >= 600 THEN 0.08 ELSE 0 END)::DOUBLE ELSE 0.35::DOUBLE END
    FROM gaps WHERE end_s > start_s + 1e-6)),
clipped AS (
  SELECT s.source_id, seg, family, greatest(s.start_s, o.start_s) AS start_s, least(s.end_s, o.end_s) AS end_s FROM segment s JOIN seen o USING (source_id) WHERE least(s.end_s, o.end_s) > greatest(s.start_s, o.start_s)),
covered AS (SELECT source_id, seg, sum(len) AS len FROM (SELECT source_id, seg, max(end_s) - min(start_s) AS len FROM {blocks('clipped', 'source_id, seg', '0')} GROUP BY source_id, seg, block) GROUP BY ALL),
counted AS (SELECT source_id, seg, count(DISTINCT family) AS family_count FROM clipped GROUP BY ALL)"""

PAGES = """
p AS (SELECT page_id % 7 AS source_id, page_id, octet_length(encode(html))::BIGINT AS n FROM pages),
b AS (
  SELECT *, row_number() OVER w - 1 AS i, (sum(n) OVER w - n)::BIGINT AS start_byte, (sum(n) OVER w)::BIGINT AS end_byte FROM p WINDOW w AS (PARTITION BY source_id ORDER BY page_id))"""

SCALED = """scaled AS (
  SELECT {0}, place, value::FLOAT AS value, sqrt(sum(value::FLOAT::DOUBLE * value::FLOAT::DOUBLE) OVER (PARTITION BY {0})) AS norm FROM part),
feature AS (SELECT {0}, place, CASE WHEN norm * norm <= 1e-20 THEN value ELSE (value * (1 / norm)::FLOAT)::FLOAT END::DOUBLE AS v FROM scaled)"""
#: Features of up to 256 samples: one frame, which lies in the last quarter.
AUDIO = f"""WITH sample AS (
  SELECT vec_id, len(embedding) AS n, unnest(range(len(embedding))) AS i, unnest(embedding)::FLOAT::DOUBLE AS x FROM embeddings),
bin AS (
  SELECT b, least(23, floor(ln(b * 15.625::DOUBLE / 60) / ln(3800::DOUBLE / 60) * 24))::INTEGER AS band FROM range(1, 256) t(b) WHERE b * 15.625 BETWEEN 60 AND 3800),
wave AS (
  SELECT vec_id, b, sum(x * hann * cos(2 * pi() * b * i / 512)) AS re, sum(x * hann * sin(2 * pi() * b * i / 512)) AS im
  FROM (SELECT *, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 511) AS hann FROM sample), bin GROUP BY ALL),
power AS (SELECT vec_id, band, sum(re * re + im * im) AS p FROM wave JOIN bin USING (b) GROUP BY ALL),
every AS (
  SELECT v.vec_id, k, coalesce(p, 0) AS p, ln(1 + coalesce(p, 0)) AS l FROM (SELECT DISTINCT vec_id FROM sample) v CROSS JOIN range(24) t(k) LEFT JOIN power w ON w.vec_id = v.vec_id AND w.band = k),
tone AS (
  SELECT vec_id, sum(p) AS total, sum(p * k) AS centre, exp(avg(ln(p + 1e-12))) AS geometric, avg(p) AS mean, sum(p) FILTER (WHERE k < 4) AS low, sum(p) FILTER (WHERE k >= 20) AS high FROM every GROUP BY vec_id),
loud AS (
  SELECT vec_id, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, avg(abs(x)) AS mean_abs, count(*) FILTER (WHERE turned) / max(n)::DOUBLE AS crossings
  FROM (SELECT *, (x < 0) <> (lag(x) OVER (PARTITION BY vec_id ORDER BY i) < 0) AS turned FROM sample) GROUP BY vec_id),
part AS (
  SELECT vec_id, k + 1 AS place, l AS value FROM every
  UNION ALL SELECT vec_id, 109 + k // 2, sum(l) FROM every GROUP BY vec_id, k // 2
  UNION ALL SELECT vec_id, unnest(range(121, 129)), unnest([rms, crossings, CASE WHEN total > 0 THEN centre / (23 * total) ELSE 0 END, CASE WHEN total > 0 THEN geometric / mean ELSE 0 END,
    mean_abs, peak, CASE WHEN peak > 0 THEN rms / peak ELSE 0 END, ln((low + 1e-12) / (high + 1e-12))]) FROM tone JOIN loud USING (vec_id)),
{SCALED.format('vec_id')}"""

VIDEO = f"""WITH hexed AS (SELECT page_id, rpad(substr(hex(encode(coalesce(html, ''))), 1, 1152), 1152, '0') AS h FROM pages),
px AS (SELECT page_id, i // 32 AS y, i % 32 AS x, ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS p FROM hexed, range(576) t(i)),
mean AS (SELECT page_id, avg(p) AS mean FROM px GROUP BY page_id),
near AS (
  SELECT page_id, y, x, lead(p) OVER r - lag(p) OVER r AS gx, lead(p) OVER c - lag(p) OVER c AS gy FROM px WINDOW r AS (PARTITION BY page_id, y ORDER BY x), c AS (PARTITION BY page_id, x ORDER BY y)),
steep AS (
  SELECT page_id, 4 * (CASE WHEN y >= 9 THEN 2 ELSE 0 END + CASE WHEN x >= 16 THEN 1 ELSE 0 END) + CASE WHEN abs(gx) > 2 * abs(gy) THEN 0 WHEN abs(gy) > 2 * abs(gx) THEN 1 WHEN gx * gy >= 0 THEN 2 ELSE 3 END AS k,
    sqrt((gx * gx + gy * gy)::DOUBLE) AS size FROM near WHERE y BETWEEN 1 AND 16 AND x BETWEEN 1 AND 30),
found AS (
  SELECT page_id, 8 * k + l + 1 AS place, sum(cos(pi() * (2 * y + 1) * k / 36) * (p - mean) * cos(pi() * (2 * x + 1) * l / 64)) / (255 * 576) AS value
  FROM px JOIN mean USING (page_id), range(8) a(k), range(8) b(l) WHERE k + l > 0 GROUP BY page_id, k, l
  UNION ALL SELECT page_id, 1, mean / 255 FROM mean
  UNION ALL SELECT page_id, 65 + 8 * CASE WHEN y < 4 THEN 0 WHEN y < 9 THEN 1 WHEN y < 13 THEN 2 ELSE 3 END + x // 4 AS place, (avg(p) - any_value(mean)) / 255 FROM px JOIN mean USING (page_id) GROUP BY page_id, place
  UNION ALL SELECT page_id, 97 + p // 16 AS place, count(*) / 576::DOUBLE FROM px GROUP BY page_id, place
  UNION ALL SELECT page_id, 113 + k, sum(size) / any_value(total) FROM steep JOIN (SELECT page_id, sum(size) AS total FROM steep GROUP BY page_id) USING (page_id) WHERE total > 0 GROUP BY page_id, k),
part AS (SELECT page_id, place, coalesce(value, 0) AS value FROM mean CROSS JOIN range(1, 129) t(place) LEFT JOIN found USING (page_id, place)),
{SCALED.format('page_id')}"""

ORACLE: dict[str, str] = {
    "video_feature": f"""{VIDEO}
SELECT page_id, round(max(v) FILTER (WHERE place = 1), 5) AS mean_level, round(sum(v * v), 4) AS norm2, 128::INTEGER AS dim, round(sum(v) FILTER (WHERE place BETWEEN 2 AND 64), 5) AS waves,
  round(sum(v) FILTER (WHERE place > 112), 5) AS edges, round(sum(v * place), 3) AS moment
FROM feature GROUP BY page_id""",
    "audio_feature": f"""{AUDIO}
SELECT vec_id, round(sum(v * v), 4) AS norm2, 128::INTEGER AS dim, round(sum(v) FILTER (WHERE place <= 24), 5) AS levels, round(sum(v) FILTER (WHERE place > 120), 5) AS shape, round(sum(v * place), 3) AS moment
FROM feature GROUP BY vec_id""",
    "vec_norm": f"SELECT vec_id, round(sqrt({NORM.format('embedding')}), 6) AS norm FROM embeddings",
    "vec_quantize": f"WITH {VEC} SELECT vec_id, list_sum(q)::BIGINT AS sum_q, list_sum(list_transform(q, lambda x: x::BIGINT * x))::BIGINT AS sum_q2 FROM vecs",
    "cosine_pairs": f"""WITH v AS (SELECT vec_id, embedding AS e, {NORM.format('embedding')} AS n2 FROM embeddings),
c AS (
  SELECT a.vec_id AS a, b.vec_id AS b, (list_sum(list_transform(list_zip(b.e, a.e), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(a.n2 * b.n2))::FLOAT AS cosine
  FROM v a JOIN v b ON a.vec_id < b.vec_id)
SELECT a, b, {SIX.format('cosine')} AS cosine FROM c WHERE cosine >= 0.3::FLOAT""",
    "asym_topk": f"""WITH {VEC},
s AS (SELECT a.vec_id, b.vec_id AS ref_id, {SCORE.format('a', 'b')} AS similarity FROM vecs a, vecs b)
SELECT vec_id, ref_id, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, ref_id) AS rank, {SIX.format('similarity')} AS similarity
FROM s WHERE similarity >= 0.2::FLOAT QUALIFY rank <= 5""",
    "topk_exclude_own": f"WITH {REC}, {ranked('true', 12)} SELECT source_id, start_s, ref_source_id, ref_start_s, {SIX.format('similarity')} AS similarity FROM hits WHERE source_id <> ref_source_id",
    "extractor_compat": f"""WITH {REC}, {ranked('a.t % 2 = b.t % 2', 12)}
SELECT source_id, 'space-' || (start_s::BIGINT % 2) AS extractor_id, ref_source_id, count(*) AS hits FROM hits GROUP BY ALL""",
    "base_vectors_union": """WITH src AS (SELECT s_suppkey AS r, 'source-' || s_suppkey AS source_id FROM supplier),
b AS (SELECT r, source_id, s, s % 10 AS x, s * 3 % 10 AS y, s * 7 % 10 AS z FROM src, range(20) t(s))
SELECT source_id, 'video_perceptual' AS kind, s::DOUBLE AS start_s, s + 1.0::DOUBLE AS end_s, x + 1.0::DOUBLE AS v1, y + 1.0::DOUBLE AS v2 FROM b WHERE s <> 7
UNION ALL SELECT source_id, 'audio_spectrum', s::DOUBLE, s + 1.0::DOUBLE, x + 2.0::DOUBLE, z + 1.0::DOUBLE FROM b WHERE s <> 3 AND r % 2 = 1
UNION ALL SELECT source_id, 'audio_spectrum', s * 0.5::DOUBLE, s * 0.5::DOUBLE + 1, 1.0::DOUBLE, 2.0::DOUBLE FROM src, range(2) t(s) WHERE r % 2 = 0""",
    "lsh_signature": f"WITH {HASHES.format('unit')} SELECT vec_id, tab::BIGINT AS tab, hash FROM hash_of",
    "lsh_probe": f"WITH {PROBES} SELECT vec_id, count(*) AS n, sum(ref)::BIGINT AS sum_ref FROM away WHERE bits <= 1 GROUP BY vec_id",
    "lsh_widen": f"""WITH {PROBES},
few AS (SELECT vec_id, count(*) FILTER (WHERE bits <= 1) < 64 AS few FROM away GROUP BY vec_id)
SELECT vec_id, count(*) AS n, sum(ref)::BIGINT AS sum_ref FROM away JOIN few USING (vec_id) WHERE bits <= CASE WHEN few THEN 2 ELSE 1 END GROUP BY vec_id""",
    "lsh_topk": f"WITH {REC}, {ranked('true', 12)} SELECT source_id, count(*) AS hits FROM hits GROUP BY source_id",
    "self_repeat_anchors": f"WITH {REC}, {SELF.format('0.3')} SELECT source_id, start_s, ref_start_s, {SIX.format('similarity')} AS similarity FROM own_hits WHERE ref_start_s - start_s + 1e-6 >= 5",
    "offset_bins": f"WITH {REC}, {ranked('true', 12)} SELECT source_id, ref_source_id, round((ref_start_s - start_s) / 2)::BIGINT AS bin, count(*) AS anchors FROM ({CROSS}) GROUP BY ALL",
    "anchor_dedupe": f"""WITH {REC}, {ranked('true', 12)},
binned AS (SELECT *, round((ref_start_s - start_s) / 20)::BIGINT AS offset_bin FROM ({CROSS}))
SELECT source_id, ref_source_id, offset_bin, start_s, ref_start_s FROM binned
QUALIFY row_number() OVER (PARTITION BY source_id, ref_source_id, offset_bin, start_s ORDER BY similarity DESC, ref_start_s) = 1""",
    "aligned_spans": f"WITH {REC}, {ranked('true', 12)}, {aligned(CROSS)}",
    "scan_spans": f"WITH {REC}, {ranked('true', 12)}, {SELF.format('0.985')}, {aligned(f'{CROSS} UNION ALL {FORWARD}')}",
    "av_confirm": f"WITH {MATCHES} SELECT match_id FROM sure",
    "match_selection": f"""WITH {MATCHES}
SELECT m.match_id, s.match_id IS NOT NULL AS confirmed FROM m LEFT JOIN sure s USING (match_id)
WHERE m.reference_type = 'advertisement' OR s.match_id IS NOT NULL OR m.similarity::DOUBLE >= 0.985::DOUBLE""",
    "occurrence_edges": f"""WITH {MATCHES},
n AS (
  SELECT 2 * match_id AS node, source_id, source_id AS src, q_start AS s, q_end AS e FROM m
  UNION ALL SELECT 2 * match_id + 1, source_id, reference_id, r_start, r_end FROM m)
SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON a.source_id = b.source_id AND a.src = b.src AND a.node < b.node AND abs(a.s - b.s) <= 3
WHERE least(a.e, b.e) - greatest(a.s, b.s) >= 0.7::DOUBLE * least(a.e - a.s, b.e - b.s)""",
    "content_components": "SELECT doc_id AS node, low AS component FROM (SELECT doc_id, min(doc_id) OVER g AS low, count(*) OVER g AS n FROM documents WINDOW g AS (PARTITION BY text)) WHERE n > 1",
    "family_stats": f"""{FAMILIES}
SELECT source_id, 'repeat-' || family AS family_id, classification, known_type, round(confidence, 6) AS confidence, typical, n::INTEGER AS occurrences FROM family""",
    "timeline_labels": f"""{TIMELINE}
SELECT source_id, seg::INTEGER AS seg, label, start_s, end_s, round(greatest(0, least(1, confidence)), 6) AS confidence, round(least(1, coalesce(len, 0) / (end_s - start_s)), 6) AS repeat_coverage, coalesce(family_count, 0) AS family_count
FROM segment LEFT JOIN covered USING (source_id, seg) LEFT JOIN counted USING (source_id, seg)""",
    "interval_blocks": f"""WITH {INT.format('user_id')}
SELECT k, block::BIGINT AS block, round(min(start_s), 6) AS start_s, round(max(end_s), 6) AS end_s, count(*) AS n FROM {blocks('iv', 'k', '600', 'start_s, end_s, event_id')} GROUP BY k, block""",
    "interval_union": f"""WITH {INT.format('event_type')},
u AS (SELECT k, block, max(end_s) - min(start_s) AS len FROM {blocks('iv', 'k', '0')} GROUP BY k, block)
SELECT k, count(*) AS parts, round(sum(len), 3) AS seconds FROM u GROUP BY k""",
    "union_coverage_days": f"""WITH {INT.format('event_type')},
days AS (SELECT k, seg, seg * 86400.0::DOUBLE AS s, (seg + 1) * 86400.0::DOUBLE AS e FROM (SELECT DISTINCT k FROM iv), range(30) t(seg)),
clipped AS (SELECT d.k, d.seg, greatest(s, start_s) AS start_s, least(e, end_s) AS end_s FROM days d JOIN iv USING (k) WHERE least(e, end_s) > greatest(s, start_s)),
u AS (SELECT k, seg, block, max(end_s) - min(start_s) AS len FROM {blocks('clipped', 'k, seg', '0')} GROUP BY ALL)
SELECT k, seg, round(least(1, coalesce(sum(len), 0) / 86400), 6) AS coverage FROM days LEFT JOIN u USING (k, seg) GROUP BY k, seg""",
    "ad_blocks": f"{ADS} SELECT source_id, block::BIGINT AS block, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(confidence, 6) AS confidence, confirmed, known_ad, families FROM ev",
    "block_extents": f"{ADS} SELECT source_id, block::BIGINT AS block, family, round(min(start_s), 6) AS start_s, round(max(end_s), 6) AS end_s FROM b GROUP BY source_id, block, family",
    "edge_stats": f"""{ADS},
x AS (SELECT b.source_id, b.block, family, min(b.start_s) AS s, max(b.end_s) AS e FROM b JOIN ev USING (source_id, block) WHERE families >= 3 GROUP BY ALL),
f AS (SELECT source_id, family, row_number() OVER w AS n, abs(lead(s) OVER w - s) AS lead, lead(family) OVER w AS nxt, 'leading' AS edge FROM x WINDOW w AS (PARTITION BY source_id, block ORDER BY s, e, family)),
l AS (SELECT source_id, family, row_number() OVER w AS n, abs(lead(e) OVER w - e) AS lead, lead(family) OVER w AS nxt, 'trailing' AS edge FROM x WINDOW w AS (PARTITION BY source_id, block ORDER BY e DESC, s DESC, family DESC))
SELECT source_id, family, edge, count(*) AS n_blocks, count(DISTINCT nxt) AS neighbours FROM (SELECT * FROM f UNION ALL SELECT * FROM l) WHERE n = 1 AND lead > 1e-6 GROUP BY ALL""",
    "asof_marker": f"""{MARKERS},
parts AS (SELECT k AS source_id, event_id AS block, start_s AS s, end_s AS e FROM iv),
bef AS (
  SELECT block, family_id FROM parts JOIN mk USING (source_id) WHERE out AND m_start <= s AND m_end <= s + 7200 AND s - m_end <= 14400
  QUALIFY row_number() OVER (PARTITION BY block ORDER BY m_end DESC, m_start, family) = 1),
aft AS (
  SELECT block, family_id FROM parts JOIN mk USING (source_id) WHERE NOT out AND m_end >= e AND m_start >= e - 7200 AND m_start - e <= 14400
  QUALIFY row_number() OVER (PARTITION BY block ORDER BY m_start, m_end, family) = 1)
SELECT source_id, block, bef.family_id AS before_id, aft.family_id AS after_id FROM parts LEFT JOIN bef USING (block) LEFT JOIN aft USING (block)""",
    "next_pair": f"""{MARKERS},
nxt AS (
  SELECT a.source_id, a.family_id AS out_id, a.m_end AS start_s, b.m_start AS end_s, b.family_id AS in_id, b.out FROM mk a JOIN mk b ON a.source_id = b.source_id AND b.m_start >= a.m_end
    AND (b.m_start, b.m_end, b.family) > (a.m_start, a.m_end, a.family)
  WHERE a.out QUALIFY row_number() OVER (PARTITION BY a.family ORDER BY b.m_start, b.m_end, b.family) = 1)
SELECT source_id, out_id, in_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM nxt WHERE NOT out AND end_s > start_s AND end_s - start_s <= 200000""",
    "merge_first_last": f"""WITH {INT.format('user_id')},
rows AS (
  SELECT k AS source_id, event_id, start_s, end_s, event_id % 5 = 0 AS exempt, CASE WHEN event_id % 3 = 0 THEN 'o' || event_id END AS out_id, CASE WHEN event_id % 2 = 0 THEN 'i' || event_id END AS in_id
  FROM iv WHERE value > 0)
SELECT source_id, round(min(start_s), 6) AS start_s, round(max(end_s), 6) AS end_s, bool_or(exempt) AS exempt,
  first(out_id ORDER BY start_s, end_s) FILTER (WHERE out_id IS NOT NULL) AS out_id, last(in_id ORDER BY start_s, end_s) FILTER (WHERE in_id IS NOT NULL) AS in_id
FROM {blocks('rows', 'source_id', '7200', 'start_s, end_s, event_id')} GROUP BY source_id, block""",
    "complement_timeline": f"""WITH {INT.format('user_id')},
u AS (SELECT k, block, min(start_s) AS s, max(end_s) AS e FROM {blocks('iv', 'k', '0')} GROUP BY ALL),
g AS (
  SELECT k, coalesce(lag(e) OVER w, 0) AS c, s AS b, lag(e) OVER w IS NOT NULL AS preceded, true AS followed FROM u WINDOW w AS (PARTITION BY k ORDER BY s)
  UNION ALL SELECT k, max(e), 2592000, true, false FROM u GROUP BY k)
SELECT k, round(c, 6) AS start_s, round(b, 6) AS end_s, preceded, followed FROM g WHERE b > c + 1e-6""",
    "byte_at": f"""WITH {PAGES},
asked AS (SELECT source_id, page_id, page_id % 50 AS x, max(i) OVER (PARTITION BY source_id) AS last FROM b)
SELECT a.source_id, a.page_id, f.start_byte AS first_byte, f.end_byte - 1 AS last_byte FROM asked a JOIN b f ON f.source_id = a.source_id AND f.i = least(a.last, a.x)""",
    "tumbling_buckets": f"""WITH {INT.format('event_type')},
c AS (SELECT k, floor(start_s / 3600)::BIGINT AS bucket, count(*) AS n, min(event_id - 3) FILTER (WHERE event_id >= 3 AND trunc(value) > 0) AS low, max(event_id - 4 + trunc(value)::BIGINT) FILTER (WHERE event_id >= 3 AND trunc(value) > 0) AS high FROM iv GROUP BY ALL),
every AS (SELECT k, unnest(range(max(bucket) + 1)) AS bucket FROM c GROUP BY k)
SELECT k, bucket, coalesce(n, 0) AS n, coalesce(low, -1) AS low, coalesce(high, -1) AS high FROM every LEFT JOIN c USING (k, bucket)""",
    "hopping_windows": f"""WITH {INT.format('event_type')}
SELECT k, w * 1800.0::DOUBLE AS start_s, w * 1800.0::DOUBLE + 7200 AS end_s, count(*) AS n, round(sum(value), 4) AS total
FROM iv JOIN range(1441) t(w) ON start_s >= w * 1800 AND start_s < w * 1800 + 7200 GROUP BY ALL""",
    "retention": """WITH s AS (
  SELECT c_custkey::VARCHAR AS source_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'recording' ELSE lower(c_mktsegment) END AS source_type, c_custkey % 97 AS sequence FROM customer)
SELECT source_id, source_type, sequence FROM s WHERE source_type <> 'recording'
UNION ALL (SELECT source_id, source_type, sequence FROM s WHERE source_type = 'recording' ORDER BY sequence DESC, source_id DESC LIMIT 25)""",
    "upsert_source": """WITH old AS (
  SELECT c_custkey::VARCHAR AS source_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'recording' ELSE lower(c_mktsegment) END AS source_type, o_orderpriority AS extractor_id, o_orderkey
  FROM orders JOIN customer ON o_custkey = c_custkey),
new AS (SELECT * REPLACE (-o_orderkey AS o_orderkey) FROM old WHERE source_id::BIGINT % 10 = 0 AND o_orderkey % 2 = 0)
SELECT * FROM old WHERE source_id NOT IN (SELECT source_id FROM new) UNION ALL SELECT * FROM new""",
    "catalog_info": """SELECT count(*) AS vectors, count(DISTINCT o_custkey) AS sources, count(DISTINCT o_custkey) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AS recordings,
  count(DISTINCT o_orderpriority) AS extractors FROM orders JOIN customer ON o_custkey = c_custkey""",
    "packet_partition": f"""WITH {PAGES},
src AS (SELECT source_id, max(end_byte) AS size, count(*)::DOUBLE AS duration FROM b GROUP BY source_id),
a AS (
  SELECT source_id, size, duration, start_byte // 188 * 188 AS lo, least(size, (end_byte + 187) // 188 * 188) AS hi, i::DOUBLE AS t0, i + 1.0::DOUBLE AS t1
  FROM b JOIN src USING (source_id) WHERE page_id % 3 = 0 AND end_byte > start_byte),
c AS (
  SELECT *, coalesce(max(hi) OVER w, 0) AS pos, coalesce(max(t1) OVER w, 0) AS time, greatest(lo, coalesce(max(hi) OVER w, 0)) AS first
  FROM a WINDOW w AS (PARTITION BY source_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
parts AS (
  SELECT source_id, first, hi AS last, 'programme' AS kind, t0, t1 FROM c WHERE hi > first
  UNION ALL SELECT source_id, pos, first, 'between', time, t0 FROM c WHERE first > pos
  UNION ALL SELECT source_id, coalesce(max(hi), 0), size, 'between', coalesce(max(t1), 0), duration FROM src LEFT JOIN (SELECT source_id, hi, t1 FROM a) USING (source_id) GROUP BY source_id, size, duration HAVING coalesce(max(hi), 0) < size)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY first) AS part, first, last, kind, t0, t1 FROM parts""",
    "source_id_fnv": """WITH t AS (SELECT page_id, encode(url || octet_length(encode(html))) AS b FROM pages),
bytes AS (SELECT page_id, list_prepend(14695981039346656037::UHUGEINT, [('0x' || substr(hex(b), 2 * i - 1, 2))::UTINYINT::UHUGEINT FOR i IN range(1, octet_length(b) + 1)]) AS x FROM t)
SELECT page_id, lower(to_hex(list_reduce(x, lambda h, c: (xor(h::UBIGINT, c::UBIGINT)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)) AS id FROM bytes""",
    "report_json": f"""WITH {REC}, {ranked('true', 12)}, {SELF.format('0.985')}, found AS ({aligned(f'{CROSS} UNION ALL {FORWARD}').replace('binned AS', 'WITH binned AS', 1)})
SELECT source_id, '{{"feature":"' || kind || '","extractor_id":"space-0","anchor_count":' || anchor_count || ',"similarity":' || round(similarity, 3)
  || ',"query":{{"start_byte":' || q_start_byte || ',"end_byte":' || q_end_byte || ',"start_time_seconds":' || q_start || ',"end_time_seconds":' || q_end
  || '}},"reference":{{"source_id":"' || reference_id || '","content_type":"recording","start_byte":' || r_start_byte || ',"end_byte":' || r_end_byte
  || ',"start_time_seconds":' || r_start || ',"end_time_seconds":' || r_end || '}}}}' AS match FROM found""",
    "timestamp_repair": """WITH RECURSIVE f AS (
  SELECT 's' || (user_id % 20) AS source_id, CASE WHEN event_id % 2 = 0 THEN 'audio' ELSE 'video' END AS stream, event_id AS seq, 0.5::DOUBLE AS len,
    CASE WHEN event_id % 13 <> 0 THEN event_id / 10.0::DOUBLE + CASE WHEN event_id % 101 = 0 THEN 5000.0::DOUBLE ELSE 0 END END AS raw, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS n
  FROM events),
r AS (
  SELECT DISTINCT source_id, 0::BIGINT AS n, NULL::VARCHAR AS stream, NULL::BIGINT AS seq, 0::DOUBLE AS frontier, NULL::DOUBLE AS a_off, NULL::DOUBLE AS a_last, NULL::DOUBLE AS a_exp,
    NULL::DOUBLE AS v_off, NULL::DOUBLE AS v_last, NULL::DOUBLE AS v_exp, NULL::DOUBLE AS out, NULL::VARCHAR AS event FROM f
  UNION ALL
  SELECT source_id, n, stream, seq, greatest(frontier, out + len),
    CASE WHEN stream = 'audio' THEN noff ELSE a_off END, CASE WHEN stream = 'audio' THEN out ELSE a_last END, CASE WHEN stream = 'audio' THEN out + len ELSE a_exp END,
    CASE WHEN stream = 'video' THEN noff ELSE v_off END, CASE WHEN stream = 'video' THEN out ELSE v_last END, CASE WHEN stream = 'video' THEN out + len ELSE v_exp END, out, event
  FROM (
    SELECT *, CASE WHEN raw IS NULL THEN coalesce(off, 0) WHEN event IS NOT NULL THEN out - raw WHEN exp IS NULL THEN 0 ELSE off END AS noff FROM (
      SELECT *, CASE WHEN raw IS NULL OR event IS NOT NULL THEN coalesce(exp, frontier) WHEN exp IS NULL THEN greatest(0, raw) ELSE greatest(raw + off, last) END AS out FROM (
        SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN exp IS NULL THEN CASE WHEN greatest(0, raw) > frontier + 10 THEN 'forward' END
          WHEN raw + off > greatest(exp, frontier) + 10 THEN 'forward' WHEN raw + off < exp - 1 THEN 'backward' END AS event FROM (
          SELECT f.source_id, f.n, f.stream, f.seq, f.raw, f.len, r.frontier, r.a_off, r.a_last, r.a_exp, r.v_off, r.v_last, r.v_exp,
            CASE WHEN f.stream = 'audio' THEN r.a_off ELSE r.v_off END AS off, CASE WHEN f.stream = 'audio' THEN r.a_last ELSE r.v_last END AS last, CASE WHEN f.stream = 'audio' THEN r.a_exp ELSE r.v_exp END AS exp
          FROM r JOIN f ON f.source_id = r.source_id AND f.n = r.n + 1)))))
SELECT source_id, stream, seq, round(out, 6) AS out_s, event FROM r WHERE n > 0""",
    "part_names": f"""WITH {INT.format('user_id')},
s AS (SELECT *, floor(start_s / 100)::BIGINT AS a, ceil(end_s / 100)::BIGINT AS b FROM iv)
SELECT event_id, printf('rec%d.part%03d_%s_%02d-%02d-%02d_%02d-%02d-%02d.ts', k, event_id, event_type, a // 3600, a // 60 % 60, a % 60, b // 3600, b // 60 % 60, b % 60) AS name FROM s""",
}
