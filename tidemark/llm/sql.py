"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
k AS (SELECT *, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keep AS dropped FROM k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP3 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""

# the same draw, plan and order as the operator's: shares in closed form, then running sums by rank
OP4 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(text, '')) AS draw FROM documents),
r AS (SELECT *, CASE WHEN size < 64 THEN 2 WHEN size < 512 THEN 3 ELSE 4 END AS pref FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, (3 * source_size)::DOUBLE AS c, (sum(source_size) OVER ())::DOUBLE AS t FROM s0),
s2 AS (SELECT *, coalesce((t - coalesce(sum(c) OVER b, 0.0)) / nullif(sum(w) OVER () - coalesce(sum(w) OVER b, 0.0), 0.0) * w >= c, true) AS capped
  FROM s1 WINDOW b AS (ORDER BY c / w NULLS FIRST, w, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT source, source_size, CASE WHEN capped THEN c ELSE (t - sum(CASE WHEN capped THEN c ELSE 0.0 END) OVER ()) * w / nullif(sum(w) OVER () - sum(CASE WHEN capped THEN w ELSE 0.0 END) OVER (), 0.0) END AS target FROM s2),
k0 AS (SELECT source, pref, sum(size)::BIGINT AS kind_size FROM r GROUP BY source, pref),
k1 AS (SELECT k0.*, s.source_size, s.target, (pref * kind_size)::DOUBLE AS w, (3 * kind_size)::DOUBLE AS c FROM k0 JOIN s ON k0.source IS NOT DISTINCT FROM s.source),
k2 AS (SELECT *, coalesce((target - coalesce(sum(c) OVER b, 0.0)) / nullif(sum(w) OVER p - coalesce(sum(w) OVER b, 0.0), 0.0) * w >= c, true) AS capped
  FROM k1 WINDOW p AS (PARTITION BY source), b AS (PARTITION BY source ORDER BY c / nullif(w, 0.0) NULLS FIRST, w, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k3 AS (SELECT *, coalesce((CASE WHEN capped THEN c ELSE (target - sum(CASE WHEN capped THEN c ELSE 0.0 END) OVER p) * w / nullif(sum(w) OVER p - sum(CASE WHEN capped THEN w ELSE 0.0 END) OVER p, 0.0) END) / nullif(kind_size, 0), 0.0) AS copies
  FROM k2 WINDOW p AS (PARTITION BY source)),
k AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p,
    greatest(0, round(target)::BIGINT - sum(floor(copies)::BIGINT * kind_size) OVER (PARTITION BY source)) AS rest FROM k3),
u AS (SELECT r.*, k.source_size, k.target, k.whole, k.p, k.rest, (('0x' || substr(draw, 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM r JOIN k ON r.source IS NOT DISTINCT FROM k.source AND r.pref = k.pref),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM u),
a AS (SELECT *, coalesce(sum(CASE WHEN p > 0 THEN size END) OVER (PARTITION BY source, p > 0 ORDER BY odds / (1 + odds), doc_id, draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM q)
SELECT doc_id, size, source_size, target, (whole * size + CASE WHEN p > 0 THEN greatest(0, least(size, rest - ahead)) ELSE 0 END)::BIGINT AS taken FROM a
"""

OP5 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS MATERIALIZED (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT s.doc_id, len(s.sh) AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, s.sh
"""

# units joined again by position; the cut's ends are code points of what stands before
OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS us, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

_SEEDS = """
WITH k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM k QUALIFY c < 40)"""
# the distances of every vector to every centroid, in full
_NEAREST = """
a{i} AS MATERIALIZED (SELECT vec_id, v, min_by(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT k.rowid AS r, k.vec_id, k.v, q.c, list_sum(list_transform(list_zip(k.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM (SELECT *, row_number() OVER () AS rowid FROM k) k, c{i} q)
  GROUP BY r, vec_id, v)"""
_MOVED = """
m{i} AS (SELECT c, j, floor_div FROM (SELECT c, j, (sum(v[j]) - ((sum(v[j]) % count(*) + count(*)) % count(*))) // count(*) AS floor_div FROM a{i}, range(1, 65) t(j) GROUP BY c, j)),
c{n} AS MATERIALIZED (SELECT q.c, coalesce(w.v, q.v) AS v FROM c{i} q LEFT JOIN (SELECT c, list(floor_div::BIGINT ORDER BY j) AS v FROM m{i} GROUP BY c) w ON q.c = w.c)"""
OP13 = (
    ",".join([_SEEDS, *[step.format(i=i, n=i + 1) for i in range(5) for step in (_NEAREST, _MOVED)], _NEAREST.format(i=5)])
    + """
SELECT vec_id, a5.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a5.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c5.v, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON a5.c = c5.c
"""
)

ORACLES: dict[str, str] = {"op2_line_dedup": OP2, "op3_exact_dedup": OP3, "op4_mixing": OP4, "op5_chat_formatting": OP5, "op7_minhash_near_dedup": OP7, "op11_fill_in_middle": OP11, "op13_centroids": OP13}
