"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_SIZED = r"""
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce('=' || source, '') AS src,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h, coalesce(doc_id::VARCHAR, '') AS k
  FROM documents
"""

MIXING = f"""
WITH d AS ({_SIZED}),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT src, source_size, [5, 2, 1][((row_number() OVER (ORDER BY src = '', src) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
  coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
  (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rest FROM w),
f AS (SELECT *, (total - before) / rest AS level, (total - before) / rest * weight > cap AS is_full FROM l),
t AS (SELECT src, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (SELECT arg_max(level, rest) FROM f WHERE NOT is_full) * weight END AS target FROM f),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.src ORDER BY h, k, size ROWS UNBOUNDED PRECEDING) AS run FROM d JOIN t USING (src)),
e AS (SELECT doc_id, src, h, k, size, e, (run + e * source_size)::DOUBLE / target AS finish FROM q, range(3) r(e) WHERE size > 0 AND target > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, src, h, k, size, e ROWS UNBOUNDED PRECEDING) AS spent FROM e),
n AS (SELECT src, h, k, size, count(*) AS copies FROM c WHERE spent <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (coalesce(copies, 0) * size)::BIGINT AS taken
FROM q LEFT JOIN n USING (src, h, k, size)
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

DECONTAMINATION = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, coalesce({_WORDS}, []::VARCHAR[]) AS w FROM documents),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item FROM g JOIN win USING (n, gram)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


_CONTROL = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[/ROLE]", "[TEXT]")


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in _CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


CHAT = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM c),
s AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 'start') AS state, count(*) OVER (PARTITION BY conv_id) AS n FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length({_escaped('text')}) + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10
    ELSE 23 + length({_escaped('role')}) END))::BIGINT AS formatted_chars,
  bool_and(CASE state WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
    WHEN 'assistant' THEN role = 'user' ELSE false END AND (k < n OR role = 'assistant')) AS valid
FROM s GROUP BY conv_id
"""

EMBEDDINGS = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""


def _centroids(rounds: int = 10) -> str:
    """Each round: distances to all centroids, the nearest one, floors of the means. Tables are spelt out round by round."""
    out = ["""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS j, x AS c FROM v ORDER BY sha256('3:' || vec_id), x LIMIT 8)"""]
    for t in range(rounds + 1):
        out.append(f"""a{t} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min(struct_pack(d, j)) AS m FROM (
  SELECT r, vec_id, x, j, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{t}) GROUP BY r)""")
        if t < rounds:
            out.append(f"""s{t} AS (SELECT j, i, sum(y)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT m.j AS j, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{t}) GROUP BY j, i),
c{t + 1} AS MATERIALIZED (SELECT c{t}.j, coalesce(any_value(n.c), any_value(c{t}.c)) AS c FROM c{t} LEFT JOIN (
  SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{t} GROUP BY j) n ON n.j = c{t}.j GROUP BY c{t}.j)""")
    return ",\n".join(out) + f"""
SELECT vec_id, m.j::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.j))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.j = m.j"""


def _field(c: str, value: str = "") -> str:
    value = value or f"{c}::VARCHAR"
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c, n_chars if c == "n_chars" else "") for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"


#: CRC-32 (the reflected polynomial 0xEDB88320) of a string of ASCII: a value from 0 to 255 is a byte, -1 one step of a bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""

MERKLE = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, lang, {_leaf('n_chars::VARCHAR')} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('(n_chars + 1)::VARCHAR')} END AS tampered FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT coalesce('=' || lang, '') AS tree, 0 AS level, k AS j, n, leaf AS h FROM r
  UNION ALL SELECT tree, level + 1, j // 2, (n + 1) // 2, h FROM (
    SELECT tree, level, j, n, sha256(h || coalesce(lead(h) OVER (PARTITION BY tree ORDER BY j), '')) AS h FROM t WHERE n > 1) WHERE j % 2 = 0),
tt AS MATERIALIZED (SELECT * FROM t),
sub AS MATERIALIZED (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS k, count(*) OVER () AS n, max(level) OVER () AS most, level FROM tt WHERE n = 1),
u AS (SELECT 0 AS level, k AS j, n, subroot AS h FROM sub
  UNION ALL SELECT level + 1, j // 2, (n + 1) // 2, h FROM (
    SELECT level, j, n, sha256(h || coalesce(lead(h) OVER (ORDER BY j), '')) AS h FROM u WHERE n > 1) WHERE j % 2 = 0),
uu AS MATERIALIZED (SELECT * FROM u),
root AS (SELECT h AS root FROM uu WHERE n = 1),
low AS MATERIALIZED (SELECT a.tree, a.level, a.j, b.h FROM tt a LEFT JOIN tt b ON a.tree = b.tree AND a.level = b.level AND b.j = xor(a.j, 1) WHERE a.n > 1),
up AS MATERIALIZED (SELECT a.level, a.j, b.h FROM uu a LEFT JOIN uu b ON a.level = b.level AND b.j = xor(a.j, 1) WHERE a.n > 1),
rows AS MATERIALIZED (SELECT row_number() OVER () AS id, r.*, coalesce('=' || lang, '') AS tree FROM r),
path AS MATERIALIZED (SELECT id, low.level AS s, (rows.k >> low.level) % 2 = 1 AS is_right, coalesce(h, '') AS h FROM rows JOIN low ON rows.tree = low.tree AND low.j = rows.k >> low.level
  UNION ALL SELECT id, sub.level + up.level, (sub.k >> up.level) % 2 = 1, coalesce(h, '') FROM rows JOIN sub ON rows.tree = sub.tree JOIN up ON up.j = sub.k >> up.level),
steps AS MATERIALIZED (SELECT id, count(*) AS m, string_agg(h, '' ORDER BY s) AS kin FROM path GROUP BY id),
fold AS (SELECT id, 0 AS s, coalesce(tampered, leaf) AS h FROM rows
  UNION ALL SELECT fold.id, fold.s + 1, sha256(CASE WHEN is_right THEN path.h || fold.h ELSE fold.h || path.h END) FROM fold JOIN path ON path.id = fold.id AND path.s = fold.s),
folded AS (SELECT id, arg_max(h, s) AS h FROM fold GROUP BY id)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(kin, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM rows JOIN sub ON rows.tree = sub.tree CROSS JOIN root JOIN folded f ON f.id = rows.id LEFT JOIN steps ON steps.id = rows.id
"""

ORACLES: dict[str, str] = {"op1_mixing": MIXING, "op2_chat": CHAT, "op3_embeddings": EMBEDDINGS, "op5_decontamination": DECONTAMINATION,
                           "op12_centroids": _centroids(), "op13_merkle": MERKLE}
