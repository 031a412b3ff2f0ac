"""DuckDB twins of the dealt queries."""

from __future__ import annotations

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _hash60(parts: str) -> str:
    return f"('0x' || substr(md5('mix-1:' || {parts}), 1, 15))::BIGINT"


def _apportion(units: str, keys: str, weight: str, seats: str, order: str, name: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    named = ", ".join(x for x in (keys, order) if x)
    on = " AND ".join(f"l.{x} = w.{x}" for x in named.split(", "))
    return f"""
{name}_a AS (SELECT *, (sum({weight}) OVER ({part}))::DOUBLE AS _total, count(*) OVER ({part}) AS _n FROM {units}),
{name}_b AS (SELECT *,
  CASE WHEN _total > 0 THEN floor({weight} * greatest({seats} - _n / 2, 0.0) / _total + 0.5) ELSE 0 END::BIGINT AS _base,
  CASE WHEN {weight} > 0 THEN CASE WHEN _total > 0 THEN floor({weight} * ({seats} + _n / 2) / _total + 0.5) ELSE 0 END + 1 ELSE 0 END::BIGINT AS _top
  FROM {name}_a),
{name}_c AS (SELECT *, {seats} - sum(_base) OVER ({part}) AS _left FROM {name}_b),
{name}_d AS (SELECT {named}, {weight}, _left, unnest(generate_series(_base + 1, _top)) AS _k FROM {name}_c),
{name}_w AS (SELECT {named}, count(*) AS _won FROM
  (SELECT {named}, _left, row_number() OVER ({part} ORDER BY {weight} / (2 * _k - 1) DESC, {order}) AS _rank FROM {name}_d) WHERE _rank <= _left GROUP BY {named}),
{name} AS (SELECT l.*, l._base + coalesce(w._won, 0) AS quota FROM {name}_c l LEFT JOIN {name}_w w ON {on})"""


MIXING = f"""
WITH sized AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, {_hash60("coalesce(doc_id::VARCHAR, 'null')")} AS hash FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM sized GROUP BY source),
num AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no, sum(source_size) OVER () * 1.5::DOUBLE AS budget, 2 * source_size AS cap,
  greatest(1, ceil(docs / 8192))::BIGINT AS shards FROM src),
wei AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(source_no - 1) % 3 + 1] AS weight FROM num),
lev AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY cap / weight, source_no) AS pos FROM wei),
tar AS (SELECT *, coalesce(least(cap::DOUBLE, (SELECT arg_min(level, pos) FROM lev WHERE level * weight <= cap) * weight), cap::DOUBLE) AS target FROM lev),
blk AS (SELECT *, greatest(1, floor(budget / greatest(131072, 64 * sum(shards) OVER ())))::BIGINT AS block FROM tar),
sea AS (SELECT *, floor(budget / block)::BIGINT AS seats FROM blk),
{_apportion("sea", "", "target", "seats", "source_no", "sq")},
dealt AS (SELECT s.*, q.source_no, q.source_size, q.target, q.block, q.quota AS source_quota, s.hash % q.shards AS shard FROM sized s JOIN sq q ON s.source IS NOT DISTINCT FROM q.source),
sh AS (SELECT source_no, shard, source_quota, block, sum(size)::BIGINT AS shard_size FROM dealt GROUP BY ALL),
{_apportion("sh", "source_no", "shard_size", "source_quota", "shard", "hq")},
pl AS (SELECT source_no, shard, shard_size, least(quota * block, 2 * shard_size) AS words, greatest(shard_size, 1) AS one,
  {_hash60("source_no || ':' || shard")} % greatest(1, ceil(shard_size / block))::BIGINT * block AS b FROM hq),
placed AS (SELECT d.*, p.shard_size, p.words // p.one AS rounds, p.words % p.one AS rest, p.b,
  sum(d.size) OVER (PARTITION BY d.source_no, d.shard ORDER BY d.hash, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS stop FROM dealt d JOIN pl p USING (source_no, shard))
SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(stop, b + rest) - greatest(stop - size, b))
  + greatest(0, least(stop, b + rest - shard_size) - greatest(stop - size, b - shard_size)))::BIGINT AS taken FROM placed
"""


def _spans(pattern: str, group: int, least: int, kind: str, place: int) -> str:
    quoted = pattern.replace("'", "''")
    gaps = f"list_transform(string_split_regex(t, '{quoted}'), lambda x: length(x))"
    whole = f"list_transform(regexp_extract_all(t, '{quoted}', 0), lambda x: length(x))"
    part = f"list_transform(regexp_extract_all(t, '{quoted}', {group}), lambda x: length(x))"
    return f"""SELECT doc_id, '{kind}' AS kind, {place} AS place, i,
  list_sum(g[1:i])::BIGINT + coalesce(list_sum(m[1:i - 1]), 0)::BIGINT AS s, m[i] AS n, p[i] >= {least} AS ok
  FROM (SELECT doc_id, g, m, p, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, {gaps} AS g, {whole} AS m, {part} AS p FROM d))"""


_RULES = [
    ("(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, "assign"),
    ("AKIA[A-Z0-9]+", 0, 20, "access"),
    ("[0-9a-f]+", 0, 24, "hex"),
    ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "pem"),
    ("eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 0, 1, "jwt"),
    ("gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, "forge"),
]
_LISTED = "coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, place) {0}, '')"
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_spans(p, g, least, kind, place) for place, (p, g, least, kind) in enumerate(_RULES))}),
k AS (SELECT * FROM f WHERE ok),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256({_LISTED.format("FILTER (place < 3)")}) AS base_sha256, {_LISTED.format("")} AS spans FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""

REPEATED_WORDS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w, row_number() OVER () AS rid FROM documents),
s AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT rid, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
t AS (SELECT rid, w, unnest(generate_series(1, len(w))) AS p FROM d),
c AS (SELECT t.rid, t.p, t.w[t.p] AS x, r.i IS NOT NULL AND t.p - r.i < 35 AS gone FROM t ASOF LEFT JOIN r ON t.rid = r.rid AND t.p >= r.i),
a AS (SELECT rid, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM c GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (rid)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""

# 50-byte strings as 100 hex digits; texts are cut into pieces of 200 bytes first, since slicing deep into a text is slow
OLDER_BYTES = """
WITH texts AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS k, hex(encode(coalesce(text, ''))) AS digits
    FROM documents),
pieces AS (
    SELECT r, k, c, substr(digits, 400 * c + 1, 498) AS piece, length(digits) // 2 - 200 * c AS rest
    FROM texts, unnest(range(length(digits) // 400 + 1)) AS u(c)),
windows AS (
    SELECT r, k, 200 * c + j AS i, substr(piece, 2 * j + 1, 100) AS s
    FROM pieces, unnest(range(least(200, rest - 49))) AS u(j)),
gone AS (
    SELECT r, i FROM windows JOIN (SELECT s, min(k) AS least FROM windows GROUP BY s) USING (s) WHERE least < k),
marked AS (
    SELECT r, i, CASE WHEN i > lag(i, 1, -100) OVER (PARTITION BY r ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM gone),
spans AS (
    SELECT r, min(i) AS a, max(i) + 50 AS b
    FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS n FROM marked) GROUP BY r, n),
gaps AS (
    SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM spans),
cleaned AS (
    SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(digits, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
    FROM gaps JOIN texts USING (r) GROUP BY r)
SELECT doc_id, length(digits) // 2 AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept || substr(digits, 2 * last + 1), digits))) AS kept_sha256
FROM texts LEFT JOIN cleaned USING (r)
"""

_FIRST, _REST = "([<\\[])(\\\\*)", "(\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|s>|/s>|INST\\]|/INST\\])"


def _escaped(text: str) -> str:
    return f"regexp_replace({text}, '{_FIRST}{_REST}', '\\1\\\\\\2\\3', 'g')"


CONVERSATIONS = f"""
WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
t AS (SELECT *, length(replace(replace({_escaped("role")}, '%', '%25'), chr(10), '%0A')) + length({_escaped("text")})
  + length('<|im_start|>') + length('<|im_end|>') + 2 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def _vector_codes(rounds: int = 4) -> str:
    steps = [
        """k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, q) AS rid, vec_id, label, q FROM
  (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        """p AS MATERIALIZED (SELECT rid, part, x, list_dot_product(x, x) AS xx FROM
  (SELECT rid, part, q[part * (len(q) // 4) + 1:(part + 1) * (len(q) // 4)] AS x FROM k, range(4) AS r(part)))""",
        "c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x AS e FROM p WHERE rid <= 256)",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT rid, part, min((xx - 2 * list_dot_product(x, e) + list_dot_product(e, e))::BIGINT * 256 + entry) AS best
  FROM p JOIN c{i} USING (part) GROUP BY rid, part)""")
        if i < rounds:
            steps.append(f"""n{i} AS (SELECT part, entry, list(v ORDER BY pos) AS e FROM
  (SELECT part, best % 256 AS entry, pos, floor(sum(x[pos]) / count(*)) AS v FROM a{i} JOIN p USING (rid, part), unnest(range(1, len(x) + 1)) AS u(pos) GROUP BY ALL) GROUP BY ALL)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.e, c.e) AS e FROM c{i} c LEFT JOIN n{i} n USING (part, entry))")
    return f"""
WITH {", ".join(steps)},
d AS (SELECT rid, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a{rounds} GROUP BY rid),
h AS (SELECT sha256(string_agg(e[pos]::BIGINT, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds}, unnest(range(1, len(e) + 1)) AS u(pos))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN d USING (rid), h
"""


VECTOR_CODES = _vector_codes()

FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
n AS (SELECT *, len(u)::BIGINT AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS r FROM d),
f AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM s
"""
