"""SQL of the secret scan and of centroid clustering, written apart from the operators."""

from __future__ import annotations

from vouchermill.llm.secret_scan import ALLOWED_PART, ALLOWED_WHOLE, BASE_KINDS, CLASSES, NAMES


def _either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


def _found(pattern: str, value: int) -> str:
    """Matches m, their values g and the texts between them, b."""
    quoted = pattern.replace("'", "''")
    return f"""regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {value}) AS g,
    string_split_regex(text, '{quoted}') AS b"""


def _placed(source: str) -> str:
    return f"""SELECT r, i, m[i] AS s, g[i] AS v,
    list_sum(list_transform(b[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({source}))"""


_ASSIGN = "(" + "|".join(map(_either_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_FORMS = {"assign": (_ASSIGN, 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}
_SETS = {"entropy_hex": "[0-9a-fA-F]", "entropy_alnum": "[0-9A-Za-z]", "entropy_base64": "[0-9A-Za-z+/=_-]"}
_WHOLE = "|".join(f"(?:{p})" for p in ALLOWED_WHOLE)
_PART = "|".join(ALLOWED_PART)


def _form(number: int, kind: str) -> str:
    pattern, value, least = _FORMS[kind]
    rows = _placed(f"SELECT r, {_found(pattern, value)} FROM d")
    return f"SELECT r, {number} AS k, '{kind}' AS kind, a, a + len(s) AS z FROM ({rows}) WHERE len(v) >= {least}"


def _entropy(number: int, kind: str, window: int, bits: float) -> str:
    rows = _placed(f"SELECT r, {_found(_SETS[kind] + f'{{{window},}}', 0)} FROM d")
    return f"""SELECT r, {number} AS k, '{kind}' AS kind, min(pos) AS a, max(pos) + {window} AS z, any_value(off) AS off
FROM (SELECT *, sum(new) OVER (PARTITION BY r, i ORDER BY pos) AS island FROM (
  SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY r, i ORDER BY pos) <= {window} THEN 0 ELSE 1 END AS new FROM (
    SELECT r, i, a + p - 1 AS pos, regexp_full_match(s, '{_WHOLE}') OR regexp_matches(s, '{_PART}') AS off,
      list_sum(list_transform(map_values(list_histogram(string_split(substr(s, p, {window}), ''))), lambda c: round(c * log2(c) * 1048576)::BIGINT)) AS h
    FROM (SELECT *, unnest(range(1, len(s) - {window} + 2)) AS p FROM ({rows})))
  WHERE h <= floor((log2({window}) - {bits}) * {window} * 1048576)))
GROUP BY r, i, island"""


SECRETS = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_form(i, k) for i, k in enumerate(BASE_KINDS))}),
e AS ({" UNION ALL ".join(_entropy(i + 3, c.name, c.window, c.bits) for i, c in enumerate(CLASSES))}),
s AS (SELECT r, k, kind, a, z FROM f UNION ALL SELECT r, k, kind, a, z FROM e WHERE NOT off),
t AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k, z) FILTER (k < 3) AS base,
  string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k, z) AS spans FROM s GROUP BY r),
o AS (SELECT r, count(*) AS n FROM e WHERE off GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0)::BIGINT AS n_suppressed
FROM d LEFT JOIN t USING (r) LEFT JOIN o USING (r)"""


def _assigned(round_: int) -> str:
    return f"""a{round_} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(far) // 16 AS distance, min(far) % 16 AS c
  FROM (SELECT r, vec_id, v, 16 * list_sum(list_transform(list_zip(v, u), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT + c AS far
        FROM q, c{round_}) GROUP BY r)"""


def _moved(round_: int) -> str:
    return f"""c{round_ + 1} AS MATERIALIZED (SELECT c, coalesce(w, u) AS u FROM c{round_} LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS w
  FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{round_}) GROUP BY c, i)
  GROUP BY c) USING (c))"""


CLUSTERS = f"""
WITH q AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::BIGINT AS c, v AS u FROM (
  SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM q ORDER BY h, v LIMIT 16)),
{", ".join(f"{_assigned(i)}, {_moved(i)}" for i in range(3))}, {_assigned(3)}
SELECT vec_id, c::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(u, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (c)"""
