"""SQL of the conversation repair: the cheapest edits row by row from the end, written apart from the operator.

A label is the cost in nine digits and then the audit, so labels compare like
(cost, audit); beside it stand the repaired turns. There is one for each state:
nothing yet, after s, after a user, after an assistant.
"""

from __future__ import annotations


def _more(state: str, cost: str, letter: str, turn: str | None = None) -> str:
    turns = f"list_prepend({turn}, {state}.t)" if turn else f"{state}.t"
    label = f"lpad((substr({state}.l, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({state}.l, 10)"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'l': {label}, 't': {turns}}} END"


def _least(*labels: str) -> str:
    return f"list_sort(list_filter([{', '.join(labels)}], lambda x: x IS NOT NULL))[1]"


def _row(state: int) -> str:
    """Labels before a row, from the states s0 … s3 after it."""
    role, after = ("assistant", 3) if state == 2 else ("user", 2)
    kept = _more(f"s{after}", "extra", "K", "role || ':' || text")
    given = _more(f"s{after}", "3 + extra", "R", f"'{role}:' || text")
    out = [_more(f"s{state}", "4", "D"), f"CASE WHEN stays AND initial = '{role[0]}' THEN {kept} END", f"CASE WHEN stays THEN {given} END"]
    if state == 0:
        out.append(f"CASE WHEN stays AND initial = 's' THEN {_more('s1', 'extra', 'K', chr(39).join(['role || ', ':', ' || text']))} END")
    return _least(*out)


def _inserted(source: str) -> str:
    user, assistant = _more("s2", "3", "I", "'user:'"), _more("s3", "3", "I", "'assistant:'")
    columns = [_least(f"s{q}", assistant if q == 2 else user) + f" AS s{q}" for q in range(4)]
    return f"SELECT g, i, {', '.join(columns)} FROM ({source})"


_NONE = "NULL::STRUCT(l VARCHAR, t VARCHAR[])"
_END = "{'l': '000000000', 't': []::VARCHAR[]}"
_FIRST = _inserted(_inserted(f"SELECT g, n AS i, {_END} AS s0, {_NONE} AS s1, {_NONE} AS s2, {_END} AS s3 FROM c"))
_NEXT = _inserted(_inserted(f"SELECT dp.g, dp.i - 1 AS i, {', '.join(f'{_row(q)} AS s{q}' for q in range(4))} FROM dp JOIN r ON r.g = dp.g AND r.i = dp.i"))

REPAIR = rf"""
WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS tab),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: xor(c // 256, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM conversations, k),
o AS MATERIALIZED (SELECT row_number() OVER () AS g, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
m AS (SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM h JOIN o ON h.conv_id IS NOT DISTINCT FROM o.conv_id WHERE kind <> 0),
p AS (SELECT *, row_number() OVER w AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS mark, substr(role, 1, 1) AS initial,
    lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS pair
  FROM m WINDOW w AS (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text))),
a AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again FROM p),
r AS MATERIALIZED (SELECT *, CASE WHEN mark = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN mark NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    NOT (mark = '' OR again) AS stays, CASE WHEN mark IN ('.', '!', '?') THEN 0 ELSE 3 END AS extra FROM a),
c AS MATERIALIZED (SELECT o.g, any_value(o.conv_id) AS conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM o LEFT JOIN r USING (g) GROUP BY o.g),
dp AS ({_FIRST} UNION ALL {_NEXT})
SELECT conv_id, gaps::BIGINT AS gaps, blank::BIGINT AS blank, duplicate::BIGINT AS duplicate, truncated::BIGINT AS truncated, illegal::BIGINT AS illegal,
  substr(s0.l, 1, 9)::BIGINT AS cost, substr(s0.l, 10) AS audit, sha256(array_to_string(s0.t, chr(10))) AS repaired_sha256
FROM dp JOIN c USING (g) WHERE i = 0"""
