"""SQL of the queries that SQL can express; written apart from the operators."""

from vouchermill.llm.repair_statement import REPAIR
from vouchermill.llm.scan_statements import CLUSTERS, SECRETS

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, '{WORD}') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOW}, '{WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
        FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, g FROM dw WHERE g IN (SELECT g FROM bw)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM h JOIN bw USING (g)) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


TOKENS = "len(regexp_extract_all(text, '[A-Za-z]+|[0-9]|[^ \\t\\n\\rA-Za-z0-9]')) + 4"
ESCAPED = r"replace(replace(replace({0}, '\', '\s'), '<', '\l'), '[', '\b')"

CHAT = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
p AS (SELECT *, {TOKENS} AS n, row_number() OVER w - 1 AS place,
    len({ESCAPED.format("role")}) + len({ESCAPED.format("text")}) + 13 AS size
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
o AS (SELECT *, place = 0 AND role = 'system' AS opening FROM p),
h AS (SELECT *, sum(CASE WHEN opening THEN n ELSE 0 END) OVER c AS head_n, sum(CASE WHEN opening THEN size ELSE 0 END) OVER c AS head_size,
    greatest(896 - sum(CASE WHEN opening THEN n ELSE 0 END) OVER c, 8) // 2 AS half,
    CASE WHEN opening THEN 0 ELSE n END AS cost FROM o WINDOW c AS (PARTITION BY conv_id)),
e AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY place) AS stop FROM h),
c AS (SELECT *, (stop - cost) // half AS cell, cost > half AS long FROM e),
k AS (SELECT *, CASE WHEN place > 0 AND NOT coalesce(lag(opening) OVER w, false)
    AND (cell <> lag(cell) OVER w OR long OR lag(long) OVER w) THEN 1 ELSE 0 END AS cut FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
v AS (SELECT *, sum(cut) OVER (PARTITION BY conv_id ORDER BY place) AS win FROM k),
a AS (SELECT *, max(stop) OVER (PARTITION BY conv_id, win) - (stop - cost) <= 128 AND NOT opening AS again,
    max(win) OVER (PARTITION BY conv_id) AS last_win FROM v)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(size) + coalesce(sum(size) FILTER (again AND win < last_win), 0) + max(head_size) * max(win))::BIGINT AS formatted_chars
FROM a GROUP BY conv_id"""

RECORD = (
    "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')"
    " || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || repeat(chr(13) || chr(10), 2) || coalesce(html, '')"
    " || repeat(chr(13) || chr(10), 2)"
)

FIXITY = f"""
WITH r AS (SELECT page_id, page_id // 500 + 1 AS archive, strlen({RECORD}) AS size,
    page_id % 5003 = 7 AS lost, page_id % 97 = 13 AND coalesce(html, '') <> '' AS hit FROM pages),
m AS (SELECT *, coalesce(sum(CASE WHEN lost THEN size ELSE 0 END) OVER
    (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM r),
s AS (SELECT *, CASE WHEN lost THEN 'missing' WHEN hit THEN 'altered' WHEN gap > 0 THEN 'moved' END AS status FROM m)
SELECT archive::BIGINT AS archive, count(*)::BIGINT AS n_records, sum(size)::BIGINT AS n_bytes, count(status) = 0 AS intact,
  count(*) FILTER (status = 'altered')::BIGINT AS n_altered, count(*) FILTER (status = 'missing')::BIGINT AS n_missing,
  count(*) FILTER (status = 'moved')::BIGINT AS n_moved,
  coalesce(string_agg(page_id || ':' || status, ',' ORDER BY page_id) FILTER (status IS NOT NULL), '') AS bad_records
FROM s GROUP BY archive"""


def statements() -> dict[str, str]:
    return {
        "op2_decontamination": CONTAMINATION, "op3_chat_windows": CHAT, "op4_fixity": FIXITY,
        "op11_secret_scan": SECRETS, "op12_turn_repair": REPAIR, "op13_centroids": CLUSTERS,
    }
