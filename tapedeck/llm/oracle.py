"""DuckDB SQL for the queries that SQL can express.

op2 and op7 need the tokenizer, op3 and op9 XXH64, op5, op8 and op10 learnt models: these
are tested against brute-force versions in ``tests/llm``.
"""

from . import secrets, shards

DECONTAMINATION = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM x),
p AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
      FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
h AS (SELECT p.r, p.i, p.n, x.item_id FROM p JOIN x ON p.n = x.n AND p.phrase = x.phrase),
k AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, cast(item_id AS varchar) AS s FROM h) GROUP BY r),
-- near: laid at some place, seven terms (all of a shorter window) within one position of theirs
v AS (SELECT row_number() OVER () AS win, item_id, n, string_split(phrase, ' ') AS terms FROM x WHERE item_id IS NOT NULL),
vt AS (SELECT win, n, unnest(range(1, n + 1)) AS j, unnest(terms) AS term FROM v),
dw AS (SELECT r, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS word FROM d),
m AS (SELECT r, win, n, j, q - j + shift AS place FROM dw JOIN vt ON word = term, (VALUES (-1), (0), (1)) o(shift)),
g AS (SELECT DISTINCT r, win FROM (SELECT r, win FROM m GROUP BY r, win, place, n HAVING count(DISTINCT j) >= least(7, n))),
u AS (SELECT r, count(DISTINCT item_id) AS n_near FROM g JOIN v USING (win) GROUP BY r)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, cast(coalesce(k.n_hit, 0) AS bigint) AS n_hit, cast(coalesce(t.n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(t.n_items, 0) >= 2 AS contaminated, cast(coalesce(u.n_near, 0) AS bigint) AS n_near
FROM d LEFT JOIN k ON d.r = k.r LEFT JOIN t ON d.r = t.r LEFT JOIN u ON d.r = u.r
"""

SQL = {"op1_decontamination": DECONTAMINATION, "op4_sharding": shards.sql(), "op6_secrets": secrets.sql()}
