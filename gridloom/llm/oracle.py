"""DuckDB SQL that gives the rows of the queries, by plain relational means."""

from __future__ import annotations

from . import decontaminate, line_rules, mixing, sharding

_WORDS = "coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), [])"
#: A-Z alone are lower-cased.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
ln AS (SELECT rid, doc_id, host, line, regexp_extract_all({_LOWER.format("line")}, '[^\\x20\\x09-\\x0D]+') AS lw
       FROM (SELECT rid, doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY rid),
wd AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
tri AS (SELECT rid, i, w || ' ' || lead(w) OVER s || ' ' || lead(w, 2) OVER s AS g FROM wd WINDOW s AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
content AS (SELECT rid, list_aggregate(regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), 'string_agg', ' ') AS body FROM d),
ab AS (SELECT host, lw, min(doc_id) AS first FROM ln JOIN content USING (rid) GROUP BY host, lw HAVING count(DISTINCT body) > {line_rules.MAX_DOCS}),
lost AS (SELECT ln.rid, sum(len(ln.lw)) AS n FROM ln JOIN ab ON ln.host = ab.host AND ln.lw = ab.lw WHERE ln.doc_id IS DISTINCT FROM ab.first GROUP BY ln.rid),
m AS (SELECT rid, d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
      FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
       n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words) AND NOT n_removed_words > {line_rules.MAX_LOST} * n_words AS kept
FROM m
"""

_NUMBER = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
#: Which arrival a document comes with; versions follow each other from 1, one to an arrival.
SHARDING = f"""
WITH a AS (SELECT *, coalesce({_NUMBER.format(f"'{sharding.SEED}' || CAST(doc_id AS VARCHAR)")} % {sum(sharding.ARRIVALS)}, 0) AS x FROM documents),
b AS (SELECT *, {" + ".join(["1", *(f"CAST(x >= {sum(sharding.ARRIVALS[:k])} AS BIGINT)" for k in range(1, len(sharding.ARRIVALS)))])} AS n FROM a)
SELECT doc_id, source, lang, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, CAST(n AS BIGINT) AS arrival, CAST(n AS BIGINT) AS since FROM b
"""
MIXING = f"""
WITH d AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), tk || '/' || r) AS key FROM (SELECT row_number() OVER () AS r, doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, {_NUMBER.format("coalesce(text, '')")} AS tk FROM documents)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
s1 AS (SELECT *, 3 * source_size AS cap, [{", ".join(map(str, mixing.WEIGHTS))}][1 + (rk - 1) % {len(mixing.WEIGHTS)}] AS w FROM s),
s2 AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS op, row_number() OVER (ORDER BY cap / w, rk) AS place
       FROM s1 WINDOW b AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT coalesce(min_by(CAST(rest AS DOUBLE) / CAST(op AS DOUBLE), place), 0.0) AS lv FROM s2 WHERE rest * w <= cap * op),
s3 AS (SELECT source, source_size, rk, least(CAST(cap AS DOUBLE), lv * w) AS target FROM s2, lv),
sn AS (SELECT greatest(1, CAST(ceil(count(*) / {mixing.SHARD_ROWS}) AS BIGINT)) AS n FROM d),
s4 AS (SELECT s3.*, sn.n AS shards, greatest(1, least(CAST(floor(target / {mixing.BLOCK * mixing.SEATS}) AS BIGINT), sn.n)) AS spread, {_NUMBER.format(f"'{mixing.SEED}/source/' || rk")} % sn.n AS lead FROM s3, sn),
g AS (SELECT d.*, s4.source_size, s4.rk, s4.target, (lead + {_NUMBER.format(f"'{mixing.SEED}' || key")} % spread) % shards AS shard
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
st AS (SELECT shard, rk, (CAST(sum(size) AS BIGINT) + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS n, any_value(target) / any_value(source_size) AS f FROM g GROUP BY shard, rk HAVING sum(size) > 0),
tot AS (SELECT shard, CAST(floor(sum(f * n) + 0.5) AS BIGINT) AS seats FROM st GROUP BY shard),
q AS (SELECT shard, rk, row_number() OVER (PARTITION BY shard ORDER BY v / (2 * k + 1) DESC, rk) AS place FROM (SELECT shard, rk, f * n AS v, unnest(range({mixing.REPEATS} * n)) AS k FROM st)),
qq AS (SELECT q.shard, q.rk, count(*) AS quota FROM q JOIN tot USING (shard) WHERE place <= seats GROUP BY q.shard, q.rk),
p AS (SELECT g.*, coalesce(st.n, 1) AS n, coalesce(qq.quota, 0) AS quota, {_NUMBER.format(f"'{mixing.SEED}/' || g.shard || '/' || g.rk")} % coalesce(st.n, 1) AS turn,
      CAST(sum(size) OVER (PARTITION BY g.shard, g.rk ORDER BY {_NUMBER.format(f"'{mixing.SEED}/' || key")}, doc_id, tk, r ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
      FROM g LEFT JOIN st ON st.shard = g.shard AND st.rk = g.rk LEFT JOIN qq ON qq.shard = g.shard AND qq.rk = g.rk),
u AS (SELECT doc_id, source, size, source_size, target, n, quota, turn, e - size AS x, e FROM p)
SELECT doc_id, source, size, source_size, target, CAST(
  (quota // n) * size + (((e // {mixing.BLOCK} + turn) * (quota % n)) // n - ((x // {mixing.BLOCK} + turn) * (quota % n)) // n) * {mixing.BLOCK}
  + (((e // {mixing.BLOCK} + 1 + turn) * (quota % n)) // n - ((e // {mixing.BLOCK} + turn) * (quota % n)) // n) * (e % {mixing.BLOCK})
  - (((x // {mixing.BLOCK} + 1 + turn) * (quota % n)) // n - ((x // {mixing.BLOCK} + turn) * (quota % n)) // n) * (x % {mixing.BLOCK}) AS BIGINT) AS taken FROM u
"""



def near_dedup(k: int) -> str:
    """Brute force: every pair of rows that share a shingle of k words."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT r, s FROM (SELECT r, unnest(CASE WHEN len(ws) >= {k} THEN list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM d)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
pr AS (SELECT a.r AS x, b.r AS y, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
lk AS (SELECT x, y FROM pr JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
e AS (SELECT x, y FROM lk UNION ALL SELECT y, x FROM lk),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
c AS (SELECT x AS r, min(doc_id) AS component_id, min(reach.y) AS root FROM reach JOIN d ON d.r = reach.y GROUP BY x)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""


NEAR_DEDUP = near_dedup(2)

_TRIM = "list_filter(list_transform({}, lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda x: x <> '')"
_UNITS = "|".join(decontaminate.UNITS)
_KIND = f"""CASE WHEN regexp_full_match(x, '\\p{{Nd}}[\\p{{Nd}}.,:/]*({_UNITS})') THEN '<qty>' WHEN regexp_full_match(x, '\\p{{Nd}}[\\p{{Nd}}.,:/]*') THEN '<num>'
  WHEN regexp_full_match(x, '{_UNITS}') AND regexp_full_match(coalesce(prev, ''), '\\p{{Nd}}[\\p{{Nd}}.,:/]*') THEN '<unit>'"""
DECONTAMINATE = f"""
WITH src AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, {_TRIM.format(_WORDS)} AS ws FROM documents
             UNION ALL SELECT 'b', row_number() OVER (), item_id, {_TRIM.format(_WORDS)} FROM benchmark),
tk AS (SELECT side, r, id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM src),
tk1 AS (SELECT *, lag(x) OVER (PARTITION BY side, r ORDER BY i) AS prev FROM tk),
tk2 AS (SELECT side, r, id, i, lower(x) AS s, {_KIND} ELSE lower(x) END AS t1, {_KIND} WHEN regexp_matches(x, '^\\p{{Lu}}') THEN '<name>' ELSE lower(x) END AS t2 FROM tk1),
win AS (SELECT side, r, id, i, list(s) OVER w AS s, list(t1) OVER w AS t1, list(t2) OVER w AS t2 FROM tk2 WINDOW w AS (PARTITION BY side, r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
w5 AS (SELECT side, r, id, i, 1 AS form, s, t1 AS t FROM win WHERE len(s) = 5 UNION ALL SELECT side, r, id, i, 2, s, t2 FROM win WHERE len(s) = 5 AND list_contains(t2, '<name>')),
bw AS (SELECT * FROM w5 WHERE side = 'b' AND len(list_filter(t, lambda x: NOT starts_with(x, '<'))) >= {decontaminate.LITERALS}),
bn AS (SELECT r, count(DISTINCT i) AS n_windows FROM bw GROUP BY r),
m AS (SELECT DISTINCT d.r AS dr, d.id AS doc_id, b.r AS br, b.id AS item_id, b.i, list_filter(list_transform(range(1, 6), lambda k: {{'kind': b.t[k], 'a': b.s[k], 'b': d.s[k]}}), lambda p: starts_with(p.kind, '<')) AS pairs
      FROM w5 d JOIN bw b ON d.form = b.form AND d.t = b.t WHERE d.side = 'd'),
vg AS (SELECT r, id, list_transform(ws, lambda x: lower(x)) AS ws FROM src WHERE side = 'b' AND len(ws) > 0 AND r NOT IN (SELECT r FROM bn)),
ex AS (SELECT dr, doc_id, br, item_id, 1 AS n_windows, 1 AS n_matched FROM (SELECT d.r AS dr, d.id AS doc_id, vg.r AS br, vg.id AS item_id, list_transform(d.ws, lambda x: lower(x)) AS ds, vg.ws AS v FROM src d, vg WHERE d.side = 'd' AND len(d.ws) >= len(vg.ws))
       WHERE CASE WHEN len(v) < {decontaminate.ANYWHERE} THEN ds = v ELSE len(list_filter(range(1, len(ds) - len(v) + 2), lambda i: ds[i:i + len(v) - 1] = v)) > 0 END),
cand AS (SELECT dr, br FROM m JOIN bn ON bn.r = m.br GROUP BY dr, br, n_windows HAVING {decontaminate.PARTS} * count(DISTINCT i) >= {decontaminate.SHARE} * n_windows),
mc AS (SELECT m.* FROM m JOIN cand USING (dr, br)),
pr AS (SELECT dr, br, p.kind AS kind, p.a AS a, p.b AS b, count(*) AS c FROM (SELECT dr, br, unnest(pairs) AS p FROM mc) GROUP BY ALL),
best AS (SELECT dr, br, kind, a, arg_max(b, c || ' ' || b) AS b FROM (SELECT dr, br, kind, a, b, lpad(CAST(c AS VARCHAR), 12, '0') AS c FROM pr) GROUP BY ALL),
bad AS (SELECT DISTINCT x.dr, x.br, x.i, x.pairs FROM (SELECT dr, br, i, pairs, unnest(pairs) AS p FROM mc) x JOIN best ON best.dr = x.dr AND best.br = x.br AND best.kind = x.p.kind AND best.a = x.p.a WHERE best.b <> x.p.b),
ok AS (SELECT mc.* FROM mc LEFT JOIN bad ON bad.dr = mc.dr AND bad.br = mc.br AND bad.i = mc.i AND bad.pairs = mc.pairs WHERE bad.dr IS NULL),
md AS (SELECT dr, doc_id, item_id, n_windows, count(DISTINCT i) AS n_matched FROM ok JOIN bn ON bn.r = ok.br GROUP BY dr, doc_id, br, item_id, n_windows HAVING {decontaminate.PARTS} * count(DISTINCT i) >= {decontaminate.SHARE} * n_windows
       UNION ALL SELECT dr, doc_id, item_id, n_windows, n_matched FROM ex)
SELECT doc_id, item_id, CAST(n_windows AS BIGINT) AS n_windows, CAST(n_matched AS BIGINT) AS n_matched FROM md
"""
