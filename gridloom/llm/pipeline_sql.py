"""DuckDB SQL for the rows of the corpus pipeline, from the SQL of its operators.

Rows are numbered once; every stage's SQL then reads the stage before in the
place of ``documents``, inside a subquery of its own.
"""

from __future__ import annotations

from . import line_rules, mixing, oracle

_ROW = "row_number() OVER ()"


def _stage(sql: str, source: str, old: str, new: str) -> str:
    """A query's SQL that reads ``source`` and ends in another SELECT."""
    sql = sql.replace(_ROW, "rid", 1).replace("FROM documents", f"FROM {source}", 1)
    head, found, _ = sql.rpartition(old)
    assert found, old
    return head + new


_RULES = _stage(oracle.LINE_RULES, "s0", "FROM m", "FROM m").replace("SELECT doc_id, n_words,", "SELECT rid, n_words,")
#: Kept rows without the lines that go: those of the lines' own counts in LINE_RULES.
_LEFT = f"""
WITH d AS (SELECT rid, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM s0),
al AS (SELECT rid, doc_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
ln AS (SELECT rid, doc_id, host, pos, regexp_extract_all({oracle._LOWER.format("line")}, '[^\\x20\\x09-\\x0D]+') AS lw FROM al WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
content AS (SELECT rid, list_aggregate(regexp_extract_all({oracle._LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), 'string_agg', ' ') AS body FROM d),
ab AS (SELECT host, lw, min(doc_id) AS first FROM ln JOIN content USING (rid) GROUP BY host, lw HAVING count(DISTINCT body) > {line_rules.MAX_DOCS}),
gone AS (SELECT rid, pos FROM ln JOIN ab ON ln.host = ab.host AND ln.lw = ab.lw WHERE ln.doc_id IS DISTINCT FROM ab.first)
SELECT rid, string_agg(line, chr(10) ORDER BY pos) AS left_text FROM al ANTI JOIN gone USING (rid, pos) GROUP BY rid
"""
_NEAR = _stage(oracle.near_dedup(5), "s1", "SELECT doc_id, CAST(", "SELECT min(d.r) AS rid FROM d JOIN c USING (r) WHERE doc_id IS NOT DISTINCT FROM component_id GROUP BY root")
_DIRTY = oracle.DECONTAMINATE.replace(_ROW, "rid", 1).replace("FROM documents", "FROM s2", 1).replace("SELECT doc_id, item_id, CAST(n_windows", "SELECT dr AS rid, CAST(n_windows")
_MIX = _stage(oracle.MIXING, "s3", "SELECT doc_id, source, size,", "SELECT r, n, quota, turn, x, size FROM u").replace("u AS (SELECT doc_id,", "u AS (SELECT r, doc_id,")

_PICKED = "(({} + turn) * (quota % n)) // n"
_WORDS = oracle._WORDS
PIPELINE = f"""
WITH s0 AS MATERIALIZED (SELECT {_ROW} AS rid, * FROM documents),
s1 AS MATERIALIZED (SELECT s0.* REPLACE (left_text AS text, length(left_text) AS n_chars) FROM s0 JOIN ({_LEFT}) USING (rid) WHERE rid IN (SELECT rid FROM ({_RULES}) WHERE kept)),
s2 AS MATERIALIZED (SELECT * FROM s1 WHERE rid IN ({_NEAR})),
s3 AS MATERIALIZED (SELECT * FROM s2 WHERE rid NOT IN (SELECT rid FROM ({_DIRTY}))),
tk AS MATERIALIZED (SELECT s3.*, m.* EXCLUDE (r), {_WORDS} AS ws FROM s3 JOIN ({_MIX}) m ON m.r = s3.rid WHERE size > 0),
bl AS (SELECT *, list_filter(range(x // {mixing.BLOCK}, (x + size - 1) // {mixing.BLOCK} + 1), lambda k: {_PICKED.format("k + 1")} > {_PICKED.format("k")}) AS blocks FROM tk),
pt AS (SELECT *, CASE WHEN len(blocks) = (x + size - 1) // {mixing.BLOCK} - x // {mixing.BLOCK} + 1 THEN text
       WHEN len(blocks) > 0 THEN array_to_string(flatten(list_transform(blocks, lambda k: ws[greatest(k * {mixing.BLOCK} - x, 0) + 1:least((k + 1) * {mixing.BLOCK} - x, size)])), ' ') END AS part FROM bl),
cp AS (SELECT doc_id, lang, source, text FROM pt, range(quota // n) UNION ALL SELECT doc_id, lang, source, part FROM pt WHERE part IS NOT NULL)
SELECT doc_id, text, lang, source, CAST(length(text) AS BIGINT) AS n_chars, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM cp
"""
