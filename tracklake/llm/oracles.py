"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from tracklake.llm import fixity, mixing, sharding, vector_codes

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP1 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS t
        FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM bw)),
ks AS (SELECT DISTINCT k FROM win),
probe AS (SELECT rid, s, k, array_to_string(w[s:s + k - 1], ' ') AS t
          FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT rid, s, probe.k AS k, item FROM probe JOIN win ON probe.t = win.t AND probe.k = win.k),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
          FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid)
"""

OP3 = rf"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size,
         sha256('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS mix_key FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight FROM s),
steps AS (
  SELECT a.source, a.source_size, a.weight,
         ({mixing.SHARE} * (SELECT sum(source_size) FROM w)
          - {mixing.CAP} * coalesce((SELECT sum(b.source_size) FROM w b WHERE b.source_size / b.weight < a.source_size / a.weight), 0))
         / (SELECT sum(b.weight) FROM w b WHERE b.source_size / b.weight >= a.source_size / a.weight) AS level
  FROM w a),
rest AS (SELECT max(level) AS level FROM steps WHERE {mixing.CAP} * source_size > level * weight),
t AS (SELECT source, source_size, CASE WHEN {mixing.CAP} * source_size <= steps.level * weight THEN {mixing.CAP} * source_size ELSE rest.level * weight END AS target
      FROM steps, rest),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY mix_key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start,
             round(t.target) AS budget
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(budget / source_size) ELSE 0 END AS epochs FROM x)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken
FROM e
"""


def _op7() -> str:
    shards = sharding.shard_names(64)
    owner = sharding.lookup_table(shards)
    return f"""
SELECT doc_id, shard_slot, (SELECT {shards!r})[({owner!r})[shard_slot + 1] + 1] AS shard
FROM (SELECT doc_id, CAST(CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {len(owner)} AS INTEGER) AS shard_slot FROM documents)
"""


_RECORD = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || record || '>' || chr(13) || chr(10)
 || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
 || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""

OP9 = f"""
WITH p AS (SELECT coalesce(page_id, {fixity.NO_ID}) AS record, url, html FROM pages),
l AS (SELECT record, strlen({_RECORD}) AS length, sha256({_RECORD}) AS digest, html,
             CAST('0x' || substr(md5('fault:' || record), 1, 4) AS INTEGER) AS draw FROM p),
o AS (SELECT *, CAST(floor(record / {float(fixity.RECORDS_PER_FILE)}) AS BIGINT) AS file FROM l),
f AS (SELECT *, CAST(sum(length) OVER (PARTITION BY file ORDER BY record, digest ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset" FROM o),
e AS (SELECT *, max("offset" + length) OVER (PARTITION BY file) AS file_end FROM f)
SELECT record, file, "offset", length, digest,
       CASE WHEN draw % 128 = 2 THEN 'missing' WHEN draw % 64 = 1 AND ascii(coalesce(html, '')) BETWEEN 1 AND 127 THEN 'changed'
            WHEN draw % 128 = 3 THEN 'moved' ELSE 'sound' END AS status
FROM e
UNION ALL
SELECT -2 - record, file, CAST("offset" + 2 * file_end AS BIGINT), length, sha256(digest), 'added' FROM e WHERE draw % 128 = 4 AND record >= 0
"""

_SAID = r"\### Assistant: </turn> ok"
_ESCAPED = r"replace(replace(coalesce({}, ''), '\', '\\'), '<', '\l')"

OP10 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, sha256(text))) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(2 + length({_ESCAPED.format('role')}) + 3 + length({_ESCAPED.format('text')}) + 8) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP11 = """
WITH w AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS text,
                  list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             [len(words) < 200,
              100 * len(list_distinct(words)) < 50 * len(words),
              100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
              regexp_matches(text, '[#$%&*|]'),
              coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
b AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, 15 - a.i - b.i - c.i - d.i] AS filters FROM letters a, letters b, letters c, letters d
           WHERE len(list_distinct([a.i, b.i, c.i, d.i])) = 4),
s AS (SELECT filters, array_to_string(list_transform(filters, lambda x: chr(CAST(64 + x AS INTEGER))), '') AS filter_order, i AS step, filters[i] AS own, filters[:i - 1] AS earlier FROM orders, letters),
x AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS failed, list_bool_or(list_transform(earlier, lambda e: fails[e])) IS TRUE AS gone,
             list_sum(list_transform(fails, lambda y: CAST(y AS INTEGER))) AS failures
      FROM b, s),
y AS (SELECT part, filter_order, step, own,
             coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS kept,
             coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS removed,
             coalesce(sum(n) FILTER (failed AND gone), 0) AS redundant,
             coalesce(sum(n) FILTER (failed AND failures = 1), 0) AS unique_fails,
             coalesce(sum(good) FILTER (failed AND NOT gone), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (failed AND NOT gone), 0) AS toxic_lost
      FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM y
"""



def _op13() -> str:
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    assign = lambda books, name: f"""{name} AS (SELECT vec_id, row_no, part, entry, distance FROM (
  SELECT v.vec_id, v.row_no, v.part, b.entry, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance,
         row_number() OVER (PARTITION BY v.row_no, v.part ORDER BY distance, b.entry) AS place
  FROM p v JOIN {books} b ON v.part = b.part) WHERE place = 1)"""  # noqa: E731
    move = lambda books, assigned, name: f"""{name}m AS (SELECT part, entry, position, sum(c) AS s, count(*) AS n FROM (
  SELECT p.part, a.entry, unnest(p.x) AS c, unnest(range(len(p.x))) AS position FROM p JOIN {assigned} a ON p.row_no = a.row_no AND p.part = a.part) GROUP BY ALL),
{name}n AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY position) AS x FROM {name}m GROUP BY part, entry),
{name} AS (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM {books} b LEFT JOIN {name}n n ON b.part = n.part AND b.entry = n.entry)"""  # noqa: E731
    return f"""
WITH u AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row_no,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
w AS (SELECT *, len(x) // {parts} AS width FROM u),
p AS (SELECT vec_id, row_no, part, x[part * width + 1:(part + 1) * width] AS x FROM (SELECT *, unnest(range({parts})) AS part FROM w)),
b0 AS (SELECT part, row_no - 1 AS entry, x FROM p WHERE row_no <= {entries} AND vec_id IS NOT NULL),
{assign('b0', 'a0')},
{move('b0', 'a0', 'b1')},
{assign('b1', 'a1')},
{move('b1', 'a1', 'b2')},
{assign('b2', 'a2')},
c AS (SELECT row_no, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(distance) AS error FROM a2 GROUP BY row_no),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT u.vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY u.label) AS BIGINT) AS label_error, codebooks_sha256
FROM u JOIN c ON u.row_no = c.row_no, h
"""


ORACLE = {"op1_decontamination": OP1, "op3_mixing": OP3, "op7_sharding": _op7(), "op9_fixity": OP9, "op10_chat": OP10, "op11_filter_audit": OP11, "op13_vector_codes": _op13()}
