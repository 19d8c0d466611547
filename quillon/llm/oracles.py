"""DuckDB statements of the corpus queries that SQL can express, by plain comparison of everything."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, source FROM documents),
w AS (SELECT *, {_WORDS.format("t")} AS ws FROM d),
g AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, range(3) t(k) WHERE c > 1 GROUP BY rid),
l AS (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT *, {_WORDS.format("line")} AS lw FROM l),
v AS (SELECT rid, source, t, line, len(lw) AS k, regexp_replace({_LOW.format("array_to_string(lw, ' ')")}, '[0-9]', '0', 'g') AS norm FROM n WHERE len(lw) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM v GROUP BY rid),
bad AS (SELECT source, norm FROM v GROUP BY source, norm HAVING count(DISTINCT t) > 10),
lost AS (SELECT rid, sum(k) AS n FROM v WHERE EXISTS (SELECT 1 FROM bad b WHERE b.source IS NOT DISTINCT FROM v.source AND b.norm = v.norm) GROUP BY rid),
a AS (SELECT w.*, len(ws) AS n_words, coalesce(rep.n, 0) AS n_repeat_words, coalesce(dup.n, 0) AS n_dup_lines, coalesce(lost.n, 0) AS gone
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND n_words - gone >= 0.3 * n_words AS kept, gone::BIGINT AS boilerplate_words
FROM b
"""

OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = w.doc_id
"""

OP10_SQL = f"""
WITH l AS (SELECT doc_id, k, {_WORDS.format(_LOW.format("line"))} AS ws FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents)),
e AS (SELECT * FROM l WHERE len(ws) >= 3),
s AS (SELECT DISTINCT doc_id, k, unnest(ws) AS g FROM e),
n AS (SELECT doc_id, k, count(*) AS n FROM s GROUP BY doc_id, k),
m AS (SELECT DISTINCT b.doc_id, b.k FROM s a JOIN s b ON a.g = b.g AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.k < b.k) JOIN n x ON x.doc_id = a.doc_id AND x.k = a.k JOIN n y ON y.doc_id = b.doc_id AND y.k = b.k
  GROUP BY a.doc_id, a.k, b.doc_id, b.k, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id, count(*) AS n, string_agg(k::VARCHAR, ',' ORDER BY k) AS ks FROM m GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(ks, '')) AS removed_sha256 FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)
"""

#: crc32 of a string: ``crc_table`` has the 256 values of a byte as one list.
_CRC_TABLE = """crc_step AS (SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)),
crc_table AS (SELECT list(v ORDER BY i) AS vs FROM crc_step)"""


def _crc(text: str, table: str = "vs") -> str:
    """DuckDB expression of the unsigned crc32 of a string that has characters."""
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])))"


OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT g.*, {_crc("name")} % 20 AS how FROM g, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE how <> 0),
o AS (SELECT *, row_number() OVER w AS i, left(role, 1) AS f, lag(left(role, 1)) OVER w AS p FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
x AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM s),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (p IS NOT NULL AND p || f NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES ('', '', '', 0, []::VARCHAR[]), ('s', 's', '', 0, []), ('u', 'u', '', 0, []), ('a', 'a', '', 0, []), ('', 'u', 'I', 3, ['user:']), ('', 'a', 'II', 6, ['user:', 'assistant:']), ('s', 'u', 'I', 3, ['user:']), ('s', 'a', 'II', 6, ['user:', 'assistant:']),
  ('u', 'a', 'I', 3, ['assistant:']), ('a', 'u', 'I', 3, ['user:'])) t(a, b, audit, cost, made)),
-- from the state b over a row: what it may be made of
arcs AS (SELECT b, c, edit, cost FROM (VALUES ('', '', 'D', 4), ('s', 's', 'D', 4), ('u', 'u', 'D', 4), ('a', 'a', 'D', 4), ('', 's', 'K', 0), ('', 'u', 'K', 0), ('s', 'u', 'K', 0), ('u', 'a', 'K', 0), ('a', 'u', 'K', 0), ('', 'u', 'R', 3), ('s', 'u', 'R', 3), ('u', 'a', 'R', 3), ('a', 'u', 'R', 3)) t(b, c, edit, cost)),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS state, {{'cost': 0::BIGINT, 'audit': '', 'made': []::VARCHAR[]}} AS best FROM n
  UNION ALL
  SELECT conv_id, i, c, min({{'cost': total, 'audit': audit, 'made': made}}) FROM (
    SELECT x.conv_id, x.i, arcs.c, w.best.cost + ins.cost + arcs.cost + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS total, w.best.audit || ins.audit || edit AS audit,
      list_concat(list_concat(w.best.made, ins.made), CASE edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [CASE arcs.c WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] END) AS made
    FROM walk w JOIN x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1 JOIN ins ON ins.a = w.state JOIN arcs ON arcs.b = ins.b AND (edit <> 'K' OR arcs.c = f) AND (edit = 'D' OR fault IN ('', 'truncated')))
  GROUP BY conv_id, i, c),
e AS (SELECT n.conv_id, min({{'cost': w.best.cost + ins.cost, 'audit': w.best.audit || ins.audit, 'made': list_concat(w.best.made, ins.made)}}) AS best
  FROM walk w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i JOIN ins ON ins.a = w.state AND ins.b IN ('', 'a') GROUP BY n.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_RUNS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH {_CRC_TABLE},
w AS (SELECT row_number() OVER () AS rid, doc_id, md5(coalesce(text, '')) AS tie, {_RUNS.format(_LOW.format("coalesce(text, '')"))} AS ws FROM documents),
v AS (SELECT {_RUNS.format(_LOW.format("coalesce(text, '')"))} AS ws FROM benchmark),
fd AS (SELECT rid, unnest(ws) AS f FROM w UNION ALL SELECT rid, ws[i] || ' ' || ws[i + 1] FROM (SELECT rid, ws, unnest(range(1, len(ws))) AS i FROM w)),
ft AS (SELECT unnest(ws) AS f FROM v UNION ALL SELECT ws[i] || ' ' || ws[i + 1] FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM v)),
names AS (SELECT f, {_crc("f")} % 10000 AS b FROM (SELECT f FROM fd UNION SELECT f FROM ft), crc_table),
bd AS (SELECT b, count(*) AS n FROM fd JOIN names USING (f) GROUP BY b),
bt AS (SELECT b, count(*) AS n FROM ft JOIN names USING (f) GROUP BY b),
gain AS (SELECT i AS b, floor(1000 * ln((coalesce(bt.n, 0)::DOUBLE + 1) * ((SELECT count(*) FROM fd)::DOUBLE + 10000) / ((coalesce(bd.n, 0)::DOUBLE + 1) * ((SELECT count(*) FROM ft)::DOUBLE + 10000))))::BIGINT AS g
  FROM range(10000) t(i) LEFT JOIN bd ON bd.b = i LEFT JOIN bt ON bt.b = i),
m AS (SELECT rid, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM fd JOIN names USING (f) JOIN gain USING (b) GROUP BY rid),
s AS (SELECT rid, doc_id, tie, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN m USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, tie) AS rank FROM s WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 25 // 100 FROM r) THEN rank END AS rank FROM s LEFT JOIN r USING (rid)
"""
