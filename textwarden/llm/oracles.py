"""SQL for the results of the exact corpus operators, in the checking engine's dialect."""

SUBSTRING = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
p AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
r AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS b FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
s AS (SELECT rid, i, sum(CASE WHEN b IS NULL OR i - b > 35 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS k FROM r),
g AS (SELECT rid, k, min(i) AS lo, max(i) + 35 AS hi FROM s GROUP BY rid, k),
f AS (SELECT rid, k, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY k), 1) AS from_w, lo AS to_w, hi FROM g),
e AS (SELECT rid, sum(hi - to_w) AS gone, max(hi) AS last, flatten(list(ws[from_w:to_w - 1] ORDER BY k)) AS head, any_value(ws) AS ws FROM f JOIN d USING (rid) GROUP BY rid)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN e.rid IS NULL THEN d.ws ELSE list_concat(head, e.ws[last:]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN e ON e.rid = d.rid
"""

SUFFIX = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(encode(text), ''::BLOB) AS bs FROM documents),
p AS (SELECT rid, i, hash(bs[i:i + 399]) AS h FROM (SELECT rid, bs, unnest(range(1, octet_length(bs) - 398)) AS i FROM d WHERE octet_length(bs) >= 400)),
r AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS b FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
s AS (SELECT rid, i, sum(CASE WHEN b IS NULL OR i - b > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS k FROM r),
g AS (SELECT rid, k, min(i) AS lo, max(i) + 400 AS hi FROM s GROUP BY rid, k),
f AS (SELECT rid, k, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY k), 1) AS from_b, lo AS to_b, hi FROM g),
e AS (SELECT rid, sum(hi - to_b) AS gone, count(*) AS n, max(hi) AS last, string_agg(CASE WHEN to_b > from_b THEN hex(bs[from_b:to_b - 1]) ELSE '' END, '' ORDER BY k) AS head FROM f JOIN d USING (rid) GROUP BY rid)
SELECT d.doc_id, octet_length(d.bs)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN e.rid IS NULL THEN d.bs ELSE unhex(head || CASE WHEN last > octet_length(d.bs) THEN '' ELSE hex(d.bs[last:]) END) END) AS kept_sha256
FROM d LEFT JOIN e ON e.rid = d.rid
"""

JACCARD = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
g AS (SELECT DISTINCT rid, md5(array_to_string(ws[i:i + 3], ' ')) AS h FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS k FROM g GROUP BY rid),
c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS both_have FROM g a JOIN g b ON a.h = b.h AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * both_have >= 85 * (nx.k + ny.k - both_have)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
t AS (SELECT rid AS x, rid AS y FROM d UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x)
SELECT d.doc_id, coalesce(n.k, 0)::BIGINT AS n_shingles, m.least AS component_id
FROM d LEFT JOIN n USING (rid) JOIN (SELECT t.x AS rid, min(o.doc_id) AS least FROM t JOIN d o ON o.rid = t.y GROUP BY t.x) m USING (rid)
"""

QUALITY_BASE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
w AS (SELECT rid, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM e WHERE len(ws) >= 3)),
r AS (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM w) WHERE c > 1),
n AS (SELECT rid, count(DISTINCT j) AS k FROM r GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(k, 0)::BIGINT AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(k, 0) > 50 * len(ws) AS base_failed
FROM e LEFT JOIN n USING (rid)
"""

#: A table of one row, crc_table: the 256 remainders of CRC-32, each by eight steps from its number.
CRC_TABLE = """(SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for i in range(256)] AS crc_table)"""


def crc32(text: str) -> str:
    """SQL: the unsigned CRC-32 of an ASCII string, where CRC_TABLE is joined."""
    chars = f"list_concat([4294967295::BIGINT], [ascii(x)::BIGINT for x in string_split({text}, '')])"
    return f"xor(list_reduce({chars}, lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1])), 4294967295)"


BAND = f"""
WITH l AS (SELECT sale_id, line_no, item_id AS line_item_id, quantity::BIGINT AS q, floor(100 * amount + 0.5)::BIGINT AS a FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity <> 0 AND amount IS NOT NULL),
n AS (SELECT *, (2 * a + q) * sign(q) AS above, 2 * abs(q) AS below FROM l),
c AS (SELECT sale_id, line_no::BIGINT AS line_no, line_item_id, ((above - ((above % below) + below) % below) // below)::BIGINT AS u, {crc32("concat(sale_id, ',', line_no, ',', line_item_id)")} AS crc FROM n, {CRC_TABLE}),
i AS (SELECT row_number() OVER () AS rid, item_id, floor(100 * price + 0.5)::BIGINT AS p FROM items),
b AS (SELECT rid, item_id, p, p - greatest(10, 2 * p // 1000) AS lo, p + greatest(10, 2 * p // 1000) AS hi FROM i WHERE p IS NOT NULL AND item_id IS NOT NULL),
j AS (SELECT rid, abs(u - p) AS gap, u, sale_id, line_no, line_item_id, crc FROM b JOIN c ON u BETWEEN lo AND hi AND line_item_id <> item_id WHERE abs(u - p) <= 10 OR 1000 * abs(u - p) <= 2 * p),
s AS (SELECT rid, count(*) AS n_pairs, sum(gap)::BIGINT AS gap_sum, sum(crc)::BIGINT AS lines_crc FROM j GROUP BY rid),
f AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id)::INT AS rank, gap, u, sale_id, line_no, line_item_id FROM j QUALIFY rank <= 5)
SELECT item_id, coalesce(rank, 0)::INT AS rank, gap, u, sale_id, line_no, line_item_id, coalesce(n_pairs, 0)::BIGINT AS n_pairs, coalesce(gap_sum, 0)::BIGINT AS gap_sum, coalesce(lines_crc, 0)::BIGINT AS lines_crc
FROM i LEFT JOIN s USING (rid) LEFT JOIN f USING (rid)
"""

RUNS = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws, {crc32("doc_id::VARCHAR")} AS h FROM documents, {CRC_TABLE}),
a AS (SELECT rid, doc_id, ws, h, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM t),
b AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
w AS (SELECT rid, unnest(range(n)) AS i, unnest(CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) END) AS x FROM b),
v AS (SELECT rid, i, hash(x) AS x FROM w),
pp AS (SELECT rid, n, unnest(range(1, n // 4 + 1)) AS p FROM a WHERE n >= 6),
g AS (SELECT rid, p, unnest(range(0, (n - 1) // p)) AS j FROM pp),
e AS (SELECT g.rid, g.p, g.j FROM g JOIN v l ON l.rid = g.rid AND l.i = g.j * g.p JOIN v r ON r.rid = g.rid AND r.i = (g.j + 1) * g.p WHERE l.x = r.x),
c AS (SELECT DISTINCT rid, p FROM (SELECT rid, p, j - row_number() OVER (PARTITION BY rid, p ORDER BY j) AS k FROM e) GROUP BY rid, p, k HAVING count(*) >= 3),
q AS (SELECT c.rid, c.p, l.i FROM c JOIN v l ON l.rid = c.rid JOIN v r ON r.rid = c.rid AND r.i = l.i + c.p WHERE l.x = r.x),
s AS (SELECT rid, p, min(i) AS s, count(*) + p AS len FROM (SELECT rid, p, i, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS k FROM q) GROUP BY rid, p, k HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (SELECT rid, s, len, min(p) AS p FROM s GROUP BY rid, s, len),
f AS (SELECT rid, count(*) AS n_runs, sha256(string_agg(concat(s, ',', len, ',', p, chr(10)), '' ORDER BY s, p)) AS runs_sha256, min(struct_pack(l := -len, s := s, p := p)) AS top FROM r GROUP BY rid),
o AS (SELECT DISTINCT w.rid, w.i FROM w JOIN r ON r.rid = w.rid AND w.i >= r.s + r.p AND w.i < r.s + r.len),
k AS (SELECT w.rid, sha256(string_agg(x, ' ' ORDER BY w.i)) AS collapsed_sha256 FROM w ANTI JOIN o ON o.rid = w.rid AND o.i = w.i GROUP BY w.rid)
SELECT a.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, -top.l::BIGINT AS length, top.p::BIGINT AS period, (1000 * -top.l // top.p)::BIGINT AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM a LEFT JOIN f USING (rid) LEFT JOIN k USING (rid)
"""
