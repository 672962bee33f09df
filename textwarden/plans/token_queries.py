"""Queries on token windows and on decoded token rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textwarden.operators import tokens
from textwarden.plans.common import Query, dealt

_MOST = 2000


def _documents(t):
    return dealt(t("documents").select("doc_id", "text"))


def _windows(t, spark):
    d = t("documents").select("doc_id", "text")
    w = tokens.windows(tokens.encode(_documents(t), tokens.vocabulary(d, _MOST)), "doc_id")
    return w.selectExpr("doc_id", "token_start", "token_end", "char_start", "char_end", "attention", "md5(array_join(input_ids, ',')) AS ids_md5", "md5(part) AS part_md5")


#: A row for each token: its row's number, place, id and characters.
_TOKENS = rf"""d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents WHERE text IS NOT NULL),
    p AS (SELECT rid, unnest(range(len(ps))) AS i, unnest(ps) AS piece FROM (SELECT rid, regexp_extract_all(text, '{tokens.PIECE}') AS ps FROM d)),
    v AS (SELECT piece, {tokens.FIRST} - 1 + row_number() OVER (ORDER BY count(*) DESC, piece) AS id FROM p GROUP BY piece QUALIFY row_number() OVER (ORDER BY count(*) DESC, piece) <= {_MOST}),
    q AS (SELECT rid, i, piece, (sum(length(piece)) OVER (PARTITION BY rid ORDER BY i) - length(piece))::BIGINT AS a FROM p),
    known AS (SELECT rid, i, 0 AS j, 0 AS k, id, a + CASE WHEN length(piece) > 1 AND piece[1] = ' ' THEN 1 ELSE 0 END AS a, a + length(piece) AS z FROM q JOIN v USING (piece)),
    chars AS (SELECT rid, i, a, unnest(range(length(piece))) AS j, unnest(string_split(piece, '')) AS c FROM q ANTI JOIN v USING (piece)),
    bytes AS (SELECT rid, i, j, k, {tokens.BYTE} + ('0x' || substr(hex(encode(c)), 2 * k + 1, 2))::INT AS id, a + j AS a, a + j + 1 AS z FROM (SELECT *, unnest(range(strlen(c))) AS k FROM chars)),
    s AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i, j, k) - 1 AS n FROM (SELECT * FROM known UNION ALL SELECT * FROM bytes)),
    l AS (SELECT d.rid, doc_id, text, coalesce(list(id ORDER BY n) FILTER (WHERE id IS NOT NULL), []) AS ids, list(a ORDER BY n) AS starts, list(z ORDER BY n) AS ends FROM d LEFT JOIN s USING (rid) GROUP BY d.rid, doc_id, text)"""

_STEP = tokens.CONTENT - tokens.SHARED
_WINDOWS = rf"""WITH {_TOKENS},
    o AS (SELECT *, len(regexp_extract_all(text, '[^\x09-\x0D\x20]+')) < {tokens.SHORT} OR len(ids) <= {tokens.CONTENT} AS one FROM l),
    w AS (SELECT *, unnest(range(0, CASE WHEN one THEN 1 ELSE (ceil((len(ids) - {tokens.CONTENT}) / {_STEP}.0) * {_STEP} + 1)::BIGINT END, {_STEP})) AS f FROM o),
    e AS (SELECT *, least(f + {tokens.CONTENT}, len(ids)) AS t FROM w),
    c AS (SELECT *, CASE WHEN one OR f = 0 THEN 0 ELSE starts[f + 1] END AS ca, CASE WHEN one THEN length(text) ELSE ends[t] END AS cz FROM e)
    SELECT doc_id, f AS token_start, t AS token_end, ca AS char_start, cz AS char_end, t - f + 2 AS attention, md5(substring(text, ca + 1, cz - ca)) AS part_md5,
      md5(array_to_string(list_concat([{tokens.BEFORE}], ids[f + 1:t], [{tokens.AFTER}], [{tokens.PAD} for x in range({tokens.CONTENT} - t + f)]), ',')) AS ids_md5 FROM c"""


def _rebuilt(t, spark):
    d = t("documents").select("doc_id", "text")
    w = tokens.windows(tokens.encode(_documents(t), tokens.vocabulary(d, 300)), "doc_id")
    return tokens.rebuilt(w, "doc_id").selectExpr("doc_id", "md5(text) AS text_md5")


def _decoded(t, spark):
    """Token rows of labelled documents, as a tokenised split holds them, decoded to candidates."""
    pieces = tokens.vocabulary(t("documents"), _MOST)
    rows = tokens.encode(_documents(t).join(t("labels").select("doc_id", "quality", "toxic"), "doc_id"), pieces)
    rows = rows.withColumn("ids", F.expr(f"concat(array({tokens.BEFORE}), ids, array({tokens.AFTER}, {tokens.PAD}))"))
    kept = rows.selectExpr("doc_id", "ids", "CASE quality WHEN 0 THEN ' Risky' ELSE '' END AS risk", "toxic AS label")
    told = tokens.decode(kept, pieces, "doc_id").join(kept.drop("ids"), "doc_id")
    return tokens.candidates(told, "doc_id").selectExpr("doc_id", "start", "`end` AS stop", "true_type", "is_phi", "md5(text) AS text_md5")


_DECODED = r"""SELECT doc_id, 0 AS start, length(x) AS stop, CASE WHEN phi THEN 'ACCOUNT' ELSE 'NONE' END AS true_type, phi::INT AS is_phi, md5(x) AS text_md5
    FROM (SELECT doc_id, regexp_replace(text, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') AS x, CASE WHEN quality = 0 THEN true ELSE coalesce(toxic, 0) > 0 END AS phi FROM documents JOIN labels USING (doc_id)) WHERE x <> ''"""


def _token_hits(t, spark):
    """At signs, marked as tokens of windows and mapped back to the text."""
    pieces = tokens.vocabulary(t("documents"), 300)
    # a text without the sign has no such token, so it isn't encoded; the vocabulary is that of all texts
    w = tokens.windows(tokens.encode(dealt(t("documents").select("doc_id", "text").where("contains(text, '@')")), pieces), "doc_id", short=0)
    # bound once for each window: named in the lambda of the tokens, the part would be cut out of the text for each of them
    at = "filter(sequence(0, size(x.starts) - 1), i -> substring(x.part, x.starts[i] - x.char_start + 1, 1) = '@')"
    hits = f"transform(array(struct(part, starts, char_start)), x -> transform({at}, i -> struct(i AS first, i + 1 AS last, 'at' AS class)))[0]"
    marked = w.where("contains(part, '@') AND size(starts) > 0").withColumn("hits", F.expr(hits))
    return tokens.spans_of_tokens(marked, "doc_id").selectExpr("doc_id", "cast(size(spans) AS bigint) AS n", "cast(aggregate(spans, 0, (x, s) -> x + s.start) AS bigint) AS start_sum")


_TOKEN_HITS = "SELECT doc_id, count(*) AS n, sum(a)::BIGINT AS start_sum FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS a FROM documents WHERE contains(text, '@')) WHERE c = '@' GROUP BY doc_id"


QUERIES = {
    "token_windows": Query(_windows, _WINDOWS),
    "token_windows_rebuilt": Query(_rebuilt, "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL"),
    "decoded_candidates": Query(_decoded, _DECODED),
    "token_hit_spans": Query(_token_hits, _TOKEN_HITS),
}
