"""Queries on detectors, scores, spans and remediation."""

from __future__ import annotations

from pyspark.sql import functions as F

from textwarden.functions import patterns as P
from textwarden.functions import text as X
from textwarden.functions.dialect import CHECK, SPARK, Dialect, apply, nest
from textwarden.operators import remediate, scan, score, spans
from textwarden.plans.common import Query, dealt
from textwarden.sources.readers import unmarked

ALL = {p.name: p for p in P.STRONG + P.MEDIUM}
KB = (P.Pattern("kb:project", r"(?i)\bproject\s+[a-z]+\b", "strong"), P.Pattern("forbidden:onher", "(?i)onher", "strong"))


def _texts(t):
    """doc_id and text on all cores, with the columns that guards read."""
    return dealt(t("documents").select("doc_id", "text")).selectExpr("doc_id", "text", *[f"{e} AS {c}" for c, e in score.seen("text").items()])


def _flags(d: Dialect, table: dict[str, list[P.Pattern]], col: str = "text") -> dict[str, str]:
    return {f"f{i}": score.found(d, col, ps, score.SEEN) for i, ps in enumerate(table.values())}


def _count_by_name(table: dict[str, list[P.Pattern]]):
    """Documents with each detector: one scan, one row of sums, then a row per name."""
    names = list(table)

    def run(t, spark):
        sums = [F.expr(f"coalesce(sum(cast({e} AS int)), 0L)").alias(k) for k, e in _flags(SPARK, table).items()]
        rows = ", ".join(f"named_struct('name', {SPARK.q(n)}, 'n', f{i})" for i, n in enumerate(names))
        return _texts(t).agg(*sums).select(F.explode(F.expr(f"array({rows})")).alias("r")).select("r.*")

    one = "SELECT " + ", ".join(f"coalesce(sum({e}::INT), 0)::BIGINT AS {k}" for k, e in _flags(CHECK, table).items()) + " FROM documents"
    return Query(run, " UNION ALL ".join(f"SELECT {CHECK.q(n)} AS name, f{i} AS n FROM ({one})" for i, n in enumerate(names)))


def _pattern_sums(patterns: tuple[P.Pattern, ...]):
    ex = lambda d: {f"m{i}": d.count("text", p.regex) for i, p in enumerate(patterns) if not p.plain}

    def run(t, spark):
        rows = ", ".join(f"named_struct('name', {SPARK.q(patterns[int(k[1:])].name)}, 'place', {k[1:]}, 'n_matches', {k})" for k in ex(SPARK))
        return _texts(t).agg(*[F.expr(f"cast(sum({e}) AS bigint)").alias(k) for k, e in ex(SPARK).items()]).select(F.explode(F.expr(f"array({rows})")).alias("r")).select("r.*")

    one = "SELECT " + ", ".join(f"sum({e})::BIGINT AS {k}" for k, e in ex(CHECK).items()) + " FROM documents"
    return Query(run, " UNION ALL ".join(f"SELECT {CHECK.q(patterns[int(k[1:])].name)} AS name, {k[1:]}::INTEGER AS place, {k} AS n_matches FROM ({one})" for k in ex(CHECK)))


def _per_doc(**columns):
    """doc_id and expressions that a function of the dialect gives."""
    return Query(
        lambda t, spark: _texts(t).selectExpr("doc_id", *[f"{f(SPARK)} AS {n}" for n, f in columns.items()]),
        f"SELECT doc_id, {', '.join(f'{f(CHECK)} AS {n}' for n, f in columns.items())} FROM documents")


def _n(d: Dialect, ps, col: str = "text") -> str:
    kind = "cast({} AS int)" if d.spark else "({})::INT"
    return f"cast({' + '.join(kind.format(score.found(d, col, [p], score.SEEN)) for p in ps)} AS bigint)"


RULES = ("doc_id", "risk", "risk_score", "action", "decision", "critical", "n_triggers")


def _rules(prob: bool = False):
    def run(t, spark):
        d = dealt(t("documents").select("doc_id", "text")).select("doc_id", "text", F.expr("cast(pmod(doc_id * 37, 100) AS double) / 100").alias("pr"))
        return apply(d, score.levels(SPARK, "text", "pr" if prob else None)).selectExpr("doc_id", "risk", "risk_score", "action", "decision", "critical", "cast(size(triggers) AS bigint) AS n_triggers")

    src = "(SELECT doc_id, text, ((doc_id * 37) % 100)::DOUBLE / 100 AS pr FROM documents)"
    return Query(run, f"SELECT doc_id, risk, risk_score, action, decision, critical, len(triggers)::BIGINT AS n_triggers FROM ({nest(src, score.levels(CHECK, 'text', 'pr' if prob else None))})")


def _tiers():
    def run(t, spark):
        s = score.score(dealt(t("documents").select("doc_id", "text")))
        return s.groupBy("risk", "action").agg(F.count(F.lit(1)).alias("n"), F.sum("risk_score").cast("long").alias("score_sum"))

    return Query(run, f"SELECT risk, action, count(*) AS n, sum(risk_score)::BIGINT AS score_sum FROM ({nest('documents', score.levels(CHECK))}) GROUP BY 1, 2")


def _heuristic():
    def levels(d):
        flags = {n: score.found(d, "text", ps, score.SEEN) for n, ps in score.detectors().items()}
        return [{"risk": score.override_risk(d, "text", low=score.SEEN)}, {"score": f"cast({score.trigger_score('risk', flags)} AS int)"}]

    return Query(lambda t, spark: apply(_texts(t), levels(SPARK)).select("doc_id", "risk", "score"), f"SELECT doc_id, risk, score FROM ({nest('(SELECT doc_id, text FROM documents)', levels(CHECK))})")


def _entropy():
    def levels(d):
        best = f"array_max(transform(toks, k -> {d.entropy('k')}))" if d.spark else f"list_max(list_transform(toks, lambda k: {d.entropy('k')}))"
        return [{"toks": d.all_matches("text", P.TOKEN_RUN if d.spark else P.TOKEN)}, {"n_tokens": f"cast({d.size('toks')} AS bigint)", "max_entropy": f"round(coalesce({best}, 0), 6)"}, {"fires": f"max_entropy >= {P.TOKEN_BITS}"}]

    return Query(lambda t, spark: apply(dealt(t("documents").select("doc_id", "text")), levels(SPARK)).drop("text", "toks"), f"SELECT doc_id, n_tokens, max_entropy, fires FROM ({nest('(SELECT doc_id, text FROM documents)', levels(CHECK))})")


def _replaced(steps):
    return Query(
        lambda t, spark: apply(dealt(t("documents").select("doc_id", "text")), steps(SPARK, "text")).selectExpr("doc_id", f"md5({remediate.LAST}) AS text_md5", f"cast(length({remediate.LAST}) AS bigint) AS n_chars"),
        f"SELECT doc_id, md5({remediate.LAST}) AS text_md5, length({remediate.LAST})::BIGINT AS n_chars FROM ({nest('(SELECT doc_id, text FROM documents)', steps(CHECK, 'text'))})")


def _offsets(name: str):
    rx = ALL[name].regex

    def run(t, spark):
        d = t("documents").where(F.expr(SPARK.rx("text", rx)))
        return spans.find(d, ALL[name]).select("doc_id", F.explode("spans").alias("s")).selectExpr("doc_id", "cast(s.start AS bigint) AS start_at", "cast(s.end AS bigint) AS end_at", "s.match AS matched")

    return Query(run, f"SELECT doc_id, s.start::BIGINT AS start_at, s.\"end\"::BIGINT AS end_at, s.match AS matched FROM (SELECT doc_id, unnest({spans.offsets(CHECK, 'text', rx)}) AS s FROM documents WHERE {CHECK.rx('text', rx)})")


def _all_spans() -> str:
    """SQL: the spans of all detectors (doc_id, class, source, a, z); a look-ahead at a pattern's end is tested on the rest of the text."""
    parts = []
    for p in (*P.STRONG, *P.MEDIUM, *P.HIPAA, *P.SECRETS):
        head, _, ahead = p.regex.partition("(?=")
        rest = f"WHERE {CHECK.rx('substring(x, (s.' + chr(34) + 'end' + chr(34) + ')::BIGINT + 1)', '^(?i:' + ahead[:-1] + ')')}" if ahead else ""
        source = "critical_secret" if p.tier == "secret" else "regex"
        found = f"SELECT doc_id, x, unnest({spans.offsets(CHECK, 'x', head)}) AS s FROM d WHERE {CHECK.rx('x', head)}"
        parts.append(f"SELECT doc_id, {CHECK.q(p.name)} AS class, '{source}' AS source, s.start AS a, s.{chr(34)}end{chr(34)} AS z FROM ({found}) {rest}")
    return f"d AS (SELECT doc_id, {CHECK.ascii_bounds('text')} AS x FROM documents), f AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}))"


_OVERLAPS = f"""WITH {_all_spans()}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, z, class) AS i FROM f)
    SELECT p.class AS class_a, q.class AS class_b, count(*) AS n FROM n p JOIN n q ON p.doc_id = q.doc_id AND p.i < q.i AND q.a < p.z AND p.a < q.z GROUP BY 1, 2"""


def _chunks():
    sql = f"SELECT doc_id, start::INTEGER AS start, substring(text, start + 1, {scan.SIZE}) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= {scan.SIZE} THEN 1 ELSE length(text) END, {scan.SIZE - scan.OVERLAP})) AS start FROM documents WHERE length(text) > 0)"
    return sql


def _scan():
    parts = nest(f"(SELECT * FROM ({_chunks()}) WHERE length({CHECK.strip('chunk')}) >= {scan.LEAST})", score.levels(CHECK, "chunk"))
    crit = " OR ".join(CHECK.rx("text", p.regex) for p in P.STRONG if p.name in scan.CRITICAL)
    sql = f"""WITH c AS ({parts}),
    r AS (SELECT doc_id, max(risk_score) AS top, max(CASE action WHEN 'block' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS act, count(*) AS n, sum(CASE WHEN action <> 'silent' THEN 1 ELSE 0 END) AS flagged FROM c GROUP BY doc_id),
    d AS (SELECT doc_id, coalesce({crit}, false) AS crit FROM documents)
    SELECT doc_id, CASE WHEN crit OR act = 2 THEN 'high' WHEN act = 1 THEN 'med' ELSE 'low' END AS overall_risk, (CASE WHEN crit THEN 100 ELSE coalesce(top, 0) END)::INTEGER AS risk_score, coalesce(n, 0)::BIGINT AS chunks_scored, coalesce(flagged, 0)::BIGINT AS flagged_chunks FROM d LEFT JOIN r USING (doc_id)"""
    return Query(lambda t, spark: scan.scan(dealt(t("documents").select("doc_id", "text"))).drop("triggers"), sql)


def _mail(d: Dialect) -> str:
    high = " OR ".join(d.rx("text", p) for p in P.MAIL_HIGH)
    pairs = d.all_matches(d.ascii_bounds("text"), P.TITLE_PAIR)
    first = d.sub("m", r"\s.*$", "")
    stop = ", ".join(f"'{w}'" for w in P.TITLE_STOP)
    pair = d.exists(pairs, "m", f"lower({first}) NOT IN ({stop})")
    return f"CASE WHEN {d.strip('text')} = '' THEN 'low' WHEN {high} THEN 'high' WHEN {pair} THEN 'med' ELSE 'low' END"


def _demo(d: Dialect) -> str:
    crit, med = (" OR ".join(d.rx("text", P.DEMO[n]) for n in names) for names in (P.DEMO_CRITICAL, P.DEMO_MEDIUM))
    return f"CASE WHEN {crit} THEN 'BLOCK' WHEN {med} THEN 'WARN' ELSE 'SILENT' END"


def _word_windows():
    sql = r"""SELECT doc_id, first::INTEGER AS first, md5(array_to_string(ws[first + 1:first + 126], ' ')) AS words_md5
    FROM (SELECT doc_id, ws, unnest(range(0, CASE WHEN len(ws) <= 126 THEN 1 ELSE ceil((len(ws) - 126) / 94.0)::BIGINT * 94 + 1 END, 94)) AS first FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents WHERE text IS NOT NULL))"""
    return Query(lambda t, spark: scan.word_windows(t("documents").where("text IS NOT NULL"), "doc_id").select("doc_id", "first", F.md5(F.array_join("words", " ")).alias("words_md5")), sql)


def _html():
    s = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        s = f"replace({s}, '{k}', '{v}')"
    return Query(lambda t, spark: t("pages").select("page_id", F.md5(unmarked(F.col("html"))).alias("text_md5")), f"SELECT page_id, md5(trim(regexp_replace({s}, '\\s+', ' ', 'g'))) AS text_md5 FROM pages")


QUERIES: dict[str, Query] = {
    "trigger_counts": _count_by_name(score.detectors()),
    "kb_rules": _count_by_name(score.detectors(KB)),
    "hipaa_flags": _count_by_name({p.name: [p] for p in P.HIPAA}),
    "regex_match_counts": _pattern_sums(P.STRONG + P.MEDIUM),
    "secret_match_counts": _pattern_sums(P.SECRETS),
    "detector_flags": _per_doc(n_strong=lambda d: _n(d, P.STRONG), n_medium=lambda d: _n(d, P.MEDIUM), n_secret=lambda d: _n(d, P.SECRETS)),
    "critical_secret_entropy": _entropy(),
    "critical_secret": _per_doc(critical=lambda d: score.secret(d, "text", low=score.SEEN)),
    "heuristic_score": _heuristic(),
    "risk_tier_counts": _tiers(),
    "rule_only_action": _rules(),
    "model_column_action": _rules(prob=True),
    "code_snippet_safe": _per_doc(code_like=lambda d: score.code_like(d, "text")),
    "signal_families": _per_doc(families=lambda d: f"cast({score.family_count(d, 'lower(text)', 'lower(text)')} AS bigint)"),
    "tiny_text": _per_doc(tiny=lambda d: score.tiny("text", score.family_count(d, "lower(text)", "lower(text)"), "0.5", score.Policy())),
    "mask_pii": _replaced(remediate.mask_steps),
    "hash_pii": _replaced(remediate.hash_steps),
    "email_spans": _offsets("email address"),
    "card_spans": _offsets("credit card pattern"),
    "ipv4_spans": _offsets("IP address (IPv4)"),
    "char_chunks": Query(lambda t, spark: scan.chunks(t("documents"), "doc_id").select("doc_id", "start", F.md5("chunk").alias("chunk_md5")), f"SELECT doc_id, start, md5(chunk) AS chunk_md5 FROM ({_chunks()})"),
    "word_windows": _word_windows(),
    "chunk_scan_rollup": _scan(),
    "mail_heuristic_risk": _per_doc(risk=_mail),
    "demo_layer_decision": _per_doc(decision=_demo),
    "category_heuristic": _per_doc(category=lambda d: X.category(d, "text")),
    "text_keys": _per_doc(fingerprint_md5=lambda d: f"md5({X.fingerprint(d, 'text')})", audit_md5=lambda d: X.audit_key(d, "text"), words_md5=lambda d: f"md5({X.words_key(d, 'text')})", text_hash=lambda d: X.text_hash(d, "text"), squeezed_md5=lambda d: f"md5({X.squeeze(d, 'text')})"),
    "paste_preprocess": _per_doc(skipped=lambda d: f"(length(text) < 3 OR {d.strip('text')} = '')", truncated=lambda d: "length(text) > 50000", estimated_chunks=lambda d: f"cast(greatest(1, floor({X.n_words(d, 'left(text, 50000)')} / 70)) AS bigint)"),
    "html_strip": _html(),
    "span_overlap_pairs": Query(lambda t, spark: spans.overlap_pairs(spans.find_all(dealt(t("documents").select("doc_id", "text"))), "doc_id").groupBy(F.col("one.class").alias("class_a"), F.col("two.class").alias("class_b")).agg(F.count(F.lit(1)).alias("n")), _OVERLAPS),
    "highlight_spans": Query(lambda t, spark: spans.find_all(dealt(t("documents").select("doc_id", "text"))).transform(spans.edit, "highlight").selectExpr("doc_id", "md5(edited) AS text_md5")),
    "mask_spans_partial": Query(lambda t, spark: spans.find_all(dealt(t("documents").select("doc_id", "text"))).transform(spans.edit, "partial").selectExpr("doc_id", "md5(edited) AS text_md5")),
    "span_layer_summary": Query(lambda t, spark: spans.find_all(dealt(t("documents").select("doc_id", "text"))).select(F.explode("spans").alias("s")).groupBy("s.source", "s.class").agg(F.count(F.lit(1)).alias("n")), f"WITH {_all_spans()} SELECT source, class, count(*) AS n FROM f GROUP BY 1, 2"),
}
