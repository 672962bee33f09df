"""Queries on classifier outputs, decisions and small extractors. Probabilities are made from ids where no model is at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from textwarden.functions.dialect import CHECK, SPARK, Dialect, apply, nest
from textwarden.operators import curate, mining
from textwarden.operators import model_scores as M
from textwarden.plans.common import Query

_PARTS = "doc_id, text, cast(doc_id * 7 % 97 + 1 AS double) AS a, cast(doc_id * 5 % 31 + 1 AS double) AS b, cast(doc_id * 3 % 41 + 1 AS double) AS c"
_PROBS = "doc_id, text, a / (a + b + c) AS p_low, b / (a + b + c) AS p_med, c / (a + b + c) AS p_high"
_SRC = f"(SELECT {_PROBS} FROM (SELECT {_PARTS} FROM documents))"
LIMITS = {"LOW": (0.825, 0.975), "MED": (0.4, 0.6), "HIGH": (0.3, 0.446)}


def _probs(t):
    return t("documents").selectExpr(*[x.strip() for x in _PARTS.split(", ")]).selectExpr(*[x.strip() for x in _PROBS.split(", ")])


def _chain(levels, *out: str):
    return Query(lambda t, spark: apply(_probs(t), levels(SPARK)).selectExpr("doc_id", *out), f"SELECT doc_id, {', '.join(out)} FROM ({nest(_SRC, levels(CHECK))})")


def _decisions(d: Dialect):
    return [
        {"label": M.three_class_label("p_med", "p_high"), "score": M.expected_score(d, "p_low", "p_med", "p_high")},
        {"tier": M.tier("score"), "blend": M.blended(d, "score", "30", "blend"), "by_probs": M.three_class_decision("p_med", "p_high", "label", "doc_id % 3"),
         "by_class": M.per_class_decision({"low": "p_low", "med": "p_med", "high": "p_high"}, LIMITS), "by_risk": M.risk_decision("label")},
        {"merged": M.strictest(["by_probs", "by_class", "by_risk"], "doc_id % 5 = 0")},
    ]


def _messages(d: Dialect):
    names = ("SSN pattern", "email address", "IP address (IPv4)", "credit card pattern")
    null = "cast(NULL AS string)" if d.spark else "NULL"
    trig = d.present([f"CASE WHEN doc_id % {i + 2} = 0 THEN {d.q(n)} ELSE {null} END" for i, n in enumerate(names)])
    return [
        {"triggers": trig, "risk": M.three_class_label("p_med", "p_high"), "score": "cast(doc_id % 101 AS int)"},
        {"decision": M.risk_decision("risk", warn_instead=False)},
        {"message": M.message(d, "risk", "decision", "triggers"), "advice": d.join(M.suggestions(d, "triggers", "score"), "|"), "log_class": M.log_class(d, "triggers", "risk")},
    ]


def _context(d: Dialect):
    return [{k: f"coalesce({mining.first_match(d, 'text', rx)}, '')" for k, rx in mining.CONTEXT.items() if k != "full_name"}]


def _mined(d: Dialect):
    size = "cast(size({}) AS bigint)" if d.spark else "len({})::BIGINT"
    return [{f"n_{c}": size.format(mining.seed_sentences(d, "text", c)) for c in mining.SEEDS} | {"acronyms": d.join(mining.acronyms(d, "text"), ","), "n_quoted": size.format(mining.quoted(d, "text"))}]


def _titles():
    def levels(d):
        return [{"title": d.q("​") + " || url || ' and 5 more pages - Google Chrome'" if not d.spark else f"concat({d.q(chr(0x200B))}, url, ' and 5 more pages - Google Chrome')"}, {"cleaned": mining.clean_title(d, "title"), "agent": mining.title_assistant(d, "concat(url, CASE page_id % 3 WHEN 0 THEN ' Claude' WHEN 1 THEN ' chatgpt.com' ELSE '' END)")}]

    return Query(lambda t, spark: apply(t("pages").select("page_id", "url"), levels(SPARK)).select("page_id", "cleaned", "agent"), f"SELECT page_id, cleaned, agent FROM ({nest('(SELECT page_id, url FROM pages)', levels(CHECK))})")


def _types():
    raw = "CASE event_id % 6 WHEN 0 THEN 'phone-number' WHEN 1 THEN 'Social_Security' WHEN 2 THEN ' gpe' WHEN 3 THEN 'odd' WHEN 4 THEN 'OTHER-PII' ELSE 'uri' END"
    cls = "CASE event_id % 4 WHEN 0 THEN 'SSN pattern' WHEN 1 THEN 'phone number' WHEN 2 THEN 'IBAN' ELSE 'IP address (IPv4)' END"
    out = lambda d: f"{mining.phi_type(d, raw)} AS phi_type, {mining.benchmark_type(d, cls)} AS benchmark_type"
    return Query(lambda t, spark: t("events").selectExpr("event_id", *[f"{mining.phi_type(SPARK, raw)} AS phi_type", f"{mining.benchmark_type(SPARK, cls)} AS benchmark_type"]), f"SELECT event_id, {out(CHECK)} FROM events")


def _windows(t, spark):
    d = _probs(t).selectExpr("doc_id % 50 AS doc", "doc_id AS at", "array(p_low, p_med, p_high) AS probs", "cast(doc_id * 13 % 140 AS int) AS span")
    return M.worst_window(d, "doc", "probs", 0.4, 100, "span").selectExpr("doc", "round(probs[0], 9) AS p_low", "round(probs[1], 9) AS p_med", "round(probs[2], 9) AS p_high")


_WINDOWS = f"""WITH w AS (SELECT doc_id % 50 AS doc, p_low, p_med, p_high, (doc_id * 13 % 140) <= 100 AND greatest(p_low, p_med, p_high) >= 0.4 AS ok FROM {_SRC}),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY p_high DESC, p_med DESC, p_low) AS r FROM w WHERE ok), d AS (SELECT DISTINCT doc FROM w)
    SELECT doc, round(coalesce(p_low, 1), 9) AS p_low, round(coalesce(p_med, 0), 9) AS p_med, round(coalesce(p_high, 0), 9) AS p_high FROM d LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (doc)"""


def _long(t, spark):
    d = t("documents").selectExpr("doc_id", "transform(sequence(0, cast(doc_id % 9 AS int)), i -> cast((doc_id * 31 + i * 17) % 101 AS int)) AS s")
    return d.selectExpr("doc_id", f"cast({M.long_text_score('s', '50', '200')} AS int) AS score").selectExpr("doc_id", "score", f"{M.tier('score')} AS tier")


_LONG = f"""WITH s AS (SELECT doc_id, (doc_id * 31 + i * 17) % 101 AS s FROM documents, range(9) r(i) WHERE i <= doc_id % 9), g AS (SELECT doc_id, max(s) AS top, min(s) AS low, count(*) AS n, sum(CASE WHEN s > 30 THEN 1 ELSE 0 END) AS hit FROM s GROUP BY doc_id),
    f AS (SELECT doc_id, CASE WHEN hit::DOUBLE / n < 0.25 AND top < 80 THEN trunc(top * (hit::DOUBLE / n) * 2) ELSE top END AS f, n > 1 AND hit = n AND low >= 70 AS flat FROM g), r AS (SELECT doc_id, (CASE WHEN flat THEN least(f, 30) ELSE f END)::INTEGER AS score FROM f)
    SELECT doc_id, score, {M.tier('score')} AS tier FROM r"""

FLOORS = {"en": 40, "fr": 200, "de": 150}


def _coverage(t, spark):
    d = t("documents").where("lang IS NOT NULL").select("doc_id", "lang", "source")
    hold, rest = curate.holdout_coverage(d.where("source = 'src1'"), d.where("source <> 'src1'"), "doc_id", "lang", {"en": 20, "fr": 20, "de": 5})
    return hold.groupBy("lang").agg(F.count(F.lit(1)).alias("n_holdout")).join(rest.groupBy("lang").agg(F.count(F.lit(1)).alias("n_pool")), "lang", "full")


_COVERAGE = """WITH d AS (SELECT doc_id, lang, source FROM documents WHERE lang IS NOT NULL), h AS (SELECT lang, count(*) AS n FROM d WHERE source = 'src1' GROUP BY lang), p AS (SELECT lang, count(*) AS n FROM d WHERE source <> 'src1' GROUP BY lang),
    m AS (SELECT coalesce(h.lang, p.lang) AS lang, coalesce(h.n, 0) AS hn, coalesce(p.n, 0) AS pn, greatest(0, least(coalesce(p.n, 0), (CASE coalesce(h.lang, p.lang) WHEN 'en' THEN 20 WHEN 'fr' THEN 20 WHEN 'de' THEN 5 ELSE 0 END) - coalesce(h.n, 0))) AS mv FROM h FULL JOIN p ON h.lang = p.lang)
    SELECT lang, nullif(hn + mv, 0) AS n_holdout, nullif(pn - mv, 0) AS n_pool FROM m"""

QUERIES: dict[str, Query] = {
    "model_decisions": _chain(_decisions, "label", "score", "tier", "blend", "by_probs", "by_class", "by_risk", "merged"),
    "messages_and_advice": _chain(_messages, "message", "advice", "log_class"),
    "contextual_phrases": _chain(_context, "date", "age_phrase"),
    "kb_mining": _chain(_mined, *[f"n_{c}" for c in mining.SEEDS], "acronyms", "n_quoted"),
    "title_assistant": _titles(),
    "type_names": _types(),
    "worst_window": Query(_windows, _WINDOWS),
    "long_text_penalty": Query(_long, _LONG),
    "class_floors": Query(lambda t, spark: curate.class_floors(t("documents").where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id", "lang", FLOORS).groupBy("lang").agg(F.count(F.lit(1)).alias("n")), f"SELECT lang, greatest(count(*), CASE lang {' '.join(f"WHEN '{k}' THEN {v}" for k, v in FLOORS.items())} ELSE 0 END)::BIGINT AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang"),
    "holdout_coverage": Query(_coverage, _COVERAGE),
}
