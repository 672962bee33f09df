"""Queries on made-up rows, curated pools, the training set as a whole, metric packs and paste outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from textwarden.functions import text as X
from textwarden.functions.dialect import CHECK, SPARK, Dialect, apply, nest
from textwarden.operators import build, evaluate, policy
from textwarden.plans.common import SCORED, Query, scored_labels
from textwarden.plans.data_queries import _COUNT, _classes, _metrics, _rounded, _sql_rounded
from textwarden.plans.data_queries import QUERIES as DATA
from textwarden.sources import generators, readers

_THREE = "CASE doc_id % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'med' WHEN 2 THEN 'med' ELSE 'low' END"
_HELD = ("src1", "src3")
_MIX = {**generators.finance_counts(100), **{k: 24 for k in generators.KINDS if not k.startswith("finance_") or k == "finance_balanced"}}
_COLS = ("source", "id", "risk", "text_md5")


def _mixture(t, spark):
    """A made-up row beside each document: of the kind that the document's number gives, kept apart by source."""
    d, kinds = t("documents").select("doc_id"), list(_MIX)
    made = [generators.beside(d.where(f"doc_id % {len(kinds)} = {i}"), "doc_id", k) for i, k in enumerate(kinds)]
    return reduce(lambda a, b: a.unionByName(b), made).withColumn("text_md5", F.md5("text")).select(*_COLS)


def _finance(t, spark):
    names = ("SSN", "credit_card_number", "Person Name", "o", "other", "my email", "unknown", "xx", " Date_of_birth ", "non-pii")
    d = t("documents").selectExpr("text AS Sentence", f"CASE doc_id % 11 {' '.join(f'WHEN {i} THEN {SPARK.q(x)}' for i, x in enumerate(names))} END AS Category")
    return readers.finance_rows(d).groupBy("risk").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


#: The risks that the ten made-up labels should get.
_FINANCE = r"""SELECT risk, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, CASE doc_id % 11 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'med' WHEN 3 THEN 'low' WHEN 4 THEN 'low' WHEN 5 THEN 'med' WHEN 8 THEN 'med' WHEN 9 THEN 'low' END AS risk FROM documents)
    WHERE risk IS NOT NULL AND length(text) > 10 GROUP BY risk"""


def _pools(t, spark):
    d = t("documents").selectExpr("doc_id AS line", "text", "CASE doc_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' WHEN 2 THEN 'odd' END AS risk")
    files = {n: d.where(f"line % 5 = {i}") for i, (n, _, _) in enumerate(readers.EXTRA_POOLS)}
    return readers.extra_pool_rows(files, t("benchmark").select("text"), 200).select("line", "risk", "source")


_POOLS = f"""WITH d AS (SELECT doc_id AS line, doc_id % 5 AS k, {CHECK.strip('text')} AS text, CASE doc_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'med' ELSE CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'med' ELSE 'low' END END AS risk FROM documents),
    f AS (SELECT *, {X.fingerprint(CHECK, 'text')} AS f FROM d WHERE length(text) BETWEEN 20 AND 1000), u AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY k, line) AS r FROM f WHERE f <> ''),
    l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY line) AS place FROM u WHERE r = 1 AND f NOT IN (SELECT {X.fingerprint(CHECK, 'text')} FROM benchmark WHERE text IS NOT NULL))
    SELECT line, risk, list_extract(['extra_pool_high', 'extra_pool_hard_low', 'extra_pool_hard_med', 'extra_pool_weak_cat', 'extra_pool_contextual_pii'], (k + 1)::INT) AS source FROM l WHERE place <= 200"""


def _real(t):
    return t("documents").selectExpr("cast(doc_id AS string) AS key", "text", f"{_THREE} AS risk", "source")


def _counted(d):
    return d.groupBy("split", "source", "risk").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"))


_WANTED, _ADVERSARIAL, _SAFE, _MOST = 200, 40, 500, 60


def _case(table: dict[str, int], x: str = "risk") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


def _made(kind: str, count: str | int, seed: int = 42) -> str:
    return f"SELECT source || '-' || id AS key, text, risk, source FROM ({generators.check_sql(kind, count, seed)})"


def _place(seed: int = 42) -> str:
    return f"row_number() OVER (PARTITION BY risk ORDER BY md5('{seed}|' || key), key)"


def _splits_sql(binary: bool) -> str:
    finance = " UNION ALL ".join(f"SELECT *, 1 AS rank FROM ({_made(k, n)})" for k, n in generators.finance_counts(_WANTED).items())
    head = f"""real AS (SELECT doc_id::VARCHAR AS key, text, {_THREE} AS risk, source FROM documents), named AS (SELECT *, coalesce(lower(trim(source)) IN {_HELD}, false) AS h FROM real),
    have AS (SELECT risk, count(*) AS k FROM named WHERE h GROUP BY risk), ranked AS (SELECT n.*, {_place()} AS r FROM named n WHERE NOT h),
    moved AS (SELECT key FROM ranked LEFT JOIN have USING (risk) WHERE r <= {_case(build.HOLDOUT_LEAST)} - coalesce(k, 0)),
    held AS (SELECT key, text, risk, source FROM named WHERE h OR key IN (SELECT key FROM moved)),
    p0 AS (SELECT key, text, risk, source, 0 AS rank FROM named WHERE NOT h AND key NOT IN (SELECT key FROM moved) UNION ALL {finance})"""
    if binary:
        two = "CASE WHEN risk = 'low' THEN 'safe' ELSE 'risky' END AS risk"
        head += f""", p1 AS (SELECT key, text, {two}, source, rank FROM (SELECT * FROM p0 UNION ALL SELECT *, 2 FROM ({_made('adversarial', _ADVERSARIAL)}))),
    gap AS (SELECT least({_SAFE}, greatest(sum((risk = 'safe')::INT), sum((risk = 'risky')::INT))) - sum((risk = 'safe')::INT) AS g FROM p1),
    p AS (SELECT * FROM p1 UNION ALL SELECT key, text, {two}, source, 3 FROM ({_made('safe_business', _SAFE)}) CROSS JOIN gap WHERE split_part(key, '-', 2)::INT < g)"""
    else:
        head += ", p AS (SELECT * FROM p0)"
    head += f""", d AS (SELECT key, text, risk, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY rank, key) AS r FROM p) WHERE r = 1 OR text IS NULL),
    s AS (SELECT key, text, risk, source, CASE WHEN place <= round(n * 0.85::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM (SELECT *, {_place()} AS place, count(*) OVER (PARTITION BY risk) AS n FROM d))"""
    count = "SELECT split, source, risk, {n}::BIGINT AS n, coalesce(sum(length(text){k}), 0)::BIGINT AS chars FROM ({rows}) GROUP BY ALL"
    if binary:
        t = f"least({_MOST}, max(n) OVER ())"
        copies = f"(SELECT *, CASE WHEN n >= t THEN CASE WHEN r <= t THEN 1 ELSE 0 END ELSE (t - r) // n + 1 END AS copies FROM (SELECT *, {t} AS t FROM (SELECT *, {_place()} AS r, count(*) OVER (PARTITION BY risk) AS n FROM s WHERE split = 'train')))"
        rows = f"SELECT split, source, risk, text, copies FROM {copies} WHERE copies > 0 UNION ALL SELECT split, source, risk, text, 1 FROM s WHERE split = 'validation' UNION ALL SELECT 'test', source, CASE WHEN risk = 'low' THEN 'safe' ELSE 'risky' END, text, 1 FROM held"
        return f"WITH {head} " + count.format(n="sum(copies)", k=" * copies", rows=rows)
    parts = {"train": ("SELECT key, text, risk, source FROM s WHERE split = 'train'", build.TRAIN_LEAST, None, 55), "validation": ("SELECT key, text, risk, source FROM s WHERE split = 'validation'", build.VAL_LEAST, build.MOST_RATIO, 77), "test": ("SELECT key, text, risk, source FROM held", build.TEST_LEAST, build.MOST_RATIO, 99)}
    rows = []
    for name, (base, least, most, seed) in parts.items():
        top = int(most * min(least.values())) if most else None
        head += f", c_{name} AS (SELECT key, text, risk, source FROM (SELECT *, {_place(seed)} AS r FROM ({base})){f' WHERE r <= {top}' if top else ''})"
        rows.append(f"SELECT '{name}' AS split, source, risk, text FROM c_{name}")
        rows += [f"SELECT '{name}', source, risk, text FROM ({_made(generators.TOP_UP[c], n, seed)}) WHERE split_part(key, '-', 2)::INT < {n} - (SELECT count(*) FROM c_{name} WHERE risk = '{c}')" for c, n in least.items()]
    return f"WITH {head} " + count.format(n="count(*)", k="", rows=" UNION ALL ".join(rows))


def _splits(t, spark):
    return _counted(build.training_splits(spark, _real(t), _HELD, _WANTED))


def _splits_binary(t, spark):
    return _counted(build.training_splits(spark, _real(t), _HELD, _WANTED, binary=True, adversarial=_ADVERSARIAL, safe_target=_SAFE, most=_MOST))


def _blind(t, spark):
    return build.blind_sets(spark, t("benchmark").where("text IS NOT NULL").select("text")).select(F.col("set").alias("part"), "label", F.md5("text").alias("text_md5"))


def _blind_sql() -> str:
    sets = f"known AS (SELECT DISTINCT {X.token_set(CHECK, 'text')} AS s FROM benchmark WHERE text IS NOT NULL)"
    parts = []
    for name, label, kind, n in (("blind", "safe", "low", build.BLIND_EACH), ("blind", "medium", "hard_med", build.BLIND_EACH), ("blind", "risky", "hard_high", build.BLIND_EACH), ("safe", "safe", "low", build.SAFE_TOTAL)):
        one = f"SELECT k, min(text) AS text FROM (SELECT {X.words_key(CHECK, 'text')} AS k, text FROM ({generators.check_sql(kind, build.BLIND_POOL, 7)})) WHERE k <> '' GROUP BY k"
        near = "SELECT 1 FROM known, (SELECT list_filter(list_distinct(string_split(k, ' ')), lambda e: e <> '') AS m) WHERE len(list_intersect(m, s))::DOUBLE / len(list_distinct(list_concat(m, s))) >= 0.62"
        parts.append(f"(SELECT '{name}' AS part, '{label}' AS label, md5(text) AS text_md5 FROM ({one}) o WHERE NOT EXISTS ({near}) ORDER BY k LIMIT {n})")
    return f"WITH {sets} " + " UNION ALL ".join(parts)


_PACK = ("accuracy", "precision", "recall", "fpr", "f1", "mcc", "accuracy_gain")


def _pack(t, spark):
    d = evaluate.metric_pack(scored_labels(t), "y", "p", F.expr("doc_id % 4 = 0"), F.expr("doc_id % 9 = 0"), 0.5, 0.45)
    return _rounded(d, *_PACK).select("config", "tp", "tn", "fp", "fn", *_PACK)


def _pack_sql() -> str:
    hit = "(doc_id % 4 = 0 OR doc_id % 9 = 0)"
    configs = {"regex_ner": hit, "ml_val_calib": "p >= 0.5", "ml_test_rec": "p >= 0.45", "full_val_calib": f"({hit} OR p >= 0.5)", "full_test_rec": f"({hit} OR p >= 0.45)"}
    rows = " UNION ALL ".join(f"SELECT '{n}' AS config, y, {z} AS z FROM s" for n, z in configs.items())
    c = f"c AS (SELECT config, {_COUNT.format('y = 1 AND z')} AS tp, {_COUNT.format('y <> 1 AND NOT z')} AS tn, {_COUNT.format('y <> 1 AND z')} AS fp, {_COUNT.format('y = 1 AND NOT z')} AS fn FROM ({rows}) GROUP BY config)"
    gain = f"SELECT *, accuracy - max(CASE WHEN config = 'regex_ner' THEN accuracy END) OVER () AS accuracy_gain FROM ({_metrics()})"
    return _sql_rounded(f"WITH s AS ({SCORED}), {c} SELECT config, tp, tn, fp, fn, {', '.join(_PACK)} FROM ({gain})", *_PACK)


def _f1(t, spark):
    return evaluate.category_f1(evaluate.per_class(_classes(t), "truth", "z"), "class", "f1")


def _paste(d: Dialect):
    action = "CASE doc_id % 3 WHEN 0 THEN 'silent' WHEN 1 THEN 'warn' ELSE 'block' END"
    return [{"act": action, "blank": f"(coalesce({d.strip('text')}, '') = '')"}, policy.paste_outcome("(doc_id % 5 <> 0)", "blank", "act", "(doc_id % 2 = 0)")]


_PASTE = ("doc_id", "outcome", "permitted", "logged")


def _points(texts: list[str]) -> list[list[int]]:
    return [[1, *map(ord, t), 2] for t in texts]


def _tokens(t, spark):
    d = build.tokenise(t("documents").select("doc_id", "text"), lambda: _points)
    return d.selectExpr("doc_id", "cast(size(input_ids) AS bigint) AS n", "cast(aggregate(attention_mask, 0, (a, x) -> a + x) AS bigint) AS used", "aggregate(input_ids, 0L, (a, x) -> a + x) AS id_sum")


_TOKENS = """SELECT doc_id, 128::BIGINT AS n, least(128, length(t) + 2)::BIGINT AS used, (1 + coalesce(list_sum(list_transform(string_split(left(t, 127), ''), lambda c: CASE WHEN c = '' THEN 0 ELSE unicode(c) END)), 0) + CASE WHEN length(t) <= 126 THEN 2 ELSE 0 END)::BIGINT AS id_sum FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

QUERIES: dict[str, Query] = {
    "synthetic_mixture": Query(_mixture, " UNION ALL ".join(f"SELECT source, id, risk, md5(text) AS text_md5 FROM ({generators.check_sql(k, 0, source=f'(SELECT doc_id AS id FROM documents WHERE doc_id % {len(_MIX)} = {i})')})" for i, k in enumerate(_MIX))),
    "demo_events": Query(lambda t, spark: generators.events_beside(t("events"), "event_id").selectExpr("event_id", "unix_timestamp(ts) AS at_second", "risk_score", "action"), f"SELECT event_id, at_second, risk_score, action FROM ({generators.events_check_sql(source='(SELECT event_id AS id FROM events)')})"),
    "finance_workbook_labels": Query(_finance, _FINANCE),
    "extra_pools": Query(_pools, _POOLS),
    "training_build": Query(_splits, _splits_sql(False)),
    "training_build_binary": Query(_splits_binary, _splits_sql(True)),
    "blind_sets": Query(_blind, _blind_sql()),
    "metric_pack": Query(_pack, _pack_sql()),
    "category_f1": Query(_f1, f"SELECT class AS category, round(f1, 3) AS f1 FROM ({DATA['per_class_prf'].sql})"),
    "paste_outcomes": Query(lambda t, spark: apply(t("documents").select("doc_id", "text"), _paste(SPARK)).select(*_PASTE), f"SELECT {', '.join(_PASTE)} FROM ({nest('documents', _paste(CHECK))})"),
    "fixed_size_tokens": Query(_tokens, _TOKENS),
}
