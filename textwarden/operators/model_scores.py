"""Classifier outputs to labels, scores and decisions; each as an SQL expression in a dialect.

The model itself is a plug-in: a column of probabilities, from any scorer (:class:`Scorer`).
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions.dialect import Dialect

# Limits of the three-class rules, weights of the expected score, texts of messages and suggestions.
STRICT = {"pii_block": 0.30, "block": 0.35, "warn": 0.20}
CLASS_LIMITS = {"high_block": 0.97, "high_warn": 0.82, "med_warn": 0.791}
EXPECTED = {"high": 1.0, "med": 0.52, "low": 0.08}
LABEL_LIMITS = {"high": 0.5, "med": 0.3}
MESSAGES = (
    ("allow", "low", "Clipboard content appears safe (no sensitive data detected)."),
    ("warn", "med", "Clipboard content may contain names or general personal details. Please review before pasting."),
    ("warn", "high", "Potentially sensitive data detected. Proceed only if this paste is authorized."),
    ("block", "high", "Paste blocked due to high-risk sensitive data (e.g., {}). Contact security/compliance if you believe this is an error."),
)
OTHER_MESSAGE = "Clipboard content has been reviewed. Please confirm before pasting."
GENERIC = (
    "Avoid sending unnecessary personal details to LLMs.",
    "Review clipboard content for names, IDs, and financial information before pasting.",
    "If in doubt, mask or replace identifiers with placeholders.",
)
TARGETED = (
    (("ssn",), "Mask or hash national ID/SSN values before pasting (e.g., ***-**-6789 or a hash)."),
    (("credit card", "iban", "bank routing", "routing number", "account", "financial"), "Mask sensitive financial identifiers (keep last 4 digits) or encrypt/hash before pasting."),
    (("email", "phone", "address"), "Replace emails/phones/addresses with generic placeholders (e.g., [customer_email], [phone])."),
    (("ip", "device", "token", "auth", "jwt", "bearer"), "Hash or truncate IP/device/token values (e.g., 10.0.0.xxx)."),
)
FILLERS = (
    "Prefer a safe masked version of your text over the raw clipboard contents.",
    "Share only what the assistant needs; avoid raw identifiers when possible.",
    "If you must share sensitive data, consider encrypting or hashing it before paste.",
)


class Scorer(Protocol):
    """A model: adds a column of class probabilities to a table of texts."""

    def __call__(self, df: DataFrame, text_col: str, out: str) -> DataFrame: ...


def null_scorer(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """No model: probability 0 of the risky class."""
    return df.withColumn(out, F.array(F.lit(1.0), F.lit(0.0)))


def logistic_scorer(train: DataFrame, text_col: str, label: str, features: int = 1 << 16) -> Scorer:
    """A hashed bag-of-words logistic regression of the built-in library."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    steps = [RegexTokenizer(inputCol=text_col, outputCol="_w", pattern=r"\W+"), HashingTF(inputCol="_w", outputCol="_f", numFeatures=features), LogisticRegression(featuresCol="_f", labelCol=label, probabilityCol="_p", maxIter=30, regParam=0.01)]
    model = Pipeline(stages=steps).fit(train.where(F.col(text_col).isNotNull()))

    def score(df: DataFrame, text_col: str, out: str) -> DataFrame:
        d = model.transform(df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))))
        return d.withColumn(out, vector_to_array("_p")).select(*[c for c in df.columns if c != out], out)

    return score


def score_distinct(df: DataFrame, scorer: Scorer, text_col: str, out: str) -> DataFrame:
    """df with the model's column; each different text is scored once."""
    key = F.sha2(F.col(text_col), 256)
    once = scorer(df.select(key.alias("_k"), text_col).where("_k IS NOT NULL").groupBy("_k").agg(F.first(text_col).alias(text_col)), text_col, out).select("_k", out)
    return df.withColumn("_k", key).join(once, "_k", "left").drop("_k")


def worst_window(df: DataFrame, key: str, probs: str, least: float = 0.0, longest: int = 10**9, length: str | None = None) -> DataFrame:
    """(key, probs): the window of highest sensitivity. Three classes go by high, med, then low; others by the best class but the first.

    Windows too long or too unsure don't count; a key without windows left gets the all-safe vector.
    """
    p = F.col(probs)
    ok = (F.array_max(p) >= least) & ((F.col(length) <= longest) if length else F.lit(True))
    rank = F.when(F.size(p) == 3, F.struct(p[2].alias("a"), p[1].alias("b"), (-p[0]).alias("c"))).otherwise(F.struct(F.array_max(F.when(F.size(p) > 1, F.slice(p, 2, F.size(p))).otherwise(p)).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c")))
    safe = F.transform(F.sequence(F.lit(1), F.max(F.size(p))), lambda i: F.when(i == 1, 1.0).otherwise(0.0))
    return df.groupBy(key).agg(F.coalesce(F.max_by(p, F.when(ok, rank)), safe).alias(probs))


def long_text_score(scores: str, merged: str, tokens: str) -> str:
    """Spark SQL: the score of a long text from its windows' scores; few or uniform hits count less."""
    rate = f"size(filter({scores}, s -> s > 30)) / size({scores})"
    top = f"array_max({scores})"
    cut = f"CASE WHEN {rate} < 0.25 AND {top} < 80 THEN cast({top} * {rate} * 2 AS int) ELSE {top} END"
    return f"CASE WHEN size({scores}) = 0 THEN {merged} WHEN {tokens} >= 180 AND size({scores}) > 1 AND {rate} = 1 AND array_min({scores}) >= 70 AND {merged} <= 70 THEN least({cut}, 30) ELSE {cut} END"


def tier(score: str, low: int = 45, med: int = 70) -> str:
    return f"CASE WHEN {score} < {low} THEN 'low' WHEN {score} < {med} THEN 'med' ELSE 'high' END"


def expected_score(d: Dialect, low: str, med: str, high: str) -> str:
    """0..100 from three probabilities; halves go to the even number."""
    total = f"({low} + {med} + {high})"
    ev = f"({high} * {EXPECTED['high']} + {med} * {EXPECTED['med']} + {low} * {EXPECTED['low']}) / {total}"
    half = "rint({} * 100)" if d.spark else "round_even({} * 100, 0)"
    return f"CASE WHEN {total} <= 1e-9 THEN NULL ELSE cast({half.format(f'least(1, greatest(0, {ev}))')} AS int) END"


def blended(d: Dialect, model: str, rules: str, mode: str = "replace") -> str:
    half = "rint" if d.spark else "round_even"
    return model if mode == "replace" else f"cast({half}(({model} + {rules}) / 2.0{'' if d.spark else ', 0'}) AS int)"


def three_class_label(med: str, high: str) -> str:
    return f"CASE WHEN {high} > {LABEL_LIMITS['high']} THEN 'high' WHEN {med} > {LABEL_LIMITS['med']} THEN 'med' ELSE 'low' END"


def three_class_decision(med: str, high: str, risk: str, pii: str) -> str:
    strict = f"WHEN {risk} = 'high' AND ({pii} >= 2 AND {high} >= {STRICT['pii_block']} OR {high} >= {STRICT['block']}) THEN 'block' WHEN {risk} = 'high' AND {high} >= {STRICT['warn']} THEN 'warn'"
    return f"CASE {strict} WHEN {high} >= {CLASS_LIMITS['high_block']} THEN 'block' WHEN {high} >= {CLASS_LIMITS['high_warn']} OR {med} >= {CLASS_LIMITS['med_warn']} THEN 'warn' ELSE 'allow' END"


def per_class_decision(probs: dict[str, str], limits: dict[str, tuple[float, float]]) -> str:
    """Any class at its block limit blocks, else any at its warn limit warns; classes without limits don't count."""
    known = [(p, limits[k.upper()]) for k, p in probs.items() if k.upper() in limits]
    block, warn = (" OR ".join(f"{p} >= {t[i]}" for p, t in known) or "false" for i in (1, 0))
    return f"CASE WHEN {block} THEN 'block' WHEN {warn} THEN 'warn' ELSE 'allow' END"


def risk_decision(risk: str, warn_instead: bool = True) -> str:
    return f"CASE {risk} WHEN 'high' THEN '{'warn' if warn_instead else 'block'}' WHEN 'med' THEN 'warn' ELSE 'allow' END"


def strictest(decisions: list[str], critical: str = "false") -> str:
    """The strictest of several decisions; a critical secret lifts warn to block."""
    rank = lambda x: f"CASE {x} WHEN 'block' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END"
    top = f"greatest({', '.join(rank(x) for x in decisions)}, 0)"
    return f"CASE WHEN {top} = 2 OR {top} = 1 AND {critical} THEN 'block' WHEN {top} = 1 THEN 'warn' ELSE 'allow' END"


def message(d: Dialect, risk: str, decision: str, triggers: str) -> str:
    """The message to the user; ``triggers`` is a list."""
    named = f"CASE WHEN {d.size(triggers)} = 0 THEN 'sensitive data' ELSE {d.join(triggers, ', ')} END"
    cases = []
    for dec, r, text in MESSAGES:
        a, gap, b = text.partition("{}")
        out = f"concat({d.q(a)}, {named}, {d.q(b)})" if gap else d.q(text)
        cases.append(f"WHEN {decision} = '{dec}' AND {risk} = '{r}' THEN {out}")
    return f"CASE {' '.join(cases)} ELSE {d.q(OTHER_MESSAGE)} END"


def suggestions(d: Dialect, triggers: str, score: str) -> str:
    """List of three to five suggestions: general ones below 80, else by trigger with general ones to fill up."""
    joined = f"lower({d.join(triggers, ', ')})"
    null = "cast(NULL AS string)" if d.spark else "NULL"
    own = d.present([f"CASE WHEN {d.any(joined, words)} THEN {d.q(text)} ELSE {null} END" for words, text in TARGETED])
    fill = d.list(*[d.q(x) for x in FILLERS])
    both = d.concat(own, fill)
    cut = f"slice({both}, 1, greatest(3, {d.size(own)}))" if d.spark else f"({both})[1:greatest(3, {d.size(own)})]"
    return f"CASE WHEN {score} < 80 THEN {d.list(*[d.q(x) for x in GENERIC])} ELSE {cut} END"


def log_confidence(probs: str) -> str:
    return f"array_max({probs})"


def log_class(d: Dialect, labels: str, risk: str) -> str:
    return f"CASE WHEN {d.size(labels)} > 0 THEN {d.join(labels, '/')} ELSE {risk} END"
