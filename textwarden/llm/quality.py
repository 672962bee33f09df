"""Quality by weak supervision, with DataFrame functions only.

Eight rules vote good (1), bad (-1) or abstain (0) on every document. Two accuracies of each
rule (right on good documents, right on bad ones) and the share of good documents are
estimated by expectation-maximisation over the counts of vote patterns (at most 3^8 rows, so
the size of the model's input is bounded whatever the corpus). The posterior probability of "good" replaces a conjunction of thresholds; a
document that fails a base rule is never kept.

Everything about one document is computed from arrays in its row; nothing but the
counts of patterns is shuffled.

Results for odd input: null or blank text has no words, fails the base rule and isn't kept;
ties of the posterior at exactly 0.5 are kept; repeated rows count as often as they come; a very long text is counted whole, in its row;
extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.storage import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of expectation-maximisation; starting beliefs: share of good documents, a rule's accuracy on good and on bad ones (a rule seldom errs on good documents and catches one kind of bad ones).
ROUNDS, PRIOR, ON_GOOD, ON_BAD = 60, 0.8, 0.995, 0.25
#: A document that fails this is never kept.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
RULES = ("length", "word_length", "symbols", "lines", "repeats", "letters", "shouting", "marks")
_VOTES = {
    "length": "CASE WHEN n_words < 50 THEN -1 WHEN n_words >= 80 THEN 1 ELSE 0 END",
    "word_length": "CASE WHEN n_words = 0 OR word_chars < 2 * n_words OR word_chars > 12 * n_words THEN -1 WHEN word_chars BETWEEN 3 * n_words AND 10 * n_words THEN 1 ELSE 0 END",
    "symbols": "CASE WHEN 20 * n_symbols > n_words THEN -1 WHEN 100 * n_symbols <= n_words THEN 1 ELSE 0 END",
    "lines": "CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN -1 WHEN n_dup_lines = 0 THEN 1 ELSE 0 END",
    "repeats": "CASE WHEN 10 * n_repeat_words > 3 * n_words THEN -1 WHEN 20 * n_repeat_words < n_words THEN 1 ELSE 0 END",
    "letters": "CASE WHEN 10 * n_letter_words < 7 * n_words THEN -1 WHEN 10 * n_letter_words >= 9 * n_words THEN 1 ELSE 0 END",
    "shouting": "CASE WHEN 2 * n_upper > word_chars THEN -1 WHEN 5 * n_upper < word_chars THEN 1 ELSE 0 END",
    "marks": "CASE WHEN 10 * n_marks > n_words THEN -1 WHEN n_marks = 0 THEN 1 ELSE 0 END",
}


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules vote on."""
    d = docs.selectExpr("doc_id", "coalesce(text, '') AS text")
    d = d.selectExpr(
        "doc_id",
        rf"regexp_extract_all(text, r'{WORD}', 0) AS words",
        r"filter(split(text, '\n'), x -> x RLIKE r'[^\x20\x09-\x0D]') AS lines",
        r"cast(length(regexp_replace(text, r'[\x20\x09-\x0D]+', '')) AS bigint) AS word_chars",
        r"cast(regexp_count(text, r'[#*$%&|<>]') AS bigint) AS n_symbols",
        r"cast(regexp_count(text, r'\p{Lu}') AS bigint) AS n_upper",
        r"cast(regexp_count(text, r'[!?#*$%&|<>]{2,}') AS bigint) AS n_marks",
    )
    d = d.selectExpr(
        "doc_id", "word_chars", "n_symbols", "n_upper", "n_marks",
        r"cast(size(filter(words, x -> x RLIKE r'\p{L}')) AS bigint) AS n_letter_words",
        "cast(size(words) AS bigint) AS n_words",
        "cast(size(lines) AS bigint) AS n_lines",
        "cast(size(lines) - size(array_distinct(lines)) AS bigint) AS n_dup_lines",
        "CASE WHEN size(words) < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END AS grams",
    )
    counts = ["doc_id", "word_chars", "n_symbols", "n_letter_words", "n_upper", "n_marks", "n_words", "n_lines", "n_dup_lines"]
    d = d.selectExpr(*counts, "grams", "CASE WHEN size(array_distinct(grams)) < size(grams) THEN sort_array(grams) END AS ranked")
    d = d.selectExpr(*counts, "grams", "array_distinct(filter(ranked, (x, i) -> i > 0 AND x = ranked[greatest(i - 1, 0)])) AS twice")
    # few repeated windows: look each up; many: sort windows with their places
    d = d.selectExpr(*counts, "grams", "twice", "CASE WHEN size(twice) > 48 THEN sort_array(transform(grams, (x, i) -> struct(x, i))) END AS placed")
    d = d.selectExpr(
        *counts,
        """CASE WHEN twice IS NULL THEN cast(array() AS array<int>)
                WHEN placed IS NULL THEN filter(sequence(0, size(grams) - 1), i -> array_contains(twice, grams[i]))
                ELSE sort_array(transform(filter(placed, (e, k) -> placed[greatest(k - 1, 0)].x = e.x AND k > 0 OR k < size(placed) - 1 AND placed[least(k + 1, size(placed) - 1)].x = e.x), e -> e.i)) END AS at""",
    )
    return d.selectExpr(*counts, "aggregate(transform(at, (p, k) -> CASE WHEN k = size(at) - 1 THEN 3 ELSE least(3, at[least(k + 1, size(at) - 1)] - p) END), 0L, (s, x) -> s + x) AS n_repeat_words")


def votes(counted: DataFrame) -> DataFrame:
    return counted.withColumn("votes", F.expr("array(" + ", ".join(_VOTES[r] for r in RULES) + ")"))


def evidence(vote: str, acc: str) -> str:
    """SQL: what a vote adds to the log odds of "good"."""
    return f"CASE {vote} WHEN 1 THEN ln({acc}.a / (1 - {acc}.b)) WHEN -1 THEN ln((1 - {acc}.a) / {acc}.b) ELSE 0D END"


def estimate(voted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row: prior (share of good documents) and acc (of each rule when it votes: a on good, b on bad documents)."""
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("pats"))
    logit = f"aggregate(zip_with(x.votes, p.acc, (v, c) -> {evidence('v', 'c')}), ln(p.prior / (1 - p.prior)), (s, y) -> s + y)"
    e_step = f"transform(pats, x -> named_struct('votes', x.votes, 'g', x.n / (1 + exp(-({logit}))), 'n', x.n))"

    def share(of: str, vote: int, start: float) -> str:
        """Mass of the rule's right votes over its votes; one document of the starting belief keeps a silent rule defined."""
        right = f"aggregate(e, {start}D, (s, x) -> s + CASE WHEN x.votes[k] = {vote} THEN {of} ELSE 0D END)"
        voting = f"aggregate(e, 1D, (s, x) -> s + CASE WHEN x.votes[k] = 0 THEN 0D ELSE {of} END)"
        return f"least(0.999D, greatest(0.05D, {right} / {voting}))"

    total, good = "aggregate(e, 1D, (s, x) -> s + x.n)", f"aggregate(e, {PRIOR}D, (s, x) -> s + x.g)"
    acc = f"transform(sequence(0, {len(RULES) - 1}), k -> named_struct('a', {share('x.g', 1, ON_GOOD)}, 'b', {share('(x.n - x.g)', -1, ON_BAD)}))"
    m_step = f"named_struct('prior', least(0.99D, greatest(0.01D, {good} / {total})), 'acc', {acc})"
    start = f"named_struct('prior', {PRIOR}D, 'acc', array_repeat(named_struct('a', {ON_GOOD}D, 'b', {ON_BAD}D), {len(RULES)}))"
    return one.selectExpr(f"aggregate(sequence(1, {rounds}), {start}, (p, i) -> transform(array({e_step}), e -> {m_step})[0]) AS m").select("m.prior", "m.acc")


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, counts, votes, posterior, base_failed, kept."""
    voted = checkpointed(votes(features(docs)))
    m = estimate(voted, rounds).first()
    total = " + ".join(evidence(f"votes[{k}]", f"named_struct('a', {c.a!r}D, 'b', {c.b!r}D)") for k, c in enumerate(m.acc))
    return (
        voted.withColumn("posterior", F.expr(f"1 / (1 + exp(-(ln({m.prior!r}D / (1 - {m.prior!r}D)) + {total})))"))
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("kept", F.expr("NOT base_failed AND posterior >= 0.5"))
    )
