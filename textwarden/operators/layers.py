"""Rules, names and a model side by side: the three-layer decision, the plain score, named entities, and small maps of actions.

Expressions are SQL text in a dialect. Named entities come from a tagger that :func:`tag` is given: :mod:`textwarden.operators.tagger`'s or any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from textwarden.functions.batches import pieces
from textwarden.functions.dialect import Dialect, Level
from textwarden.operators import model_scores as M
from textwarden.operators import score as S
from textwarden.operators import spans as SP
from textwarden.operators.policy import SILENT_MAX

# Entity labels and the types they stand for, medical words, replacements.
ENTITY_TYPES = {
    "PERSON": "Full Name", "ORG": "Organization", "GPE": "Location", "LOC": "Location", "DATE": "Date", "MONEY": "Financial Amount",
    "CARDINAL": "Number", "FAC": "Facility",
}
ENTITY_CLASSES = {"PERSON": "NAME", "DATE": "ID", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "ORG": "OTHER_PII", "MONEY": "FINANCIAL"}
ENTITY_CONFIDENCE, DEMO_CHARS = 0.85, 10_000
MEDICAL = ("patient", "diagnosis", "medication", "prescription", "treatment", "hospital")
RISKY = ("risky", "high", "med")
MOCK_ID, MOCK_TEXT = "999001234", "SYNTH-DATA-MASKED"
CLASS_COUNT_PROB = 0.1

Tagger = Callable[[list[str]], list[list[tuple[int, int, str]]]]


def tag(df: DataFrame, load: Callable[[], Tagger], text_col: str = "text", out: str = "entities", types: dict[str, str] = ENTITY_TYPES, most_chars: int | None = None) -> DataFrame:
    """df with (start, end, label, type, confidence, match) of the named entities of whole texts, or of their first ``most_chars`` characters
    (DEMO_CHARS is what the demo reads).

    ``load`` makes the tagger once in each task, say ``lambda: tagger.load(model)``; labels without a type are left out.
    """
    df = df.drop(out)
    names = df.columns
    fields = (("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("type", pa.string()), ("confidence", pa.float64()), ("match", pa.string()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = load()
        for batch in pieces(batches, text_col):
            texts = [(t or "")[:most_chars] for t in batch.column(names.index(text_col)).to_pylist()]
            kept = [[x for x in found if x[2] in types] for found in tagger(texts)]
            flat = [(a, b, k, types[k], ENTITY_CONFIDENCE, t[a:b]) for t, found in zip(texts, kept, strict=True) for a, b, k in found]
            each = pa.StructArray.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*flat, strict=True) if flat else [()] * len(fields), fields, strict=True)], [n for n, _ in fields])
            ends = pa.array([0, *accumulate(map(len, kept))], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, each)], [*names, out])

    kinds = ", ".join(f"`{k}` {v}" for k, v in df.dtypes)
    return df.mapInArrow(work, f"{kinds}, `{out}` array<struct<start:int,end:int,label:string,type:string,confidence:double,match:string>>")


def entity_type(d: Dialect, label: str) -> str:
    """The type shown for an entity label; null for labels that don't count."""
    return f"CASE {label} " + " ".join(f"WHEN '{k}' THEN {d.q(v)}" for k, v in ENTITY_TYPES.items()) + " END"


def entity_class(label: str) -> str:
    """The class that a benchmark counts an entity label as; NONE for others."""
    return f"CASE {label} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ENTITY_CLASSES.items()) + " ELSE 'NONE' END"


def three_layers(d: Dialect, lowered: str, critical: str, medium: str, person: str, prediction: str, model_score: str) -> Level:
    """layer_decision, layer_severity and layer_reason by the first rule that holds."""
    risky = f"{prediction} IN ({', '.join(d.q(x) for x in RISKY)})"
    rules = (
        (critical, "BLOCK", "CRITICAL", "Regex detected critical identifier"),
        (f"({person} AND {d.any(lowered, MEDICAL)})", "BLOCK", "HIGH", "NER detected person in medical context"),
        (f"({medium} AND {risky})", "WARN", "MEDIUM", "Regex found medium PII + ML confirms risk"),
        (f"({risky} AND {model_score} >= 70)", "BLOCK", "HIGH", "ML model detected high contextual risk (no regex/NER match)"),
        (f"({risky} AND {model_score} >= 40)", "WARN", "MEDIUM", "ML model detected moderate contextual risk"),
        (f"({person} AND NOT {medium})", "WARN", "MEDIUM", "NER detected person name (no regex match)"),
        (medium, "WARN", "LOW", "Regex found low-risk pattern"),
    )
    pick = lambda i, other: "CASE " + " ".join(f"WHEN {r[0]} THEN {d.q(r[i])}" for r in rules) + f" ELSE {d.q(other)} END"
    return {"layer_decision": pick(1, "SILENT"), "layer_severity": pick(2, "SAFE"), "layer_reason": pick(3, "No PII detected by any layer")}


def ui_action(decision: str, critical: str = "false") -> str:
    return f"CASE WHEN {critical} THEN 'block' ELSE CASE lower(coalesce({decision}, 'allow')) WHEN 'block' THEN 'block' WHEN 'warn' THEN 'warn' ELSE 'silent' END END"


def action_decision(action: str) -> str:
    return f"CASE lower(coalesce({action}, 'silent')) WHEN 'block' THEN 'block' WHEN 'warn' THEN 'warn' ELSE 'allow' END"


def triggers_beside(d: Dialect, triggers: str, classes: str) -> str:
    """The triggers that no span's class names already (compared trimmed and without case); blank ones go."""
    low = lambda x: f"lower({d.strip(x)})"
    names = d.map(classes, "c", low("c"))
    has = f"array_contains({names}, {low('t')})" if d.spark else f"list_contains({names}, {low('t')})"
    test = f"{low('t')} <> '' AND NOT {has}"
    return f"filter({triggers}, t -> {test})" if d.spark else f"list_filter({triggers}, lambda t: {test})"


def mock_replacement(d: Dialect, x: str) -> str:
    """A fixed identifier for nine digits, else a fixed text."""
    return f"CASE WHEN {d.rx(x, '^[0-9]{9}$')} THEN '{MOCK_ID}' ELSE '{MOCK_TEXT}' END"


def _best(probs: dict[str, str], pick: Callable[[str, str], str], other: str) -> str:
    """pick(class, probability) of the first class of highest probability."""
    return "CASE " + " ".join(f"WHEN {p} >= greatest({', '.join(probs.values())}) THEN {pick(k, p)}" for k, p in probs.items()) + f" ELSE {other} END"


def plain_probs(probs: dict[str, str], risk_of: dict[str, str] | None = None, warn: float = 0.5) -> Level:
    """prob_low, prob_med, prob_high, top_label, top_prob, n_classes from class probabilities.

    With ``risk_of`` the classes are types of personal data: O counts in no sum, and ``n_classes`` are the types at CLASS_COUNT_PROB or more.
    Otherwise three classes low, med, high, or two classes safe, risky with the limit ``warn``.
    """
    if risk_of is not None:
        total = lambda r: "(" + " + ".join(["0", *[p for k, p in probs.items() if k != "O" and risk_of.get(k, "low") == r]]) + ")"
        count = " + ".join(f"CASE WHEN {p} >= {CLASS_COUNT_PROB} THEN 1 ELSE 0 END" for k, p in probs.items() if k != "O")
        return {
            "prob_low": total("low"), "prob_med": total("med"), "prob_high": total("high"), "top_label": _best(probs, lambda k, _: f"'{risk_of.get(k, 'low')}'", "'low'"),
            "top_prob": f"greatest({', '.join(probs.values())})", "n_classes": f"({count})",
        }
    if len(probs) == 2:
        safe, risky = probs.values()
        hit = f"{risky} >= {warn}"
        return {
            "prob_low": safe, "prob_med": risky, "prob_high": risky, "top_label": f"CASE WHEN {hit} THEN 'med' ELSE 'low' END",
            "top_prob": f"CASE WHEN {hit} THEN {risky} ELSE {safe} END", "n_classes": f"CASE WHEN {hit} THEN 1 ELSE 0 END",
        }
    low, med, high = probs.values()
    label = M.three_class_label(med, high)
    return {
        "prob_low": low, "prob_med": med, "prob_high": high, "top_label": label, "top_prob": f"CASE {label} WHEN 'high' THEN {high} WHEN 'med' THEN {med} ELSE {low} END",
        "n_classes": f"CASE {label} WHEN 'high' THEN 2 WHEN 'med' THEN 1 ELSE 0 END",
    }


def plain_levels(d: Dialect, probs: Level, text: str = "text", decision: str | None = None) -> list[Level]:
    """The plain score's chain after its probabilities: critical secret, decision, score and action.

    ``decision`` replaces the three-class rules (by the class limits, for instance).
    """
    flags = {n: f"pt_{i}" for i, n in enumerate(S.detectors())}
    return [
        {"stripped": f"coalesce({d.strip(text)}, '')"} | probs,
        S.seen("stripped") if d.spark else {"lowered": "lower(stripped)"},
        {"blank": "stripped = ''", "critical": S.secret(d, "stripped", low=S.SEEN)} | {f: S.found(d, "stripped", ps, S.SEEN) for f, ps in zip(flags.values(), S.detectors().values(), strict=True)},
        {"by_probs": decision or M.three_class_decision("prob_med", "prob_high", "top_label", "n_classes")},
        {"merged": M.strictest(["by_probs"], "critical"),
         "scalar": f"greatest({S.trigger_score('top_label', {n: f'(top_label = {d.q("high")} AND {f})' for n, f in flags.items()})}, CASE WHEN critical THEN 90 ELSE 0 END)"},
        {"shown": ui_action("merged", "critical")},
        {"action": f"CASE WHEN blank THEN 'silent' WHEN critical OR shown = 'block' THEN 'block' WHEN scalar > {SILENT_MAX} THEN 'warn' ELSE 'silent' END"},
        {"risk": "CASE WHEN blank THEN 'low' ELSE top_label END", "decision": action_decision("action")},
    ]


def merged_spans(text: str, rules: str, others: str) -> str:
    """Spark SQL: rule spans and those of windows, models or entities, with offsets repaired, one of each place and class, in order."""
    return SP._sorted(SP.distinct(SP.repair(text, f"concat({rules}, {others})")), "s.start AS k1", "s.end AS k2")


def document_label(top: str, available: str = "true") -> str:
    """Spark SQL: the one label of a document; O where the model has no answer."""
    return f"array(CASE WHEN {available} THEN coalesce({top}, 'O') ELSE 'O' END)"


def layer_counts(df: DataFrame, regex: str, names: str, model: str, truth: str) -> DataFrame:
    """One row: rows with a rule hit, a name hit, either; whether both together decide as rules and names do alone; missed positives."""
    n = lambda c: f"coalesce(sum(cast({c} AS int)), 0L)"
    either = f"({regex} OR {names})"
    return df.selectExpr(f"{n(regex)} AS regex_hits", f"{n(names)} AS name_hits", f"{n(either)} AS union_hits", f"{n(f'{truth} AND NOT {either}')} AS missed", f"coalesce(every({model} = {either}), true) AS same_as_union", "count(1) AS total")
