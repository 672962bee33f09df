"""Spans of detector matches and the interval operations on them.

A span is a struct (start, end, class, match, source, risk); offsets count code points and are
half-open. Offsets of one detector come from splitting the text at the matches and adding up lengths, which stays in
the JVM; :func:`find_all` is the Arrow form for a whole pattern table in one pass, and :func:`edit` rewrites texts at their spans.
All take time near linear in a text and its spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions.batches import pieces
from textwarden.functions.dialect import SPARK, Dialect
from textwarden.functions.patterns import GUARDS, HIPAA, MEDIUM, NOT_DIGITS, SECRETS, STRONG, Pattern

SPAN = "struct<start:int,end:int,class:string,match:string,source:string,risk:string>"
RISK = {"strong": "high", "medium": "med", "critical": "critical", "secret": "high"}
#: Highlighting prefers sources in this order.
PRIORITY = {"regex": 4, "kb_rule": 3, "model_window": 0}


#: Matches whose places are added up one by one; sums of whole parts are carried from part to part.
PART = 128


def _bound(x: str, name: str, body: str) -> str:
    """Spark SQL: body, in which ``name`` is x, evaluated once."""
    return f"transform(array({x}), {name} -> {body})[0]"


def offsets(d: Dialect, x: str, pattern: str) -> str:
    """List of (start, end, match) of one pattern. For Spark the matches and the text between them are found once each, and lengths added up in parts."""
    ms = d.all_matches(x, pattern)
    if d.spark:
        both = f"zip_with({ms}, split({x}, {d.q(pattern)}, -1), (m, b) -> named_struct('m', m, 'gap', length(b), 'own', coalesce(length(m), 0)))"
        parts = f"transform(sequence(1, size(e), {PART}), k -> slice(e, k, {PART}))"
        total = lambda of: f"aggregate({of}, 0, (s, y) -> s + y.gap + y.own)"
        start = f"aggregate(slice(sums, 1, i), 0, (s, y) -> s + y) + {total('slice(p, 1, j)')} + x.gap"
        each = f"transform(p, (x, j) -> named_struct('start', {start}, 'end', 0, 'match', x.m))"
        placed = f"flatten(transform(parts, (p, i) -> {each}))"
        placed = _bound(both, "e", _bound(parts, "parts", _bound(f"transform(parts, p -> {total('p')})", "sums", placed)))
        return f"transform(filter({placed}, x -> x.match IS NOT NULL), x -> named_struct('start', x.start, 'end', x.start + length(x.match), 'match', x.match))"
    between = f"string_split_regex({x}, {d.q(pattern)})"
    start = f"coalesce(list_sum(list_transform({between}[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform({ms}[1:i - 1], lambda p: length(p))), 0)"
    return f"list_transform({ms}, lambda m, i: {{'start': {start}, 'end': {start} + length(m), 'match': m}})"


def find(df: DataFrame, pattern: Pattern, text_col: str = "text", out: str = "spans") -> DataFrame:
    """df with the spans of one detector, without Python."""
    risk = RISK[pattern.tier]
    return df.withColumn(out, F.expr(f"transform({offsets(SPARK, text_col, pattern.regex)}, s -> named_struct('start', s.start, 'end', s.end, 'class', {SPARK.q(pattern.name)}, 'match', s.match, 'source', 'regex', 'risk', '{risk}'))"))


def find_all(df: DataFrame, patterns: tuple[Pattern, ...] = (*STRONG, *MEDIUM, *HIPAA, *SECRETS), text_col: str = "text", out: str = "spans", most_chars: int | None = 500) -> DataFrame:
    """df with the spans of all detectors, in order of start and end; overlaps between detectors are kept. ``match`` has the first ``most_chars`` characters.

    A detector is run on texts only that hold what its matches need; if that is words with letters, on texts beyond ASCII always, as letters may fold there.
    """
    df = df.drop(out)
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [(re.compile(p.regex), GUARDS.get(p.regex), p.name, "critical_secret" if p.tier == "secret" else "regex", RISK[p.tier]) for p in patterns]
        not_digits, not_any_digits = re.compile(NOT_DIGITS), re.compile(r"\D+")  # beyond ASCII there are more digits
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), *((k, pa.string()) for k in ("class", "match", "source", "risk"))]))
        for batch in pieces(batches, text_col):
            rows = []
            for text in batch.column(names.index(text_col)).to_pylist():
                seen, text = {}, text or ""
                plain, low = text.isascii(), text.lower()
                digits = (not_digits if plain else not_any_digits).sub(" ", text)
                for rx, guard, name, source, risk in table:
                    if guard and (plain or not guard.folds) and not guard.holds(low, digits, re.search):
                        continue
                    for m in rx.finditer(text):
                        seen.setdefault((m.start(), m.end(), name), {"start": m.start(), "end": m.end(), "class": name, "match": m.group()[:most_chars], "source": source, "risk": risk})
                rows.append([seen[k] for k in sorted(seen)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*names, out])

    kinds = ", ".join(f"`{k}` {v}" for k, v in df.dtypes)
    return df.mapInArrow(work, f"{kinds}, {out} array<{SPAN}>")


def shift(spans: str, by: str) -> str:
    return f"transform({spans}, s -> named_struct('start', s.start + {by}, 'end', s.end + {by}, 'class', s.class, 'match', s.match, 'source', s.source, 'risk', s.risk))"


def distinct(spans: str) -> str:
    """The first span of each (start, end, class), in order: sorted by these and place, compared with the neighbour, and put back."""
    keyed = f"array_sort(transform({spans}, (s, i) -> struct(s.start AS a, s.end AS b, s.class AS c, i AS i, s AS s)))"
    new = "i = 0 OR NOT (x.a <=> get(r, i - 1).a AND x.b <=> get(r, i - 1).b AND x.c <=> get(r, i - 1).c)"
    first = _bound(keyed, "r", f"filter(r, (x, i) -> {new})")
    return f"transform(array_sort(transform({first}, x -> struct(x.i AS i, x.s AS s))), x -> x.s)"


def repair(text: str, spans: str) -> str:
    """Offsets that don't fit their match go to its first exact, else first case-blind, occurrence; else the span goes."""
    fits = f"substring({text}, s.start + 1, s.end - s.start) = s.match OR startswith(substring({text}, s.start + 1), s.match)"
    at = f"CASE WHEN {fits} THEN s.start ELSE coalesce(nullif(locate(s.match, {text}), 0), nullif(locate(lower(s.match), lower({text})), 0)) - 1 END"
    moved = f"transform({spans}, s -> named_struct('start', {at}, 'end', {at} + CASE WHEN {fits} THEN s.end - s.start ELSE length(s.match) END, 'class', s.class, 'match', s.match, 'source', s.source, 'risk', s.risk))"
    return f"filter({moved}, s -> s.start IS NOT NULL)"


def _sorted(spans: str, *keys: str) -> str:
    """Ascending by the keys (expressions over s)."""
    return f"transform(array_sort(transform({spans}, s -> struct({', '.join(keys)}, s AS s))), e -> e.s)"


def for_highlight(spans: list[dict]) -> list[dict]:
    """Disjoint spans, by start: by source priority, then shorter, then earlier, a span stays if it meets none that stayed before."""
    starts, kept = [], []
    for s in sorted(spans, key=lambda s: (-PRIORITY.get(s["source"], 1), s["end"] - s["start"], s["start"])):
        i = bisect_right(starts, s["start"])
        if (i == 0 or kept[i - 1]["end"] <= s["start"]) and (i == len(kept) or s["end"] <= kept[i]["start"]):
            starts.insert(i, s["start"])
            kept.insert(i, s)
    return kept


def for_mask(spans: list[dict]) -> list[dict]:
    """Disjoint spans, by start, chosen from the last one back: after the sort the last that stayed is all there is to meet."""
    kept: list[dict] = []
    for s in sorted(spans, key=lambda s: -s["start"]):
        if not kept or s["end"] <= kept[-1]["start"]:
            kept.append(s)
    return kept[::-1]


def _partial(match: str) -> str:
    return "*" * len(match) if len(match) <= 2 else match[0] + "*" * (len(match) - 2) + match[-1]


#: What stands for a span (its class, the text it covers).
SHOWN: dict[str, Callable[[str, str], str]] = {
    "highlight": lambda c, _: f"[{c.replace('[', '').replace(']', '')[:64]}]", "full": lambda c, _: f"[{c}]", "type_only": lambda c, _: f"[{c.upper()}]", "stars": lambda _, m: "*" * len(m), "partial": lambda _, m: _partial(m),
}


def edited(text: str, spans: list[dict], mode: str) -> str:
    """text with its spans replaced, in one pass: ``highlight``, or a mode of masking."""
    parts, at = [], 0
    for s in (for_highlight if mode == "highlight" else for_mask)(spans):
        parts += [text[at : s["start"]], SHOWN[mode](s["class"], text[s["start"] : s["end"]])]
        at = s["end"]
    return "".join([*parts, text[at:]])


def edit(df: DataFrame, mode: str, text_col: str = "text", spans_col: str = "spans", out: str = "edited") -> DataFrame:
    """df with the text in which spans are highlighted or masked; null texts stay null."""
    df = df.drop(out)
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            texts, spans = (batch.column(names.index(c)).to_pylist() for c in (text_col, spans_col))
            made = [None if t is None else edited(t, s or [], mode) for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*names, out])

    kinds = ", ".join(f"`{k}` {v}" for k, v in df.dtypes)
    return df.mapInArrow(work, f"{kinds}, `{out}` string")


def corroborated(model: str, rules: str) -> str:
    """Whether every model span meets a rule span."""
    return f"forall({model}, m -> exists({rules}, r -> m.start < r.end AND r.start < m.end))"


def overlap_pairs(df: DataFrame, key: str, a: str = "spans", b: str = "spans") -> DataFrame:
    """(key, one, two): pairs of spans of a row that overlap; one starts first."""
    left = df.select(key, F.posexplode(a).alias("i", "one"), F.col(b).alias("_all"))
    return left.select(key, "one", F.explode(F.expr("filter(slice(_all, i + 2, size(_all)), t -> t.start < one.end AND one.start < t.end)")).alias("two"))


def layer_summary(spans: str) -> str:
    """Counts per source."""
    return f"map_from_entries(transform(array_distinct(transform({spans}, s -> s.source)), k -> struct(k, size(filter({spans}, s -> s.source = k)))))"
