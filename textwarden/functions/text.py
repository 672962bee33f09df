"""Text and number functions, each as an SQL expression in a dialect."""

from __future__ import annotations

from textwarden.functions import patterns as P
from textwarden.functions.dialect import Dialect


def fingerprint(d: Dialect, x: str) -> str:
    """Text with identifiers, numbers, addresses and phones as placeholders; equal for templates filled differently."""
    out = f"lower({d.strip(x)})"
    for pattern, to in P.FINGERPRINT:
        out = d.sub(out, pattern, to)
    return d.strip(out)


def audit_key(d: Dialect, x: str) -> str:
    return f"md5({d.sub(f'lower({d.strip(x)})', chr(92) + 's+', ' ')})"


def words_key(d: Dialect, x: str) -> str:
    """Lower-case letters and digits with single spaces."""
    return d.strip(d.sub(f"lower({x})", "[^a-z0-9]+", " "))


def token_set(d: Dialect, x: str) -> str:
    key = words_key(d, x)
    return f"filter(array_distinct(split({key}, ' ')), e -> e <> '')" if d.spark else f"list_filter(list_distinct(string_split({key}, ' ')), lambda e: e <> '')"


def text_hash(d: Dialect, x: str) -> str:
    return f"sha2({d.strip(x)}, 256)" if d.spark else f"sha256({d.strip(x)})"


def squeeze(d: Dialect, x: str) -> str:
    return d.strip(d.sub(x, r"\s+", " "))


def n_words(d: Dialect, x: str) -> str:
    return d.count(x, r"\S+")


def category(d: Dialect, x: str) -> str:
    return "CASE " + " ".join(f"WHEN {d.any(f'lower({x})', ws)} THEN '{c}'" for c, ws in P.CATEGORIES) + " ELSE 'OTHER_PII' END"


def risk_name(d: Dialect, x: str) -> str:
    """low, med, high from the names in use; null for others."""
    return f"CASE lower({d.strip(x)}) WHEN 'low' THEN 'low' WHEN 'med' THEN 'med' WHEN 'medium' THEN 'med' WHEN 'high' THEN 'high' WHEN 'critical' THEN 'high' WHEN 'crit' THEN 'high' END"


LABEL_RISK = {"NAME": "med", "LOCATION": "med", "CONTACT": "high", "ID": "high", "FINANCIAL": "high", "HEALTH": "high", "AUTH": "high", "OTHER_PII": "high"}
PLAIN_LABEL_RISK = {"NAME": "low", "LOCATION": "low", "CONTACT": "med", "ID": "med", "OTHER_PII": "med", "FINANCIAL": "high", "HEALTH": "high", "AUTH": "high"}
TRAINING_RISK = {"O": "low", "SAFE": "low", "NONE": "low", "FINANCIAL": "high", "HEALTH": "high", "AUTH": "high", "ID": "high"}


def mapped(x: str, table: dict[str, str], other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


def ci95(p: str, n: str) -> tuple[str, str]:
    half = f"1.96 * sqrt({p} * (1 - {p}) / {n})"
    return f"{p} - {half}", f"{p} + {half}"
