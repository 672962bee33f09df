"""Small extractors: contextual phrases, knowledge-base candidates, titles, type names, quoted strings."""

from __future__ import annotations

from textwarden.functions.dialect import Dialect
from textwarden.operators.spans import offsets

# Phrases, seeds, stop words and name tables.
CONTEXT = {"full_name": r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", "date": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "age_phrase": r"(?i)\b(?:age[d]?\s+\d{1,3}|\d{1,3}\s+years?\s+old)\b"}
SEEDS = {
    "hipaa": ("patient", "PHI", "medical record", "diagnosis", "treatment", "MRN", "health information", "covered entity"),
    "pci": ("cardholder", "PAN", "SAD", "primary account", "CVV", "expiry", "payment card", "magnetic stripe"),
    "gdpr": ("data subject", "personal data", "consent", "right to erasure", "data controller", "DPA"),
    "legal": ("privileged", "confidential", "attorney-client", "work product", "settlement", "litigation"),
}
ACRONYM_STOP = ("AND", "THE", "FOR", "NOT", "ARE")
SUFFIXES = (" - microsoft edge", " - brave", " - google chrome", " - chrome", " - edge", " - comet", " - firefox")
ASSISTANTS = (
    ("comet", "Comet"), ("perplexity", "Perplexity"), ("claude.ai", "Claude"), ("chat.openai.com", "ChatGPT"), ("gemini.google.com", "Gemini"),
    ("copilot.microsoft.com", "Copilot"), ("poe.com", "Poe"), ("chatgpt.com", "ChatGPT"), ("anthropic.com", "Claude"), ("chatgpt", "ChatGPT"),
    ("gemini", "Gemini"), ("copilot", "Copilot"), ("mistral", "Mistral"), ("grok", "Grok"), ("ollama", "Llama"), ("llama", "Llama"), ("openai", "Openai"),
    ("anthropic", "Anthropic"), ("hugging", "Hugging"), ("together", "Together"),
)
ASSISTANT_WORDS = (("claude", "Claude"), ("poe", "Poe"))
PHI_TYPES = {
    "CONTACT": ("CONTACT",), "ID": ("ID",), "FINANCIAL": ("FINANCIAL",), "HEALTH": ("HEALTH",), "AUTH": ("AUTH",), "OTHER_PII": ("OTHERPII",),
    "NAME": ("NAME", "PERSON"), "DATE": ("DATE", "DOB"), "MRN": ("MRN", "MEDICALRECORDNUMBER"), "SSN": ("SSN", "SOCIALSECURITY"),
    "PHONE": ("PHONE", "PHONENUMBER", "TELEPHONE"), "EMAIL": ("EMAIL", "EMAILADDRESS"), "AGE": ("AGE",), "LOCATION": ("LOCATION", "ADDRESS", "GPE", "LOC"),
    "HEALTHPLAN": ("HEALTHPLAN", "INSURANCE"), "ACCOUNT": ("ACCOUNT", "ACCOUNTNUMBER"), "LICENSE": ("LICENSE", "DEA", "NPI"), "VEHICLE": ("VEHICLE",),
    "DEVICE": ("DEVICE", "SERIALNUMBER"), "URL": ("URL", "URI"), "IP": ("IP", "IPADDRESS"), "BIOMETRIC": ("BIOMETRIC", "FINGERPRINT"), "PHOTO": ("PHOTO", "IMAGE"), "FAX": ("FAX",),
}
BENCHMARK_TYPES = ((("ssn", "insurance number", "aadhaar"), "SSN"), (("email", "phone"), "CONTACT"), (("passport",), "ID"), (("routing", "iban", "card"), "FINANCIAL"), (("ip",), "CONTACT"))


#: A sentence goes up to its end mark or line end.
SENTENCE = r"[^.!?\n]+[.!?\n]?"


def sentence_spans(d: Dialect, x: str) -> str:
    """List of (start, end, match) of the sentences that aren't blank."""
    found = offsets(d, x, SENTENCE)
    test = f"{d.strip('s.match')} <> ''"
    return f"filter({found}, s -> {test})" if d.spark else f"list_filter({found}, lambda s: {test})"


def first_match(d: Dialect, x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, {d.q(pattern)}, 0), '')"


def seed_sentences(d: Dialect, x: str, category: str, least: int = 10, most: int = 200) -> str:
    """Sentences of usable length that hold a seed of the category. Seeds with capitals never match, as sentences are lowered first."""
    parts = f"split({x}, {d.q('[.!?' + chr(10) + ']+')})" if d.spark else f"string_split_regex({x}, {d.q('[.!?' + chr(10) + ']+')})"
    s = d.strip("s")
    test = f"length({s}) BETWEEN {least} AND {most} AND {d.any(f'lower({s})', SEEDS[category])}"
    kept = f"filter({parts}, s -> {test})" if d.spark else f"list_filter({parts}, lambda s: {test})"
    return d.map(kept, "s", f"left({s}, 100)")


def acronyms(d: Dialect, x: str, most: int = 20) -> str:
    """Up to ``most`` distinct runs of three or more capitals in order, but for stop words."""
    found = d.all_matches(d.ascii_bounds(x), r"\b[A-Z]{3,}\b")
    stop = ", ".join(f"'{w}'" for w in ACRONYM_STOP)
    if d.spark:
        return f"filter(slice(array_distinct({found}), 1, {most}), w -> w NOT IN ({stop}))"
    order = f"list_filter({found}, lambda w, i: list_position({found}, w) = i)"
    return f"list_filter(({order})[1:{most}], lambda w: w NOT IN ({stop}))"


def clean_title(d: Dialect, x: str) -> str:
    """A window title without invisible characters, browser names and the count of other pages."""
    t = d.strip(d.sub(x, "[​‌‍﻿]", ""))
    ends = "|".join(s.replace(" ", r"\s") for s in SUFFIXES)
    t = d.strip(d.sub(t, f"(?i)(?:{ends})$", ""))
    return d.strip(d.sub(t, r"(?i)\s+and\s+\d+\s+more\s+pages?$", ""))


def assistant(d: Dialect, x: str) -> str:
    """Label of the assistant that a title or address names; '' for none. The first rule wins."""
    t = f"lower({x})"
    cases = [f"WHEN {d.has(t, n)} THEN '{label}'" for n, label in ASSISTANTS] + [f"WHEN {d.rx(t, rf'\b{n}\b')} THEN '{label}'" for n, label in ASSISTANT_WORDS]
    return f"CASE {' '.join(cases)} ELSE '' END"


def title_assistant(d: Dialect, x: str) -> str:
    """The label from the raw title, else from the cleaned one."""
    return f"coalesce(nullif({assistant(d, x)}, ''), {assistant(d, clean_title(d, x))})"


def phi_type(d: Dialect, x: str) -> str:
    key = d.sub(f"upper({d.strip(x)})", "[-_]", "")
    return "CASE " + " ".join(f"WHEN {key} IN ({', '.join(f"'{n}'" for n in names)}) THEN '{t}'" for t, names in PHI_TYPES.items()) + " ELSE 'NONE' END"


def benchmark_type(d: Dialect, x: str) -> str:
    return "CASE " + " ".join(f"WHEN {d.any(f'lower({x})', words)} THEN '{t}'" for words, t in BENCHMARK_TYPES) + " ELSE 'ID' END"


def quoted(d: Dialect, x: str, least: int = 20) -> str:
    """Strings of at least so many characters in single or double quotes, without the quotes."""
    found = d.all_matches(x, f'"[^"{chr(10)}]{{{least},}}"|' + f"'[^'{chr(10)}]{{{least},}}'")
    return d.map(found, "q", "substring(q, 2, length(q) - 2)")
