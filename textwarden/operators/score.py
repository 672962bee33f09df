"""The composite scorer as a chain of expressions: detectors, severity, score, action.

With no model, ``prob`` is 0 and results are those of the rules alone. Substring tests are on lower-cased text,
not on words: "className" holds "ssn". The order of the levels is part of the meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from textwarden.functions import patterns as P
from textwarden.functions.dialect import SPARK, Dialect, Level, apply
from textwarden.operators.policy import SILENT_MAX, Policy

# Word lists of the rules.
CRITICAL_NAMES = ("ssn", "social security", "credit card", "card number", "api key", "critical secret", "password", "bearer", "jwt", "iban", "routing", "bank account")
CRITICAL_WORDS = ("ssn", "social insurance number", "aadhaar", "aadhar", "national insurance number")
MEDIUM_WORDS = (
    "sales", "finance", "hr", "onboarding", "engineer", "intern", "revenue", "budget", "cost", "expenses", "spend", "forecast",
    "medical leave", "health issue", "surgery", "sick", "on call this week", "extended leave", "billing service", "payments topic",
    "staging cluster", "replica count", "analytics job", "decouple the order and shipping",
)
BUSINESS_WORDS = tuple(w for w in MEDIUM_WORDS if w not in ("onboarding", "engineer", "intern", "sick"))
MEDICAL_WORDS = ("patient", "medical", "diagnosis", "hospital", "mrn", "npi", "dea")
MEDICAL_ID_WORDS = ("name", "treatment id", "patient id", "dob", "identity")
PAYROLL_WORDS = ("bank", "account", "address", "salary", "employee id", "employee ids", "full names", "names")
HARD_NAMES = (
    "ssn", "social security", "credit card", "card number", "api key", "critical secret", "password", "bearer", "jwt", "iban", "routing",
    "bank account", "passport", "private key", "db connection string", "aws_access_key_id", "aws_secret_access_key", "account number",
    "tax id", "ein", "swift", "pan number", "driver's license", "secret_key_base",
)
HARD_WORDS = (
    "aws_access_key_id", "aws_secret_access_key", "-----begin private key-----", "ssn", "dob", "treatment id", "patient id",
    "medical summary", "identity packet", "social insurance number", "national insurance number", "aadhaar", "aadhar",
)
TAX_ID = r"(?i)\b(?:tax\s*id|ein)\s*[:#-]?\s*\d{2}-\d{7}\b"
PAN = r"(?i)\bpan\s*(?:number|no|#)?\s*[:#-]?\s*[a-z]{5}\d{4}[a-z]\b"
LICENSE = r"(?i)\b(?:driver'?s?\s*license|dl)\s*[:#-]?\s*[a-z0-9-]{6,20}\b"
SWIFT = r"(?i)\b[a-z]{4}[a-z]{2}[a-z0-9]{2}(?:[a-z0-9]{3})?\b"
ACCOUNT = r"(?i)\baccount\s*(?:number|no|#)?\s*[:#-]?\s*\d{8,20}\b"
KEY_BASE = r"(?i)secret_key_base\s*[:=]\s*['\"]?[a-z0-9+/=_-]{16,}"
CODE_SIGNS = ("def ", "return ", "class ", "import ", "from ", "select ", " where ", "{", "}", "=>", ";")
CODE_NOT = ("ssn", "card", "iban", "password", "token", "api key", "jwt", "bearer", "email", "phone", "aadhaar", "social insurance", "national insurance")
CONTACT_CLASSES = ("email address", "phone number", "IP address (IPv4)", "IP address (IPv6)")
CONTACT_NOT = ("nhs number", "national insurance number", "national insurance ", "aadhaar", "social insurance number", "canadian social insurance")
# Points of a trigger by the first rule whose words its lower-case name holds.
POINTS = (
    (15, ("passport number",)), (15, ("confidential marker",)), (20, ("salary information",)), (10, ("business context",)),
    (30, ("ssn", "national")), (25, ("credit card", "iban", "bank routing", "routing number", "account", "financial")),
    (15, ("email", "phone", "address")), (15, ("ip address", "ip", "device", "token", "auth", "jwt", "bearer")),
)
FAMILIES = {
    "contact": ("email", "phone", "address", "ip address", "ipv4", "ipv6"),
    "identity": ("name", "person", "location"),
    "finance": ("salary", "financial", "iban", "account", "routing"),
    "health": ("patient", "medical", "mrn", "npi", "dea"),
    "sensitive_context": ("confidential marker", "confidential", "internal only", "proprietary"),
}
HEALTH_WORDS = ("patient", "medical", "diagnosis", "hospital")


def points(trigger: str) -> int:
    t = trigger.lower()
    return next((n for n, words in POINTS if any(w in t for w in words)), 0)


def detectors(kb: tuple[P.Pattern, ...] = ()) -> dict[str, list[P.Pattern]]:
    """Patterns by trigger name, in order; of a knowledge base only its high rules are triggers."""
    out: dict[str, list[P.Pattern]] = {}
    for p in (*P.STRONG, *P.MEDIUM, *(k for k in kb if k.tier == "strong")):
        out.setdefault(p.name, []).append(p)
    return out


#: Columns that guards read: the lower-case text and its runs of digits.
SEEN = ("lowered", "digits")


def seen(x: str) -> Level:
    """The columns that guards read, for Spark."""
    return {SEEN[0]: f"lower({x})", SEEN[1]: f"regexp_replace({x}, '{P.NOT_DIGITS}', ' ')"}


def guarded(d: Dialect, x: str, pattern: str, guard: P.Guard | None, low: tuple[str, str] | None) -> str:
    """Whether x matches; in Spark what any match needs is tested first, where the columns for that are given."""
    test = d.rx(x, pattern)
    if not d.spark or guard is None or low is None:
        return test
    needs = ([d.any(low[0], guard.words)] if guard.words else []) + ([d.rx(low[1], guard.digits)] if guard.digits else [])
    return "(" + " AND ".join([*needs, test]) + ")"


def found(d: Dialect, x: str, ps: list[P.Pattern], low: tuple[str, str] | None = None) -> str:
    return "(" + " OR ".join(guarded(d, x, p.test, P.GUARDS.get(p.test), low) for p in ps) + ")"


def secret(d: Dialect, x: str, bits: float = P.TOKEN_BITS, low: tuple[str, str] | None = None) -> str:
    """A known key format, or a long token of high entropy."""
    tokens = d.all_matches(x, P.TOKEN_RUN if d.spark else P.TOKEN)
    return f"({found(d, x, list(P.SECRETS), low)} OR {d.exists(tokens, 'k', f'{d.entropy('k')} >= {bits}')})"


def override_risk(d: Dialect, x: str, base: str = "'low'", low: tuple[str, str] | None = None) -> str:
    """High with any strong detector; medium ones lift low to med; never lower."""
    return f"CASE WHEN {found(d, x, list(P.STRONG), low)} THEN 'high' WHEN {base} = 'low' AND {found(d, x, list(P.MEDIUM), low)} THEN 'med' ELSE {base} END"


def trigger_score(risk: str, flags: dict[str, str], extra: str = "0") -> str:
    terms = [f"CASE WHEN {flag} THEN {points(name)} ELSE 0 END" for name, flag in flags.items() if points(name)]
    return f"least(100, CASE {risk} WHEN 'high' THEN 70 WHEN 'med' THEN 30 ELSE 0 END + {extra} + {' + '.join(terms)})"


#: What matches of the text rules need.
RULE_GUARDS = {
    TAX_ID: P.Guard(("tax", "ein"), r"\d{2} \d{7}"), PAN: P.Guard(("pan",), r"\d{4}"), LICENSE: P.Guard(("license", "dl")),
    ACCOUNT: P.Guard(("account",), r"\d{8}"), KEY_BASE: P.Guard(("secret_key_base",)),
}


def rule(d: Dialect, t: str, pattern: str) -> str:
    return guarded(d, t, pattern, RULE_GUARDS[pattern], (t, SEEN[1]))


def shared_hard(d: Dialect, t: str) -> str:
    """Text rules that both severity and hard block use."""
    pay = f"({d.has(t, 'payroll')} AND {d.any(t, PAYROLL_WORDS)})"
    staff = f"({d.has(t, 'employee')} AND {d.has(t, 'salary')} AND {d.any(t, ('dob', 'born'))})"
    bonus = f"({d.any(t, ('salary', 'salaries'))} AND {d.has(t, 'bonus')} AND {d.any(t, ('employee id', 'employee ids'))})"
    log = f"({d.has(t, 'debug log')} AND {d.any(t, ('email', 'emails'))} AND {d.any(t, ('id', 'order id', 'order ids'))})"
    swift = f"({d.has(t, 'swift')} AND {d.has(t, 'account')} AND {d.rx(t, SWIFT)})"
    return "(" + " OR ".join([rule(d, t, TAX_ID), rule(d, t, PAN), rule(d, t, LICENSE), swift, pay, staff, bonus, log]) + ")"


def severity(d: Dialect, t: str, merged: str, prob: str, p: Policy, shared: str = "shared") -> str:
    medical = d.any(t, MEDICAL_WORDS)
    return (
        f"CASE WHEN {shared} OR {d.any(merged, CRITICAL_NAMES)} OR {d.any(t, CRITICAL_WORDS)} THEN 'high' "
        f"WHEN {d.any(merged, ('email', 'phone'))} OR {d.any(t, MEDIUM_WORDS)} THEN 'med' "
        f"WHEN {medical} AND ({d.any(merged, ('person', 'name'))} OR {d.any(t, MEDICAL_ID_WORDS)}) OR {d.has(t, 'card ending')} AND {d.has(t, 'cvv')} THEN 'high' "
        f"WHEN {prob} >= {p.block_prob} THEN 'high' WHEN {prob} >= {p.warn_prob} THEN 'med' ELSE 'low' END"
    )


def hard_block(d: Dialect, t: str, merged: str, shared: str = "shared") -> str:
    own = [d.any(merged, HARD_NAMES), f"({d.has(t, 'card ending')} AND {d.has(t, 'cvv')})", rule(d, t, ACCOUNT), rule(d, t, KEY_BASE), d.any(t, HARD_WORDS)]
    return "(" + " OR ".join([shared, *own]) + ")"


def family_count(d: Dialect, t: str, merged: str) -> str:
    tests = [d.any(merged, ws) if k != "health" else f"({d.any(merged, ws)} OR {d.any(t, HEALTH_WORDS)})" for k, ws in FAMILIES.items()]
    return "(" + " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in tests) + ")"


def code_like(d: Dialect, x: str) -> str:
    """Benign code: a code sign and none of the sensitive words."""
    t = f"lower({d.strip(x)})"
    return f"(length({d.strip(x)}) >= 8 AND {d.any(t, CODE_SIGNS)} AND NOT {d.any(t, CODE_NOT)})"


def tiny(x: str, families: str, confidence: str, p: Policy) -> str:
    """Too short and weak a text to act upon."""
    return f"(length({x}) <= 2 AND {families} = 0 OR length({x}) < {p.tiny_chars} AND {confidence} < {p.tiny_confidence} AND {families} = 0)"


def levels(d: Dialect, text: str = "text", prob: str | None = None, policy: Policy | None = None, kb: tuple[P.Pattern, ...] = ()) -> list[Level]:
    p = policy or Policy()
    names = detectors(kb)
    flag = {name: f"t_{i}" for i, name in enumerate(names)}
    hflag = {x.name: f"h_{i}" for i, x in enumerate(P.HIPAA)}
    null = "NULL" if not d.spark else "cast(NULL AS string)"
    listed = d.present([f"CASE WHEN {f} THEN {d.q(n)} ELSE {null} END" for n, f in (flag | hflag).items()])
    hipaa = "(" + " OR ".join(hflag.values()) + ")"
    fam, conf = "families", "CASE WHEN critical THEN 0 ELSE greatest(prob, 1 - prob) END"
    return [
        {"stripped": f"coalesce({d.strip(text)}, '')", "prob": f"coalesce(cast({prob} AS double), 0)" if prob else "cast(0 AS double)"},
        seen("stripped") if d.spark else {"lowered": "lower(stripped)"},
        {"critical": secret(d, "stripped", p.token_bits, SEEN)}
        | {f: found(d, "stripped", names[n], SEEN) for n, f in flag.items()} | {f: found(d, "stripped", [x], SEEN) for x, f in zip(P.HIPAA, hflag.values(), strict=True)},
        {"listed": listed, "shared": shared_hard(d, "lowered")},
        {"merged0": f"lower({d.join('listed', ' | ')})"},
        {"severity0": f"CASE WHEN critical THEN 'high' ELSE {severity(d, 'lowered', 'merged0', 'prob', p)} END"},
        {"business": f"(NOT critical AND severity0 = 'med' AND {d.size('listed')} = 0 AND length(stripped) > 8 AND {d.any('lowered', BUSINESS_WORDS)})"},
        {"triggers": f"CASE WHEN business THEN {d.list(d.q('business context'))} WHEN critical AND {d.size('listed')} = 0 THEN {d.list(d.q('critical_secret'))} ELSE listed END",
         "risk1": f"CASE WHEN {hipaa} THEN 'high' ELSE severity0 END"},
        {"merged": f"lower({d.join('triggers', ' | ')})",
         "score0": f"greatest(cast({'rint' if d.spark else 'round_even'}(least(1, greatest(0, prob)) * 100{'' if d.spark else ', 0'}) AS int), {trigger_score('risk1', flag, 'CASE WHEN business THEN 10 ELSE 0 END')}, CASE WHEN {hipaa} THEN 95 ELSE 0 END)"},
        {"hard": f"(critical OR {hard_block(d, 'lowered', 'merged')})", "families": family_count(d, "lowered", "merged")},
        {"multi": f"({'true' if p.strict else 'false'} AND families >= {p.families})", "tiny": tiny("stripped", fam, conf, p),
         "zone": f"CASE WHEN critical OR prob >= {p.block_prob} THEN 'block' WHEN prob >= {p.warn_prob} THEN 'warn' ELSE 'allow' END"},
        {"code": f"(NOT hard AND NOT multi AND risk1 = 'med' AND NOT {hipaa} AND {d.size('triggers')} = 0 AND {code_like(d, 'stripped')})"},
        {"weak": f"(NOT hard AND NOT multi AND NOT code AND {'true' if p.strict else 'false'} AND risk1 = 'med' AND zone = 'block' AND tiny)"},
        {"risk2": "CASE WHEN hard THEN 'high' WHEN multi AND risk1 = 'low' THEN 'med' WHEN code OR weak THEN 'low' ELSE risk1 END",
         "score1": "greatest(CASE WHEN code THEN least(score0, 10) WHEN weak THEN least(score0, 20) ELSE score0 END, CASE WHEN hard THEN 90 WHEN multi THEN 80 ELSE 0 END)"},
        {"decision1": f"CASE WHEN hard OR multi OR {hipaa} OR score1 >= {p.block_score} THEN 'block' WHEN code OR weak THEN 'allow' ELSE zone END"},
        {"action1": "CASE WHEN critical THEN 'block' WHEN risk2 = 'low' THEN 'silent' WHEN risk2 = 'med' THEN CASE WHEN tiny THEN 'silent' ELSE 'warn' END WHEN hard THEN 'block' WHEN decision1 = 'allow' THEN 'silent' ELSE decision1 END"},
        {"score2": "CASE WHEN action1 = 'silent' AND tiny THEN least(score1, 20) ELSE score1 END",
         "contact_only": f"(NOT critical AND ({' OR '.join(flag[c] for c in CONTACT_CLASSES)}) AND NOT ({' OR '.join(f for n, f in (flag | hflag).items() if n not in CONTACT_CLASSES)}) AND NOT {d.any('lowered', CONTACT_NOT)})"},
        {"capped": f"(contact_only AND score2 > {p.contact_cap})"},
        {"score3": f"CASE WHEN capped THEN {p.contact_cap} ELSE score2 END", "action2": "CASE WHEN capped THEN 'warn' ELSE action1 END"},
        {"blank": "stripped = ''", "action3": f"CASE WHEN critical OR action2 = 'block' THEN 'block' WHEN zone = 'allow' AND action2 = 'silent' THEN 'silent' WHEN score3 > {SILENT_MAX} THEN 'warn' ELSE 'silent' END"},
        {"risk": "CASE WHEN blank THEN 'low' ELSE risk2 END", "risk_score": "cast(CASE WHEN blank THEN 0 ELSE score3 END AS int)", "action": "CASE WHEN blank THEN 'silent' ELSE action3 END"},
        {"decision": "CASE action WHEN 'silent' THEN 'allow' ELSE action END"},
    ]


def score(df: DataFrame, text_col: str = "text", prob_col: str | None = None, policy: Policy | None = None, kb: tuple[P.Pattern, ...] = ()) -> DataFrame:
    """df with risk, risk_score, action, decision, triggers, critical_secret, prob."""
    work = apply(df, levels(SPARK, text_col, prob_col, policy, kb))
    return work.selectExpr(*[f"`{c}`" for c in df.columns], "risk", "risk_score", "action", "decision", "triggers", "critical AS critical_secret", "prob AS prob_risky")
