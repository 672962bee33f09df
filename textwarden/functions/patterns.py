"""The detector library: names, patterns, tiers.

Patterns are in the common subset of Java and RE2, except two that need look-ahead; for these
``plain`` gives a form that is true for the same texts. Python's verbose patterns are written out.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    tier: str  # strong, medium, critical or secret
    plain: str | None = None

    @property
    def test(self) -> str:
        return self.plain or self.regex


# Detector names and patterns that results depend on, in match order.
STRONG = (
    Pattern("SSN pattern", r"(?i)(?:\b\d{3}[-\s*]?\d{2}[-\s*]?\d{4}\b|(?:ssn|social\s*security(?:\s*number)?|tax\s*id)\s*[:#-]?\s*\d{3}[-\s*]?\d{2}[-\s*]?\d{3,4}\b)", "strong"),
    Pattern("credit card pattern", r"\b(?:\d[-\s]*){12,19}\d\b", "strong"),
    Pattern("IBAN", r"(?i)\b[A-Z]{2}\d{2}\s?[A-Z0-9]{4}\s?[A-Z0-9]{4}\s?[A-Z0-9]{4,14}\b", "strong"),
    Pattern("bank routing number", r"\b\d{9}\b", "strong"),
    Pattern("phone number", r"\b(?:\+?1[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]?\d{3}[-.\s]?\d{4}\b", "strong"),
    Pattern("email address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "strong"),
    Pattern("IP address (IPv4)", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|1?\d\d?)\b", "strong"),
    Pattern("IP address (IPv6)", r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b", "strong"),
    Pattern("Passport number", r"(?i)passport\s*(?:number|no|#|num)?\s*[:.]?\s*(?:[A-Z]{1,3}\s+)?[A-Z]{1,2}\d{6,9}", "strong"),
    Pattern("Passport number", r"(?i)\b[A-Z]{1,2}\d{6,9}\b(?=.*(?:passport|travel\s*doc))", "strong", r"(?i)\b[A-Z]{1,2}\d{6,9}\b.*(?:passport|travel\s*doc)"),
    Pattern("Social insurance number", r"(?i)\b(?:social\s+insurance\s+number|sin)\s*[:#-]?\s*\d{3}[-\s]?\d{3}[-\s]?\d{3}\b", "strong"),
    Pattern("Aadhaar number", r"(?i)\b(?:aadhaar|aadhar)\s*(?:number|no|#)?\s*[:#-]?\s*\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "strong"),
    Pattern("National insurance number", r"(?i)\b(?:national\s*insurance(?:\s*number)?|ni\s*number)\s*[:#-]?\s*[A-CEGHJ-PR-TW-Z]{2}\s*\d{2}\s*\d{2}\s*\d{2}\s*[A-D]\b", "strong"),
    Pattern("card ending + CVV", r"(?i)card\s+ending[^\\n]{0,40}\d{4}[^\\n]{0,40}\bcvv\b[^\\n]{0,20}\d{3,4}", "strong"),
)
MEDIUM = (
    Pattern("street address", r"\d{2,5}\s+[A-Za-z][A-Za-z\s]{2,30},\s*[A-Za-z\s]+,?\s+[A-Z]{2}\s+\d{5}", "medium"),
    Pattern("international phone", r"\+\d{1,3}[\s\-\.]?\(?\d{1,4}\)?[\s\-\.]?\d{3,12}", "medium"),
    Pattern("Street address", r"(?i)\d+\s+[a-z]+\s+(?:street|st|avenue|ave|road|rd|drive|dr|lane|ln|blvd|boulevard|way|court|ct)\b", "medium"),
    Pattern("CVV number", r"(?i)\bcvv\b.{0,30}\d{3,4}", "medium"),
    Pattern("Partial card", r"(?i)card\s+ending\s+in\s+\d{4}", "medium"),
    Pattern("Confidential marker", r"(?i)(?:confidential|internal\s+only|trade\s+secret|proprietary)", "medium"),
    Pattern("Salary information", r"(?i)salary\s*[:.]?\s*\$[\d,]+", "medium"),
)
HIPAA = (
    Pattern("Medical Record Number (MRN)", r"(?i)\b(?:mrn|medical\s*record(?:\s*number)?)\s*(?:[:#-]|\bis\b)?\s*\d{5,12}\b", "critical"),
    Pattern("DEA number", r"(?i)\bdea(?:\s*(?:number|no|#))?\s*[:#-]?\s*[A-Z]{2}\d{7}\b", "critical"),
    Pattern("NPI", r"(?i)\bnpi(?:\s*(?:number|no|#))?\s*[:#-]?\s*\d{10}\b", "critical"),
    Pattern("Health Plan ID", r"(?i)\b(?:member|beneficiary|policy)\s*(?:id|identifier|number|no|#)?\s*[:#-]?\s*[A-Z0-9][A-Z0-9-]{4,24}\b", "critical"),
    Pattern("Age over 89", r"(?i)\b(?:age\s*[:#-]?\s*(?:9\d|1[01]\d|12\d)\b|aged\s+(?:9\d|1[01]\d|12\d)\b|(?:9\d|1[01]\d|12\d)[-\s]?year[-\s]?old\b|(?:9\d|1[01]\d|12\d)\s+years?\s+old\b)", "critical"),
)
SECRETS = (
    Pattern("Critical secret", r"(?i)sk-(?:live|test|proj)-[A-Za-z0-9]{20,}", "secret"),
    Pattern("Critical secret", r"sk-[A-Za-z0-9]{20,}", "secret"),
    Pattern("Critical secret", r"(?i)rk_live_[A-Za-z0-9]{10,}", "secret"),
    Pattern("Critical secret", r"AKIA[0-9A-Z]{16}", "secret"),
    Pattern("Critical secret", r"ASIA[0-9A-Z]{16}", "secret"),
    Pattern("Critical secret", r"ghp_[A-Za-z0-9]{36,}", "secret"),
    Pattern("Critical secret", r"gho_[A-Za-z0-9]{36,}", "secret"),
    Pattern("Critical secret", r"(?i)github_pat_[A-Za-z0-9_]{20,}", "secret"),
    Pattern("Critical secret", r"(?i)xox[baprs]-[A-Za-z0-9-]{10,}", "secret"),
    Pattern("Critical secret", r"AIza[Sy][A-Za-z0-9_-]{30,}", "secret"),
    Pattern("Critical secret", r"ya29\.[A-Za-z0-9_-]+", "secret"),
    Pattern("Critical secret", r"(?i)Bearer\s+[A-Za-z0-9._-]{24,}", "secret"),
    Pattern("Critical secret", r"(?i)(?:api[_-]?key|apikey)\s*[:=]\s*['\"]?[A-Za-z0-9._-]{16,}", "secret"),
    Pattern("Critical secret", r"(?i)SECRET_KEY_BASE\s*[:=]\s*['\"]?[A-Za-z0-9+/=_-]{16,}", "secret"),
    Pattern("Critical secret", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "secret"),
    Pattern("Password credential", r"(?i)(?:db_password|password|pwd|passwd)\s*[=:]\s*\S{6,}", "secret"),
    Pattern("SSH private key", r"-----BEGIN\s+(?:RSA\s+|EC\s+|OPENSSH\s+)?PRIVATE\s+KEY-----", "secret"),
    Pattern("DB connection string", r"(?:mongodb|mysql|postgres|postgresql|redis|mssql)://[A-Za-z0-9_]+:[^@\s]+@", "secret"),
)
#: Runs that may be keys, and the entropy from which they are. Spark looks behind first, so that a start inside a run fails at once.
TOKEN, TOKEN_BITS = r"[A-Za-z0-9+/=_-]{36,}", 4.2
TOKEN_RUN = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{36,}"
# The patterns of the demo's rule layer.
DEMO = {
    "SSN": r"(?i)\b\d{3}-\d{2}-\d{4}\b",
    "Credit Card": r"(?i)\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "Email": r"(?i)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "Phone": r"(?i)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "IP Address": r"(?i)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "API Key": r"(?i)(?:sk-[a-zA-Z0-9]{20,}|AKIA[A-Z0-9]{16}|ghp_[a-zA-Z0-9]{36})",
    "AWS Key": r"(?i)AKIA[0-9A-Z]{16}",
    "JWT": r"(?i)eyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]+",
    "MRN": r"(?i)\b(?:MRN|Medical Record|Med Rec|Chart)\s*#?\s*:?\s*\d{5,12}\b",
    "DEA Number": r"(?i)\bDEA\s*#?\s*:?\s*[A-Z]{2}\d{7}\b",
    "NPI": r"(?i)\bNPI\s*#?\s*:?\s*\d{10}\b",
    "Date (MM/DD/YYYY)": r"(?i)\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b",
}
# Which of them block and which warn.
DEMO_CRITICAL = ("SSN", "Credit Card", "API Key", "AWS Key", "JWT", "MRN", "DEA Number")
DEMO_MEDIUM = ("Email", "Phone", "IP Address", "Date (MM/DD/YYYY)")
# What makes a mail high, and pairs of words that may be names.
MAIL_HIGH = (
    r"\b\d{3}-\d{2}-\d{4}\b|\b\d{3}\s+\d{2}\s+\d{4}\b",
    r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
    r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s/]?[0-9]{3}[-.\s/]?[0-9]{4}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
)
TITLE_PAIR = r"\b[A-Z][a-z]{2,14}\s+[A-Z][a-z]{2,14}\b"
TITLE_STOP = (
    "the", "and", "but", "for", "not", "are", "was", "has", "his", "her", "its", "our", "all", "this", "that", "with",
    "from", "have", "been", "will", "your", "any", "can", "may", "did", "get", "got", "she", "him", "they", "who",
    "how", "out", "one", "two", "per", "via",
)
# Placeholders of the leakage fingerprint, in the order they are put in.
FINGERPRINT = (
    (r"(?i)\b[0-9a-f]{8,}\b", "<hex>"),
    (r"(?i)\b[A-Z]{2,5}[-_ ]?\d{3,}\b", "<id>"),
    (r"\b\d{2,}\b", "<num>"),
    (r"(?i)\b[0-9a-z._%+-]+@[0-9a-z.-]+\.[a-z]{2,}\b", "<email>"),
    (r"\b(?:\+?\d[\d\-\s().]{7,}\d)\b", "<phone>"),
    (r"\s+", " "),
)
# Categories by the first group of words of which the text has one.
CATEGORIES = (
    ("ID", ("mrn", "ssn", "passport", "license", "npi", "dea", "id", "token")),
    ("FINANCIAL", ("account", "iban", "routing", "card", "salary", "bank", "payment")),
    ("HEALTH", ("patient", "diagnosis", "hospital", "medication", "therapy")),
    ("AUTH", ("password", "api key", "jwt", "bearer", "secret")),
    ("CONTACT", ("email", "phone", "ip", "@")),
    ("LOCATION", ("street", "address", "city", "location", "avenue")),
    ("NAME", ("name", "mr ", "ms ", "dr ")),
)


@dataclass(frozen=True)
class Guard:
    """What any match needs, tested before the pattern: one of ``words`` in the lower-case text, and ``digits`` in its runs of digits."""

    words: tuple[str, ...] = ()
    digits: str = ""

    @property
    def folds(self) -> bool:
        """Whether letters beyond ASCII may stand for those of ``words``."""
        return any(w.upper() != w for w in self.words)

    def holds(self, low: str, digits: str, find) -> bool:
        return (not self.words or any(w in low for w in self.words)) and (not self.digits or find(self.digits, digits) is not None)


def _guards(patterns: tuple[Pattern, ...], *guards: Guard) -> dict[str, Guard]:
    return {p.test: g for p, g in zip(patterns, guards, strict=True)} | {p.regex: g for p, g in zip(patterns, guards, strict=True)}


#: Runs of digits are compared in a text in which all else has become single spaces.
GUARDS = (
    _guards(
        STRONG, Guard(digits=r"\d{3} ?\d{2} ?\d{3}"), Guard(digits=r"(?:\d ?){12}\d"), Guard(digits=r"\d{2}"), Guard(digits=r"\d{9}"), Guard(digits=r"\d{3} ?\d{3} ?\d{4}"),
        Guard(("@",)), Guard(digits=r"\d \d{1,3} \d{1,3} \d"), Guard((":",)), Guard(("passport",), r"\d{6}"), Guard(("passport", "travel"), r"\d{6}"),
        Guard(("insurance", "sin"), r"\d{3} ?\d{3} ?\d{3}"), Guard(("aadha",), r"\d{4} ?\d{4} ?\d{4}"), Guard(("insurance", "ni"), r"\d{2} ?\d{2} ?\d{2}"), Guard(("cvv",), r"\d{4}"),
    )
    | _guards(
        MEDIUM, Guard((",",), r"\d{5}"), Guard(("+",), r"\d"), Guard(digits=r"\d"), Guard(("cvv",), r"\d{3}"), Guard(("card",), r"\d{4}"),
        Guard(("confidential", "internal", "trade", "proprietary")), Guard(("salary",)),
    )
    | _guards(HIPAA, Guard(("mrn", "medical"), r"\d{5}"), Guard(("dea",), r"\d{7}"), Guard(("npi",), r"\d{10}"), Guard(("member", "beneficiary", "policy")), Guard(("age", "old"), r"9\d|1\d\d"))
    | _guards(
        SECRETS, Guard(("sk-",)), Guard(("sk-",)), Guard(("rk_live_",)), Guard(("akia",)), Guard(("asia",)), Guard(("ghp_",)), Guard(("gho_",)), Guard(("github_pat_",)), Guard(("xox",)),
        Guard(("aiza",)), Guard(("ya29.",)), Guard(("bearer",)), Guard(("apikey", "api_key", "api-key")), Guard(("secret_key_base",)), Guard(("eyj",)), Guard(("password", "passwd", "pwd")),
        Guard(("-----begin",)), Guard(("://",)),
    )
)
#: All runs of other characters become one space.
NOT_DIGITS = "[^0-9]+"
