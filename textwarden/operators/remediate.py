"""Masking, hashing and encryption of matches, without Python.

One pattern's matches are replaced by splitting the text at them and joining the parts with
the replacements between; patterns are applied in order, each on what the one before has left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarden.functions.dialect import SPARK, Dialect
from textwarden.functions.patterns import STRONG

ORDER = (("ssn", 0), ("cc", 1), ("iban", 2), ("routing", 3), ("email", 5), ("ipv4", 6))


def last_four(d: Dialect, m: str) -> str:
    digits = d.sub(m, "[^0-9]", "")
    return f"CASE WHEN {digits} = '' THEN '****' ELSE right({digits}, 4) END"


def masked(d: Dialect, kind: str, m: str) -> str:
    if kind == "ssn":
        return f"concat('***-**-', {last_four(d, m)})"
    if kind in ("cc", "iban", "routing"):
        return f"concat('**** **** **** ', {last_four(d, m)})"
    if kind == "ipv4":
        return f"concat('***.***.***.', {d.sub(m, '^.*[.]', '')})"
    user, rest = d.sub(m, "@.*$", ""), d.sub(m, "^[^@]*@", "")
    return f"concat(CASE WHEN length({user}) <= 2 THEN repeat('*', length({user})) ELSE concat(left({user}, 1), repeat('*', length({user}) - 2), right({user}, 1)) END, '@', {rest})"


def hashed(d: Dialect, m: str) -> str:
    return f"concat('HASH::', left({f'sha2({m}, 256)' if d.spark else f'sha256({m})'}, 16))"


def replace_matches(d: Dialect, x: str, pattern: str, form) -> str:
    """x with each match m of the pattern replaced by form(d, m)."""
    ms = d.all_matches(x, pattern)
    if d.spark:
        return f"array_join(zip_with(split({x}, {d.q(pattern)}, -1), {ms}, (p, m) -> concat(coalesce(p, ''), coalesce({form(d, 'm')}, ''))), '')"
    return f"array_to_string(list_transform(list_zip(string_split_regex({x}, {d.q(pattern)}), {ms}), lambda z: concat(coalesce(z[1], ''), CASE WHEN z[2] IS NULL THEN '' ELSE {form(d, 'z[2]')} END)), '')"


def steps(d: Dialect, x: str, form) -> list[dict[str, str]]:
    """Levels r0, r1, ... that apply the patterns in turn; form(kind) gives the replacement."""
    out, last = [], x
    for i, (kind, at) in enumerate(ORDER):
        out.append({f"r{i}": f"CASE WHEN {d.rx(last, STRONG[at].regex)} THEN {replace_matches(d, last, STRONG[at].regex, form(kind))} ELSE {last} END"})
        last = f"r{i}"
    return out


def mask_steps(d: Dialect, x: str) -> list[dict[str, str]]:
    return steps(d, x, lambda kind: lambda d2, m: masked(d2, kind, m))


def hash_steps(d: Dialect, x: str) -> list[dict[str, str]]:
    return steps(d, x, lambda kind: hashed)


LAST = f"r{len(ORDER) - 1}"


def _key(password: str) -> Column:
    return F.unhex(F.sha2(F.lit(password), 256))


def encrypt(text: Column, password: str) -> Column:
    """Authenticated encryption under the password's SHA-256; not deterministic."""
    return F.base64(F.aes_encrypt(F.encode(text, "utf-8"), _key(password), F.lit("GCM")))


def decrypt(token: Column, password: str) -> Column:
    return F.decode(F.aes_decrypt(F.unbase64(token), _key(password), F.lit("GCM")), "utf-8")


def remediate(df, action: str, text_col: str = "text", out: str = "safe_text", password: str | None = None):
    """mask or redact, hash, encrypt; any other action leaves the text."""
    from textwarden.functions.dialect import apply

    if action in ("mask", "redact", "hash"):
        work = apply(df, (hash_steps if action == "hash" else mask_steps)(SPARK, text_col))
        return work.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col(LAST).alias(out))
    if action == "encrypt":
        if not password:
            raise ValueError("encrypt needs a password")
        return df.withColumn(out, encrypt(F.col(text_col), password))
    return df.withColumn(out, F.col(text_col))
