"""Readers of labelled text, events and documents in the formats in use, and the matching writers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden.functions import text as X
from textwarden.functions.dialect import SPARK
from textwarden.sources import office

# For each corpus the column names tried in order for text and label, and what a row without a label gets.
CORPORA = {
    "enterprise": (("text", "content", "excerpt", "prompt", "input"), ("sensitivity", "label", "risk", "category", "classification"), "med"),
    "business": (("text", "content", "excerpt", "prompt", "input", "body"), ("risk", "label", "category", "classification", "sensitivity"), None),
    "tabular": (("text", "content", "excerpt", "prompt", "input", "description", "body"), ("risk", "label", "category", "classification", "sensitivity"), None),
}
MAIL_KEYS = ("text", "content", "body", "excerpt", "prompt", "input", "message")
SECRET_KEYS, SECRET_FLAGS = ("text", "snippet", "code"), ("is_positive", "positive", "is_secret")
HUB_KEYS, HUB_FLAGS = ("text", "snippet", "code", "content", "statement", "line"), ("label", "leak", "is_secret", "in_clean_set", "vulnerable")
HUB_CLEAN = ("0", "FALSE", "CLEAN", "NEGATIVE", "SAFE", "BENIGN")
# Label maps.
SENSITIVITY = {
    "public": "low", "internal": "low", "low": "low", "confidential": "med", "medium": "med", "med": "med",
    "restricted": "high", "sensitive": "high", "high": "high",
}
EXPECTED = {"safe": "silent", "low": "silent", "med": "warn", "medium": "warn", "risky": "block", "high": "block", "critical": "block"}
# Column names of the finance workbook, and its labels' risks, in the order they are tried.
FINANCE_TEXT, FINANCE_LABEL = ("text", "sentence", "content", "document"), ("label", "category", "pii_type", "class")
FINANCE_RISK = {
    "ssn": "high", "social_security": "high", "credit_card": "high", "card": "high", "passport": "high", "account": "high", "iban": "high", "auth": "high",
    "password": "high", "api_key": "high", "name": "med", "person": "med", "phone": "med", "email": "med", "address": "med", "location": "med", "dob": "med",
    "date_of_birth": "med", "o": "low", "none": "low", "non-pii": "low", "safe": "low",
}
# Files of the curated pools, their risk (per line where there is none) and source; rows of a file.
EXTRA_POOLS = (
    ("high_extra.jsonl", "high", "extra_pool_high"), ("hard_negative_low.jsonl", "low", "extra_pool_hard_low"), ("hard_negative_med.jsonl", "med", "extra_pool_hard_med"),
    ("weak_category_examples.jsonl", None, "extra_pool_weak_cat"), ("contextual_embedded_pii.jsonl", None, "extra_pool_contextual_pii"),
)
EXTRA_POOL_ROWS = 8000
# Classes from the lowest to the highest priority.
ENGLISH = ("en", "en-US", "en-GB", "en_US", "en_GB")
PII_PRIORITY = ("O", "NAME", "LOCATION", "CONTACT", "ID", "OTHER_PII", "FINANCIAL", "HEALTH", "AUTH")


def raw(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """JSON lines, JSON arrays, CSV, plain text, Parquet or ORC by extension; bad JSON lines are dropped."""
    kind = kind or Path(path.rstrip("/")).suffix.lstrip(".").lower()
    if kind in ("jsonl", "ndjson"):
        return spark.read.option("mode", "DROPMALFORMED").json(path)
    if kind == "json":
        return spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    if kind == "csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if kind == "txt":
        return spark.read.option("lineSep", "\n\n").text(path).select(F.col("value").alias("text")).where(F.length("text") >= 20)
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    raise ValueError(f"unknown format: {kind}")


def first_present(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first non-empty of the columns that exist (names compared without case)."""
    have = {c.lower(): c for c in df.columns}
    cols = [F.col(f"`{have[n]}`").cast("string") for n in names if n in have]
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols]) if cols else F.lit(None).cast("string")


def labelled(df: DataFrame, corpus: str, source: str | None = None) -> DataFrame:
    """(text, risk, source): rows with text; the first label column that isn't null, by the map, med where the map lacks it.

    Without a label the enterprise corpus has med, the others no risk (candidates without label).
    """
    text_keys, label_keys, without = CORPORA[corpus]
    have = {c.lower(): c for c in df.columns}
    labels = [F.lower(F.trim(F.col(f"`{have[k]}`").cast("string"))) for k in label_keys if k in have]
    label = F.coalesce(*labels) if labels else F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for kv in SENSITIVITY.items() for x in kv])
    risk = F.when(label.isNull() | (label == ""), F.lit(without)).otherwise(F.coalesce(table[label], F.lit("med")))
    found = df.select(F.trim(first_present(df, text_keys)).alias("text"), risk.alias("risk"))
    return found.where("text IS NOT NULL").select("text", "risk", F.lit(source or corpus).alias("source"))


def sensitivity_corpus(spark: SparkSession, path: str, source: str) -> DataFrame:
    return labelled(raw(spark, path), "enterprise", source)


def mail_corpus(spark: SparkSession, path: str, most: int | None = None, id_col: str | None = None) -> DataFrame:
    """(text, source) of mail files of one format; backups named ``*_full*`` are left out, ``most`` rows stay (the first by ``id_col``, else by text)."""
    names = F.lower(F.element_at(F.split(F.input_file_name(), "/"), -1))
    d = raw(spark, path)
    d = d.select(F.trim(first_present(d, MAIL_KEYS)).alias("text"), *([F.col(id_col)] if id_col else []), names.alias("_file"))
    d = d.where("text IS NOT NULL AND NOT contains(_file, '_full')")
    if most is not None:
        d = d.orderBy(id_col or "text").limit(most)
    return d.select("text", F.lit("mail").alias("source"))


def balanced_rows(df: DataFrame, most: int | None = 12_000) -> DataFrame:
    """(text, risk) of rows with 12 to 32,000 characters and a known risk; the first ``most`` by the digest of the text."""
    risk = F.lower(F.trim(first_present(df, ("risk", "label"))))
    d = df.select(F.trim(first_present(df, ("text", "content"))).alias("text"), F.when(risk == "medium", "med").otherwise(risk).alias("risk"))
    d = d.where("length(text) BETWEEN 12 AND 32000 AND risk IN ('low', 'med', 'high')")
    return d if most is None else d.orderBy(F.md5("text"), "text", "risk").limit(most)


def finance_rows(df: DataFrame) -> DataFrame:
    """(text, risk) of a finance workbook's sheet: columns by name (else the first and the second), the label's risk by its whole name, else by the first
    name that begins it or (with three letters or more) lies in it; rows without a risk or with up to ten characters go."""
    find = lambda names, i: next((c for c in df.columns if c.lower() in names), df.columns[i])
    d = df.select(*[F.expr(SPARK.strip(f"cast(`{find(names, i)}` AS string)")).alias(n) for i, (n, names) in enumerate((("text", FINANCE_TEXT), ("label", FINANCE_LABEL)))])
    d = d.withColumn("label", F.lower("label"))
    whole = F.create_map(*[F.lit(x) for kv in FINANCE_RISK.items() for x in kv])[F.col("label")]
    keys = ", ".join(f"struct('{k}' AS k, '{r}' AS r)" for k, r in FINANCE_RISK.items())
    part = F.expr(f"get(filter(array({keys}), e -> startswith(label, e.k) OR (length(e.k) >= 3 AND contains(label, e.k))), 0).r")
    return d.select("text", F.coalesce(whole, part).alias("risk")).where("risk IS NOT NULL AND length(text) > 10")


def finance_workbooks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """:func:`finance_rows` of Excel files (needs pandas' Excel reader, which opens them on the driver)."""
    import pandas as pd

    return finance_rows(spark.createDataFrame(pd.concat([pd.read_excel(p, dtype=str) for p in paths], ignore_index=True)))


def extra_pool_rows(files: dict[str, DataFrame], known: DataFrame, most: int | None = EXTRA_POOL_ROWS) -> DataFrame:
    """(line, text, risk, source) of the curated pools, given as tables with ``line`` by file name: texts of 20 to 1000 characters whose fingerprint is
    neither known nor in an earlier file or line; of each file the first ``most`` that are left (all with None)."""
    parts = []
    for i, (name, fixed, source) in enumerate(EXTRA_POOLS):
        if (df := files.get(name)) is None:
            continue
        given = F.lower(F.trim(first_present(df, ("risk",))))
        risk = F.lit(fixed) if fixed else F.when(given == "high", "high").when(given.isin("med", "medium"), "med").otherwise("low")
        text = first_present(df, ("text", "content")).alias("text")
        parts.append(df.select("line", text, risk.alias("risk"), F.lit(source).alias("source"), F.lit(i).alias("_rank")))
    every = reduce(DataFrame.unionByName, parts).withColumn("text", F.expr(SPARK.strip("text"))).where(F.length("text").between(20, 1000))
    every = every.withColumn("_print", F.expr(X.fingerprint(SPARK, "text"))).where("_print <> ''")
    first = every.groupBy("_print").agg(F.min_by(F.struct("line", "text", "risk", "source"), F.struct("_rank", "line")).alias("row"))
    left = first.join(known.select(F.expr(X.fingerprint(SPARK, "text")).alias("_print")).distinct(), "_print", "left_anti").select("row.*")
    if most is None:
        return left
    return reduce(DataFrame.unionByName, [left.where(F.col("source") == s).orderBy("line").limit(most) for n, _, s in EXTRA_POOLS if n in files])


def _truth(df: DataFrame, name: str, false: tuple[str, ...] = ("",)) -> Column:
    """Whether a column is true: booleans as they are, numbers other than 0, strings other than those named."""
    kind = dict(df.dtypes)[name]
    if kind == "boolean":
        return F.col(f"`{name}`")
    return ~F.upper(F.trim(F.col(f"`{name}`"))).isin(*false) if kind == "string" else F.col(f"`{name}`") != 0


def secret_rows(df: DataFrame) -> DataFrame:
    """(text, risk): by the first flag that isn't null high or low, else the row's risk; rows without either go."""
    flags = [_truth(df, c) for c in SECRET_FLAGS if c in df.columns]
    flag = F.coalesce(*flags) if flags else F.lit(None).cast("boolean")
    given = F.lower(first_present(df, ("risk",)))
    risk = F.when(flag, "high").when(~flag, "low").when(given.isin("low", "med", "high"), given)
    return df.select(F.trim(first_present(df, SECRET_KEYS)).alias("text"), risk.alias("risk")).where("text <> '' AND risk IS NOT NULL")


def hub_secret_rows(df: DataFrame) -> DataFrame:
    """(text, risk) of a table with unknown columns: the first that may be the text (else the first at all) and the first that may be a label; high without."""
    text = next((c for c in HUB_KEYS if c in df.columns), df.columns[0])
    flag = next((c for c in HUB_FLAGS if c in df.columns), None)
    risk = F.when(_truth(df, flag, HUB_CLEAN), "high").otherwise("low") if flag else F.lit("high")
    return df.select(F.trim(F.col(f"`{text}`").cast("string")).alias("text"), risk.alias("risk")).where("length(text) >= 8")


def by_fragments(df: DataFrame, kind: str = "type", fragments: str = "fragments", cap: int | None = 15_000) -> DataFrame:
    """Code rows: three fragments or a secret's name are high; none in comments or safe rows low; else med.

    The first ``cap`` rows stay, by the digest of the row; all with None.
    """
    k, n = F.lower(F.coalesce(F.col(kind), F.lit(""))), F.coalesce(F.size(fragments), F.lit(0))
    risk = F.when((n >= 3) | k.rlike("secret|key|password|token"), "high").when((n <= 0) & ((k == "") | k.rlike("comment|safe")), "low").otherwise("med")
    out = df.withColumn("risk", risk)
    return out if cap is None else out.orderBy(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).limit(cap)


def literal_to_json(x: str) -> str:
    """Spark SQL: a Python literal (lists, tuples, dictionaries, strings, numbers, None, True, False) as JSON; JSON stays JSON.

    The text is cut into quoted strings and what lies between them. Strings get double quotes and JSON's escapes; between them brackets, names of
    constants and commas before a closing bracket are put right.
    """
    q = SPARK.q
    pieces = f"regexp_extract_all({x}, {q(_LITERAL)}, 0)"
    inner = "substring(p, 2, length(p) - 2)"
    # \\' is a quote, \\xHH a character, and a bare double quote needs an escape of its own
    inner = f"regexp_replace(regexp_replace({inner}, {q(_UNQUOTE)}, '$1\\''), {q(_HEX)}, {q('$1' + chr(92) * 2 + 'u00$2')})"
    single = f"concat('\"', regexp_replace({inner}, {q(_BARE)}, {q('$1' + chr(92) * 2 + chr(34))}), '\"')"
    double = f"regexp_replace(regexp_replace(p, {q(_UNQUOTE)}, '$1\\''), {q(_HEX)}, {q('$1' + chr(92) * 2 + 'u00$2')})"
    between = "translate(p, '()', '[]')"
    for word, to in (("None", "null"), ("True", "true"), ("False", "false")):
        between = f"regexp_replace({between}, {q(chr(92) + 'b' + word + chr(92) + 'b')}, '{to}')"
    between = f"regexp_replace({between}, {q(_COMMA)}, '$1')"
    one = f"CASE left(p, 1) WHEN '\\'' THEN {single} WHEN '\"' THEN {double} ELSE {between} END"
    return f"array_join(transform({pieces}, p -> {one}), '')"


_LITERAL = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"]+"""
#: After an even number of backslashes: an escaped single quote, a character by two digits; and a double quote without a backslash.
_UNQUOTE, _HEX, _BARE, _COMMA = r"((?<!\\)(?:\\\\)*)\\'", r"((?<!\\)(?:\\\\)*)\\x([0-9A-Fa-f]{2})", r"((?<!\\)(?:\\\\)*)\"", r",\s*([\]}])"
# The label that settles the risk, and parts of labels that are sharp.
SETTLING, SHARP = "critical_secret", ("ssn", "credit_card", "api_key", "password")


def span_labels(spans: str) -> str:
    """Spark SQL: the lower-case labels of a list of spans in JSON or as a Python literal; '' for a span without one; null where nothing can be read."""
    items = f"coalesce(from_json({spans}, 'array<string>', map('mode', 'PERMISSIVE')), from_json({literal_to_json(spans)}, 'array<string>'))"
    return f"transform({items}, e -> lower(coalesce(get_json_object(e, '$.label'), '')))"


def by_spans(df: DataFrame, label: str | None = None, spans: str = "spans") -> DataFrame:
    """Span-annotated rows, spans as JSON, Python literals or arrays: a settling label is high; else sharp labels or four spans are high, two med, and the rest low.

    Spans with the settling label aren't counted; a row whose spans can't be read is low. A column ``label`` is looked at for the settling label too.
    """
    labels = F.expr(span_labels(f"`{spans}`")) if dict(df.dtypes)[spans] == "string" else F.transform(spans, lambda s: F.lower(F.coalesce(s["label"], F.lit(""))))
    d = df.withColumn("_labels", F.coalesce(labels, F.array().cast("array<string>")))
    settled = F.exists("_labels", lambda x: x.contains(SETTLING))
    if label:
        settled = settled | F.lower(F.coalesce(F.col(label), F.lit(""))).contains(SETTLING)
    counted = F.filter("_labels", lambda x: ~x.contains(SETTLING))
    sharp = F.exists(counted, lambda x: x.rlike("|".join(SHARP)))
    risk = F.when(settled | sharp | (F.size(counted) >= 4), "high").when(F.size(counted) >= 2, "med").otherwise("low")
    return d.withColumn("risk", risk).drop("_labels")


def dominant_class(classes: Column) -> Column:
    """The class of highest priority; O without any."""
    order = F.array(*[F.lit(c) for c in PII_PRIORITY])
    top = F.array_max(F.transform(classes, lambda c: F.array_position(order, c)))
    return F.when(top > 0, F.element_at(order, top.cast("int"))).otherwise("O")


def masked_templates(df: DataFrame, text_col: str, masked_col: str, collapse: dict[str, str], lang_col: str | None = None, most_chars: int = 1000) -> DataFrame:
    """Templates with [TAG_n] placeholders: tags collapsed to classes, the dominant one as label.

    The part of a tag before its first ``_`` is looked up, then the whole tag; else it is OTHER_PII. Of rows that name a language
    the English ones stay; texts have 10 characters or more and are cut to ``most_chars``.
    """
    tags = F.transform(F.regexp_extract_all(F.col(masked_col), F.lit(r"\[([A-Za-z0-9_]+)\]"), F.lit(1)), F.upper)
    table = F.create_map(*[F.lit(x) for kv in collapse.items() for x in kv])
    cls = F.transform(tags, lambda t: F.coalesce(table[F.substring_index(t, "_", 1)], table[t], F.lit("OTHER_PII")))
    if lang_col:
        lang = F.trim(F.coalesce(F.col(lang_col), F.lit("")))
        df = df.where((lang == "") | lang.isin(*ENGLISH))
    text = F.trim(F.col(text_col))
    return df.where(F.length(text) >= 10).select(F.substring(text, 1, most_chars).alias("text"), dominant_class(F.coalesce(cls, F.array().cast("array<string>"))).alias("label"))


def bio_tokens(df: DataFrame, tokens: str, tags: str, collapse: dict[str, str]) -> DataFrame:
    """Token-tag rows: text joined by spaces, the dominant class of the tags (first substring that fits)."""
    def one(t: Column) -> Column:
        out = F.lit("OTHER_PII")
        for k, v in reversed(list(collapse.items())):
            out = F.when(F.upper(t).contains(k), v).otherwise(out)
        return F.when(t == "O", "O").otherwise(out)

    return df.select(F.array_join(tokens, " ").alias("text"), dominant_class(F.transform(tags, one)).alias("label"))


def unmarked(text: Column) -> Column:
    """Markup removed, the common entities resolved, white space single."""
    t = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clinical_notes(df: DataFrame, text_col: str = "value", most_chars: int | None = 8000) -> DataFrame:
    """(text, risk) of notes with markup: high if the note has a PHI element; the first ``most_chars`` characters (all with None); equal texts once, with the higher risk."""
    text = unmarked(F.col(text_col))
    text = text if most_chars is None else F.substring(text, 1, most_chars)
    phi = F.col(text_col).rlike(r"(?i)<PHI\b")
    return df.select(text.alias("text"), phi.alias("_phi")).groupBy("text").agg(F.max("_phi").alias("_phi")).select("text", F.when(F.col("_phi"), "high").otherwise("med").alias("risk"))


def clinical_xml(spark: SparkSession, path: str, most_chars: int | None = 8000) -> DataFrame:
    """:func:`clinical_notes` of files, one note each."""
    return clinical_notes(spark.read.option("wholetext", True).text(path), "value", most_chars)


def gate_rows(df: DataFrame) -> DataFrame:
    """(text, label, expected_action): the expectation from the label where missing."""
    label = F.lower(F.trim(first_present(df, ("label",))))
    table = F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])
    return df.select(first_present(df, ("text",)).alias("text"), label.alias("label"), F.coalesce(F.lower(first_present(df, ("expected_action",))), table[label], F.lit("warn")).alias("expected_action")).where("text IS NOT NULL")


DOCUMENT = "path string, page int, text string, method string, error string"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Pages of files: texts and office files here, PDF by its library if that is installed; a failure is a row with an error, an empty file none."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    rows += [(p, i + 1, t, m, None) for i, (t, m) in enumerate(extract(p, content))]
                except Exception as e:  # one bad file is a row, not a failed job
                    rows.append((p, 0, None, "error", f"{type(e).__name__}: {e}"[:500]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "page", "text", "method", "error"])

    return files.mapInArrow(work, DOCUMENT)


def extract(path: str, content: bytes) -> list[tuple[str, str]]:
    """(text, method) of each page."""
    import io

    kind = Path(path).suffix.lower()
    if kind == ".pdf":
        from pypdf import PdfReader

        return [(p.extract_text() or "", "pdf") for p in PdfReader(io.BytesIO(content)).pages]
    if kind in office.READERS:
        return [(text, kind[1:]) for text in office.READERS[kind](content)]
    return [(content.decode("utf-8", errors="replace"), "text")]


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines): lines that aren't blank, by file."""
    d = spark.read.text(path).where(F.trim("value") != "")
    return d.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("lines"))


def manual_rows(df: DataFrame) -> DataFrame:
    """(text, risk) of a manual set: low, med or high, med for all else."""
    label = F.lower(F.trim(first_present(df, ("risk", "label", "category", "classification"))))
    risk = F.when(label.isin("low", "high"), label).otherwise("med")
    return df.select(F.trim(first_present(df, ("text", "content", "excerpt", "prompt", "input"))).alias("text"), risk.alias("risk")).where("text IS NOT NULL")


def telemetry_tail(spark: SparkSession, path: str, n: int = 2000) -> DataFrame:
    """The last n events of a JSON-lines log; bad lines are skipped."""
    d = spark.read.option("mode", "DROPMALFORMED").json(path)
    return d.orderBy(F.desc("timestamp")).limit(n)


def knowledge_base_text(place: str, cache: str | None = None, token: str = "", seconds: float = 5.0) -> str:
    """A knowledge base from a file or an https address; what was read last, from ``cache``, where that fails; "" without any."""
    import urllib.request

    try:
        if place.startswith("https://"):
            asked = urllib.request.Request(place, headers={"Authorization": f"token {token}"} if token else {})
            with urllib.request.urlopen(asked, timeout=seconds) as answer:
                text = answer.read().decode("utf-8")
        else:
            text = Path(place).read_text(encoding="utf-8")
        knowledge_base(text)
    except (OSError, ValueError, TypeError, KeyError, AttributeError):
        return Path(cache).read_text(encoding="utf-8") if cache and Path(cache).is_file() else ""
    if cache:
        Path(cache).write_text(text, encoding="utf-8")
    return text


def _parsed(text: str) -> dict:
    """JSON, or YAML where its library is there."""
    try:
        found = json.loads(text or "{}")
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError:
            raise ValueError("the knowledge base isn't JSON, and there is no YAML library") from None
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(f"the knowledge base is neither JSON nor YAML: {e}") from None
    if not isinstance(found, dict):
        raise ValueError("a knowledge base is a table of names")
    return found


def knowledge_base(text: str) -> tuple[list[dict], dict[str, str]]:
    """(rules, sensitivity) of a JSON or YAML knowledge base: custom regexes, and forbidden terms as literal, high, case-blind rules; bad regexes are skipped."""
    import re

    kb = _parsed(text)
    rules = [{"name": r["name"], "regex": r["regex"], "risk": r.get("risk", "med")} for r in kb.get("custom_pii_patterns") or []]
    rules += [{"name": f"forbidden:{t[:64]}", "regex": "(?i)" + re.escape(t), "risk": "high"} for t in kb.get("forbidden_terms") or []]
    good = []
    for r in rules:
        try:
            re.compile(r["regex"])
            good.append(r)
        except re.error:
            continue
    return good, dict(kb.get("sensitivity_overrides") or {})


EVENT = T.StructType([T.StructField(n, t) for n, t in (("event_id", T.LongType()), ("created_at", T.TimestampType()), ("text_hash", T.StringType()), ("pii_class", T.StringType()), ("confidence", T.DoubleType()), ("action", T.StringType()), ("context_json", T.StringType()))])
