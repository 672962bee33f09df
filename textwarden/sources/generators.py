"""Made-up rows by kind: templates, filled by the MD5 of seed, kind, row and field. The same rows for the same seed, on any engine and at any parallelism.

A template holds ``{name}``, ``{city}``, ``{company}``, ``{team}``, ``{service}``, ``{day}``, ``{paper}``, ``{verb}`` (a word of that list), ``{d4}`` (so many
digits) and ``{h8}`` or ``{H8}`` (so many hexadecimal digits). Row i of a kind has the kind's template i modulo their number.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions.dialect import CHECK, SPARK, Dialect

WORDS = {
    "name": ("Ada Quill", "Ben Marsh", "Cleo Vance", "Dov Ferris", "Edie Loom", "Finn Ortega", "Gwen Sato"),
    "city": ("Lund", "Porto", "Graz", "Leeds", "Tampa", "Osaka"),
    "company": ("Norfield Ltd", "Blue Kiln", "Harrow and Pike", "Osprey Foods", "Tallis Freight"),
    "team": ("platform", "support", "research", "purchasing", "field sales"),
    "service": ("ledger-sync", "mail-relay", "search-index", "report-builder", "stock-feed"),
    "day": ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday"),
    "paper": ("roadmap", "handbook", "style guide", "risk register", "test plan", "minutes"),
    "verb": ("read", "sign off", "shorten", "file", "forward"),
}
#: kind -> (risk, template)
KINDS: dict[str, tuple[tuple[str, str], ...]] = {
    # notices without anything to protect
    "low": tuple(("low", t) for t in (
        "Rehearsals for the spring concert go on after the break on {day}.", "Deck {d2} of the car park is dark while its lamps are replaced.", "Whoever has the long ladder: {team} would like it back.",
        "The canteen of {city} tries soups for a week.", "Trains to {city} leave across the bridge from {day} on.", "Chapter {d2} of the {paper} got shorter.", "Fire drill on {day}: coats stay where they hang.",
        "Printer {d3} takes thick sheets only.")),
    "finance_low": tuple(("low", t) for t in ("Cost centre {d4} closes its books on {day}.", "The budget template {d3} has a new colour.", "Quarter notes of {team} are online.")),
    "finance_med": tuple(("med", t) for t in ("{name} joined the budget review of group {d3}.", "Forecast {d3} was shared by {name} with {company}.", "Expense claim {d4} of {name}, {city}: hotel and train.")),
    "finance_high": tuple(("high", t) for t in ("Card 4111 1111 1111 {d4} belongs to {name}.", "Wire to DE89 3704 0044 0532 {d4} 00 for {name}.", "Salary of {name}: account {d6}{d4}, SSN 219-09-{d4}.")),
    # words of the trade without a value: what a rule on words alone would flag
    "safe_business": tuple(("low", t) for t in (
        "Glossary: a routing number tells a bank where money goes; this page gives none.", "The poster in the lobby of {city} says that nobody will ever ask for a password.", "Pub quiz of {team}: how many digits has a card? Answers on {day}.",
        "Museum label: the ledger of {company} lists ships and barrels.", "Box nine of form {H4} is for the tax office; the sample leaves it empty.", "Talk on rotating keys, hall {d3}, tea afterwards.",
        "Buses of {city} were counted for the {paper}, passengers were not.", "{service} has been quiet since {day}, says the pager.")),
    # a value in a shape that a plain rule may miss: other separators, quoting, spelling, wrapping
    "adversarial": tuple(("high", t) for t in (
        "kind=ssn&number=219.09.{d4}&keep=1", "the form wants underscores, so 4111_1111_1111_{d4} it is, till 04/29", "<!-- todo {name}: drop AKIA{H16} before the fair -->", "D E 8 9 - 3 7 0 4 - 0044 0532 {d4} 00, spelled for the clerk",
        "curl -u root:{h12} https://{service}.example.net/dump", "vault phrase of {name}: tulip-{h6}-anchor-{h6}-gravel", "{name} / insulin twice a day / chart {d6} / do not forward", "{h20}\\{h20} (one token, the margin broke it)", "two one nine, oh nine, then {d4}: that is the social of {name}")),
    # a person beside something harmless
    "hard_med": tuple(("med", t) for t in (
        "The courier asks for {name} at the back gate in {city}.", "Bus trip: {name} has seat {d2} and keeps one for a guest.", "A scarf of {name} lies in room {d3}; {team} has it.", "On {day} the chess club meets at the house of {name}.",
        "Library card {d4} is in the name of {name}.", "Number plate {H2}-{d4} blocks the ramp, and {name} has the keys.", "Letters for {name} keep coming to user{d3}@example.org.")),
    # a value with its owner, in the middle of other things
    "hard_high": tuple(("high", t) for t in (
        "scan of passport {H2}{d6}, {name}, made in {city} on {day}", "Dear bank, the rent goes out of DE89 3704 0044 0532 {d4} 00 from now on, regards {name}", "STRIPE=sk_live_{h24} ./{service} --once --quiet", "{name} tested positive, says lab sheet {d6}{d2}.",
        "line {d3} of the dump reads ('{name}', '219-09-{d4}', '{h16}')", "-----BEGIN PRIVATE KEY----- {h32}{h20}", "flat in {city}: network word {h12}, alarm {d6}, neighbour {name}")),
    "weak_category": (
        ("med", "Ask for {name} at desk {d2}, the one from {city}."), ("high", "The permit is {H2}{d6}, valid until the end of the year."), ("high", "Since the operation {name} takes two tablets a day."),
        ("med", "They live by the old mill in {city}, house {d2}."), ("high", "The door code of the server room is {d6}."), ("low", "The mill in {city} opens on {day}.")),
    "contextual": (
        ("med", "As agreed on the phone, {name} will take over from {city} while the colleague is on sick leave."), ("high", "Our client, born 1979-04-{d2} in {city}, disputes the charge on the card ending in {d4}."),
        ("med", "In the matter of {name} against {company} the hearing is on {day}."), ("low", "The contract with {company} follows the usual form; see the {paper}.")),
    "finance_balanced": (("low", "Markets were calm on {day}; {company} rose by {d1} points."), ("med", "Invoice {d6} of {company}, attention {name}."), ("high", "Pay {name}: IBAN DE89 3704 0044 0532 {d4} 00, PIN {d4}.")),
}
#: Kinds that fill up a class.
TOP_UP = {"low": "low", "med": "hard_med", "high": "hard_high"}
_FIELD = re.compile(r"\{(\w+)\}")


def _number(d: Dialect, h: str, below: int) -> str:
    return f"(cast(conv(substring({h}, 1, 8), 16, 10) AS bigint) % {below})" if d.spark else f"(('0x' || substring({h}, 1, 8))::UBIGINT % {below})::BIGINT"


def _filled(d: Dialect, kind: str, template: str, seed: int) -> str:
    parts = []
    for i, piece in enumerate(_FIELD.split(template)):
        if i % 2 == 0:
            parts += [d.q(piece)] if piece else []
            continue
        h = f"md5(concat('{seed}|{kind}|', cast(id AS {'string' if d.spark else 'VARCHAR'}), '|{i}'))"
        if piece in WORDS:
            parts.append(f"{'element_at' if d.spark else 'list_extract'}({d.list(*map(d.q, WORDS[piece]))}, cast({_number(d, h, len(WORDS[piece]))} + 1 AS int))")
        elif piece[0] == "d":
            n = int(piece[1:])
            parts.append(f"lpad(cast({_number(d, h, 10**n)} AS {'string' if d.spark else 'VARCHAR'}), {n}, '0')")
        else:  # a digest has 32 digits; longer ones repeat it
            x = f"substring(concat({h}, {h}), 1, {int(piece[1:])})"
            parts.append(f"upper({x})" if piece[0] == "H" else x)
    return f"concat({', '.join(parts)})"


def _columns(d: Dialect, kind: str, seed: int) -> list[str]:
    made = KINDS[kind]
    case = lambda xs: f"CASE id % {len(made)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
    return ["id", f"{case(_filled(d, kind, t, seed) for _, t in made)} AS text", f"{case(d.q(r) for r, _ in made)} AS risk", f"'synthetic_{kind}' AS source"]


def rows(spark: SparkSession, kind: str, count: int, seed: int = 42) -> DataFrame:
    """(id, text, risk, source): ``count`` rows of a kind."""
    return beside(spark.range(max(0, count)), "id", kind, seed)


def beside(df: DataFrame, id_col: str, kind: str, seed: int = 42) -> DataFrame:
    """A row of a kind for each row of df, by its number: as many made-up rows as real ones, made where these are."""
    return df.select(F.col(id_col).cast("bigint").alias("id")).selectExpr(*_columns(SPARK, kind, seed))


def check_sql(kind: str, count: str | int, seed: int = 42, source: str | None = None) -> str:
    """The same rows as a SELECT of the checking engine; ``source`` is a FROM item with ids."""
    return f"SELECT {', '.join(_columns(CHECK, kind, seed))} FROM {source or f'(SELECT range AS id FROM range({count}))'}"


def mixture(spark: SparkSession, counts: dict[str, int], seed: int = 42) -> DataFrame:
    """Rows of several kinds."""
    return reduce(DataFrame.unionByName, [rows(spark, kind, n, seed) for kind, n in counts.items()])


def finance_counts(n: int) -> dict[str, int]:
    """30 % low, 40 % medium, the rest high."""
    low, med = int(n * 0.30), int(n * 0.40)
    return {"finance_low": low, "finance_med": med, "finance_high": n - low - med}


def demo_events(spark: SparkSession, count: int = 1200, days: int = 14, seed: int = 42) -> DataFrame:
    """Events over the days before a fixed date, with actions by the demo's limits (70 and 40)."""
    return events_beside(spark.range(count), "id", days, seed)


def events_beside(df: DataFrame, id_col: str, days: int = 14, seed: int = 42) -> DataFrame:
    """A made-up event for each row of df, by its number."""
    d = df.select(F.col(id_col).cast("bigint").alias("id")).selectExpr(*_events(SPARK, days, seed))
    action = F.when(F.col("risk_score") >= 70, "block").when(F.col("risk_score") >= 40, "warn").otherwise("silent")
    return d.withColumn("ts", F.timestamp_seconds("at_second")).withColumn("action", action).select("event_id", "ts", "risk_score", "action")


def _events(d: Dialect, days: int, seed: int) -> list[str]:
    h = lambda field: f"md5(concat('{seed}|event|', cast(id AS {'string' if d.spark else 'VARCHAR'}), '|{field}'))"
    return ["id AS event_id", f"cast({_number(d, h('score'), 101)} AS int) AS risk_score", f"1735689600 - {_number(d, h('at'), days * 86_400)} AS at_second"]


def events_check_sql(count: int = 1200, days: int = 14, seed: int = 42, source: str | None = None) -> str:
    return f"SELECT *, CASE WHEN risk_score >= 70 THEN 'block' WHEN risk_score >= 40 THEN 'warn' ELSE 'silent' END AS action FROM (SELECT {', '.join(_events(CHECK, days, seed))} FROM {source or f'(SELECT range AS id FROM range({count}))'})"
