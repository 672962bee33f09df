"""Rules written once and rendered as SQL text for Spark or for the checking engine.

A rule chain is a list of levels; each level names expressions over the columns so far. For Spark
a level becomes one ``selectExpr`` (Catalyst merges what is cheap to merge), for the checker
one nested SELECT. Only leaf functions differ between the two, and they live here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

Level = dict[str, str]
#: Letters, marks and digits beyond ASCII, which the checker takes for no part of a word.
LETTER = r"[^\x00-\x7F\p{P}\p{Z}\p{S}]"
#: How an address begins: its class has the "_" that stands for such letters elsewhere.
LOCAL = "._%+-]+@"
MARK = "\x02"
#: Letters that become several in upper case.
WIDE = tuple((chr(c), chr(c).upper()) for c in range(128, 0x10000) if not 0xD800 <= c < 0xE000 and len(chr(c).upper()) > 1)


@dataclass(frozen=True)
class Dialect:
    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def q(self, s: str) -> str:
        """A string literal."""
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'" if self.spark else "'" + s.replace("'", "''") + "'"

    def rx(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.q(pattern)})" if self.spark else f"regexp_matches({self.bounded(x, pattern)}, {self.q(pattern)})"

    def count(self, x: str, pattern: str) -> str:
        return f"regexp_count({x}, {self.q(pattern)})" if self.spark else f"len(regexp_extract_all({self.bounded(x, pattern)}, {self.q(pattern)}))"

    def all_matches(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.q(pattern)}, 0)" if self.spark else f"regexp_extract_all({x}, {self.q(pattern)}, 0)"

    def sub(self, x: str, pattern: str, to: str) -> str:
        if self.spark:
            return f"regexp_replace({x}, {self.q(pattern)}, {self.q(to)})"
        if r"\b" not in pattern:
            return f"regexp_replace({x}, {self.q(pattern)}, {self.q(to)}, 'g')"
        return self.unmarked(f"regexp_replace({self.marked(x, pattern)}, {self.q(pattern)}, {self.q(to)}, 'g')")

    def has(self, x: str, word: str) -> str:
        return f"contains({x}, {self.q(word)})"

    def any(self, x: str, words) -> str:
        return "(" + " OR ".join(self.has(x, w) for w in words) + ")"

    def ascii_bounds(self, x: str) -> str:
        """x for patterns with word boundaries beside letters beyond ASCII: the checker takes these for no letters, so there they become "_"."""
        return x if self.spark else self.sub(x, LETTER, "_")

    def bounded(self, x: str, pattern: str) -> str:
        """For the checker: x in which the pattern's word boundaries are those of Java, whose letters go beyond ASCII."""
        if r"\b" not in pattern:
            return x
        return self.marked(x, pattern) if LOCAL in pattern else self.ascii_bounds(x)

    def marked(self, x: str, pattern: str) -> str:
        """For the checker: x with "_" on both sides of letters beyond ASCII; for addresses a mark ends each word with one, so that none begins in it."""
        x = self.sub(x, f"({LETTER})", r"_\1_")
        if LOCAL not in pattern:
            return x
        word = f"(_{LETTER}(?:[0-9A-Za-z_]|{LETTER})*)"
        x = self.sub(x, f"{word}([.%+-])", rf"\1{MARK}_\2")
        return self.sub(x, rf"{word}([\x00\x01\x03-$&-*,/:-@[-^`{{-\x7F]|[\p{{Pd}}\p{{Ps}}\p{{Pe}}\p{{Pi}}\p{{Pf}}\p{{Po}}\p{{Z}}\p{{S}}\x{{203F}}\x{{2040}}\x{{2054}}\x{{FE33}}\x{{FE34}}\x{{FE4D}}-\x{{FE4F}}\x{{FF3F}}]|$)", rf"\1{MARK}\2")

    def unmarked(self, x: str) -> str:
        return self.sub(f"replace(replace({x}, {self.q(MARK + '_')}, ''), {self.q(MARK)}, '')", f"_({LETTER})_", r"\1")

    def upper(self, x: str) -> str:
        """Upper case; the checker leaves letters as they are that become several, such as the German sharp s."""
        for a, b in () if self.spark else WIDE:
            x = f"replace({x}, '{a}', '{b}')"
        return f"upper({x})"

    def strip(self, x: str) -> str:
        return self.sub(x, r"^\s+|\s+$", "")

    def list(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def present(self, items: list[str]) -> str:
        """The items that aren't null, in order."""
        x = self.list(*items)
        return f"filter({x}, e -> e IS NOT NULL)" if self.spark else f"list_filter({x}, lambda e: e IS NOT NULL)"

    def join(self, x: str, sep: str) -> str:
        return f"array_join({x}, {self.q(sep)})" if self.spark else f"array_to_string({x}, {self.q(sep)})"

    def size(self, x: str) -> str:
        return f"size({x})" if self.spark else f"len({x})"

    def concat(self, a: str, b: str) -> str:
        return f"concat({a}, {b})" if self.spark else f"list_concat({a}, {b})"

    def map(self, x: str, var: str, body: str) -> str:
        return f"transform({x}, {var} -> {body})" if self.spark else f"list_transform({x}, lambda {var}: {body})"

    def exists(self, x: str, var: str, test: str) -> str:
        return f"exists({x}, {var} -> {test})" if self.spark else f"(len(list_filter({x}, lambda {var}: {test})) > 0)"

    def entropy(self, x: str) -> str:
        """Shannon entropy in bits per character."""
        if self.spark:
            part = f"(length({x}) - length(replace({x}, c, ''))) / length({x})"
            return f"aggregate(array_distinct(split({x}, '')), 0D, (s, c) -> s - CASE WHEN c = '' THEN 0D ELSE ({part}) * log2({part}) END)"
        part = f"(length({x}) - length(replace({x}, c, '')))::DOUBLE / length({x})"
        return f"coalesce(list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: -({part}) * log2({part}))), 0)"


SPARK, CHECK = Dialect("spark"), Dialect("check")


def apply(df: DataFrame, levels: list[Level]) -> DataFrame:
    for level in levels:
        df = df.selectExpr("*", *[f"{e} AS {n}" for n, e in level.items()])
    return df


def nest(source: str, levels: list[Level]) -> str:
    """The chain over a FROM item, as one SELECT."""
    sql = f"SELECT * FROM {source}"
    for level in levels:
        sql = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in level.items())} FROM ({sql})"
    return sql
