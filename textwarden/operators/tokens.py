"""Token windows with character offsets, and back: from tokens to spans, from windows to texts, from ids to texts.

A text is cut into pieces that cover every character: a run of letters and digits or a single other character, each with one space
before it if there is one, and single white space. A vocabulary holds the most frequent pieces; any other piece is spelled by the bytes of its characters,
so nothing is unknown and decoding gives the text back exactly. Ids: 0 padding, 1 and 2 the marks before and after a
window, 3 free, then the 256 bytes, then the pieces. Any other encoder can stand in: windows need ids, starts and ends only.

Encoding is one Arrow pass with the vocabulary (at most ``most`` pieces) in the task, by pieces of bounded text, and cutting windows another; decoding is a column
expression within a row.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions.batches import pieces as bounded

#: The same pieces for engines with and without Unicode classes in brackets.
PIECE = r" ?[\p{L}\p{N}]+| ?[^\x09-\x0D\x20\p{L}\p{N}]|[\x09-\x0D\x20]"
_PIECE = re.compile(r" ?[^\W_]+| ?[^\x09-\x0D\x20]|[\x09-\x0D\x20]")
_WORD = re.compile(r"[^\x09-\x0D\x20]+")
PAD, BEFORE, AFTER, BYTE, FIRST = 0, 1, 2, 4, 260
#: Windows hold so many tokens beside their two marks and share so many with the next; texts of fewer words are one window, cut off at its size.
CONTENT, SHARED, SHORT = 126, 32, 80
#: Windows that a task holds at once.
AT_ONCE = 4096


def vocabulary(df: DataFrame, most: int = 8000, text_col: str = "text") -> list[str]:
    """The most frequent pieces, at most ``most``; ties by code point."""
    pieces = df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(PIECE), F.lit(0))).alias("piece"))
    return [r.piece for r in pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "piece").limit(most).collect()]


def encoded(text: str, ids: dict[str, int], out: list | array | None = None, starts: list | array | None = None, ends: list | array | None = None) -> tuple[list | array, list | array, list | array]:
    """Ids of a text, and where the characters they stand for start and end; a piece starts after its space. With arrays given, they are added to these."""
    out, starts, ends = ([] if x is None else x for x in (out, starts, ends))
    for m in _PIECE.finditer(text):
        a, b = m.span()
        i = ids.get(m.group())
        if i is not None:
            out.append(i)
            starts.append(a + (b - a > 1 and text[a] == " "))
            ends.append(b)
            continue
        for at in range(a, b):
            raw = text[at].encode()
            out.extend(BYTE + x for x in raw)
            starts.extend([at] * len(raw))
            ends.extend([at + 1] * len(raw))
    return out, starts, ends


def encode(df: DataFrame, pieces: list[str], text_col: str = "text") -> DataFrame:
    """df with ``ids``, ``starts`` and ``ends``; null texts have none."""
    df = df.drop("ids", "starts", "ends")
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {p: FIRST + i for i, p in enumerate(pieces)}
        for batch in bounded(batches, text_col):
            flat, ends = (array("i"), array("i"), array("i")), [0]
            for t in batch.column(names.index(text_col)).to_pylist():
                encoded(t or "", ids, *flat)
                ends.append(len(flat[0]))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(x, np.int32))) for x in flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*names, "ids", "starts", "ends"])

    kinds = ", ".join(f"`{k}` {v}" for k, v in df.dtypes)
    return df.mapInArrow(work, f"{kinds}, ids array<int>, starts array<int>, ends array<int>")


def windows(df: DataFrame, key: str, text_col: str = "text", content: int = CONTENT, shared: int = SHARED, short: int = SHORT) -> DataFrame:
    """(key, token_start, token_end, char_start, char_end, input_ids, attention, starts, ends, part) of encoded texts.

    ``input_ids`` has the marks and padding, ``attention`` how many of it count, ``starts`` and ``ends`` the window's offsets, and ``part`` its text.
    A short text is one window, of whose tokens those beyond the window's size are cut off, and its part is the whole text.
    A row holds its window only, so a text's windows take room and time in proportion to the text.
    """
    step = max(1, content - shared)
    whole = [("token_start", pa.int32()), ("token_end", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32())]

    def made(keys: pa.Array, cut: list[tuple[int, int, int, int, int]], lists: tuple[list[np.ndarray], ...], parts: list[str]) -> pa.RecordBatch:
        """The windows in ``cut``: row of the key and the four places; lists: their ids, starts and ends."""
        at = np.array(cut, np.int32)
        size = at[:, 2] - at[:, 1]
        ids = np.full((len(cut), content + 2), PAD, np.int32)
        ids[:, 0] = BEFORE
        ids[:, 1:-1][np.arange(content) < size[:, None]] = np.concatenate(lists[0])
        ids[np.arange(len(cut)), size + 1] = AFTER
        ends = pa.array(np.append(0, size.cumsum()).astype(np.int32))
        own = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in lists[1:])
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(cut) + 1, dtype=np.int32) * (content + 2)), pa.array(ids.ravel()))
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(at[:, 0])), *(pa.array(at[:, 1 + i], k) for i, (_, k) in enumerate(whole)), each, pa.array(size + 2, pa.int32()), *own, pa.array(parts, pa.string())],
            [key, *(n for n, _ in whole), "input_ids", "attention", "starts", "ends", "part"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "_text"):
            flat = [np.asarray(batch.column(i).values) for i in (2, 3, 4)]
            edge = [np.asarray(batch.column(i).offsets).tolist() for i in (2, 3, 4)]
            cut, lists, parts = [], ([], [], []), []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids, starts, ends = (x[e[row] : e[row + 1]] for x, e in zip(flat, edge, strict=True))
                one = len(ids) <= content or (short > 0 and len(_WORD.findall(text)) < short)
                for a in range(0, 1 if one else -(-(len(ids) - content) // step) * step + 1, step):
                    z = min(a + content, len(ids))
                    first, last = 0 if one or not a else int(starts[a]), len(text) if one else int(ends[z - 1])
                    cut.append((row, a, z, first, last))
                    for held, x in zip(lists, (ids, starts, ends), strict=True):
                        held.append(x[a:z])
                    parts.append(text[first:last])
                    if len(cut) == AT_ONCE:
                        yield made(batch.column(0), cut, lists, parts)
                        cut, lists, parts = [], ([], [], []), []
            if cut:
                yield made(batch.column(0), cut, lists, parts)

    d = df.where(F.col(text_col).isNotNull()).select(key, F.col(text_col).alias("_text"), "ids", "starts", "ends")
    kinds = ", ".join(f"{n} int" for n, _ in whole)
    return d.mapInArrow(work, f"`{key}` {dict(df.dtypes)[key]}, {kinds}, input_ids array<int>, attention int, starts array<int>, ends array<int>, part string")


def rebuilt(parts: DataFrame, key: str, out: str = "text") -> DataFrame:
    """(key, text): windows put together; of each the characters before the next one's first."""
    d = parts.selectExpr(f"`{key}`", "token_start", "part", "char_start", f"lead(char_start) OVER (PARTITION BY `{key}` ORDER BY token_start) AS _next")
    d = d.selectExpr(f"`{key}`", "token_start", "CASE WHEN _next IS NULL THEN part ELSE left(part, _next - char_start) END AS part")
    return d.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_start", "part"))), lambda x: x["part"]), "").alias(out))


def spans_of_tokens(parts: DataFrame, key: str, hits_col: str = "hits") -> DataFrame:
    """(key, spans): hits (first, last, class) on a window's tokens, ``last`` not included, as spans of the text; those that two windows share come once."""
    hit = parts.selectExpr(f"`{key}`", "starts", "ends", f"explode(`{hits_col}`) AS h").where("h.first >= 0 AND h.first < h.last AND h.last <= size(starts)")
    span = "struct(starts[h.first] AS start, ends[h.last - 1] AS `end`, h.class AS class)"
    return hit.selectExpr(f"`{key}`", f"{span} AS s").groupBy(key).agg(F.array_sort(F.collect_set("s")).alias("spans"))


def decode(df: DataFrame, pieces: list[str], key: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """(key, text) of rows of ids with a unique key; marks and padding are skipped, rows without any other id have an empty text."""
    # what each id stands for, in bytes, at its place in a fixed array
    said = [None] * FIRST
    said[BYTE : BYTE + 256] = [f"{x:02X}" for x in range(256)]
    table = F.array(*(F.lit(x).cast("string") for x in [*said, *(p.encode().hex().upper() for p in pieces)]))
    joined = F.array_join(F.transform(F.coalesce(ids_col, F.array().cast("array<int>")), lambda i: F.get(table, i)), "")
    return df.select(key, F.decode(F.unhex(joined), "UTF-8").alias(out))


def candidates(decoded: DataFrame, key: str, text_col: str = "text", risk: str = "risk", label: str = "label") -> DataFrame:
    """One whole-text candidate for each row that isn't blank: (key, text, start, end, true_type, is_phi). A named risk decides, else a label above 0."""
    named = f"lower(trim(coalesce({risk}, '')))"
    # fixed values: the risks that count, and the type that stands for them
    phi = f"CASE WHEN {named} = '' THEN coalesce(try_cast({label} AS int), 0) > 0 ELSE {named} IN ('risky', 'high', 'med') END"
    d = decoded.selectExpr(f"`{key}`", f"regexp_replace(`{text_col}`, '^[\\\\x09-\\\\x0D\\\\x20]+|[\\\\x09-\\\\x0D\\\\x20]+$', '') AS text", f"{phi} AS _phi").where("text <> ''")
    return d.selectExpr(f"`{key}`", "text", "0 AS start", "length(text) AS `end`", "CASE WHEN _phi THEN 'ACCOUNT' ELSE 'NONE' END AS true_type", "cast(_phi AS int) AS is_phi")
