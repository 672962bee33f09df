"""Token counts of a unigram tokenizer without building tokens.

An Aho-Corasick automaton over the vocabulary finds all pieces that end at each character; the
dynamic programme carries the best score and the number of pieces of that segmentation. Its tie rules are those
of the public unigram encoder: a later candidate replaces an earlier one only if its score is
strictly higher, candidates for an end come in order of their starts (longest piece first), and a character
that no one-character piece covers competes as unknown at (lowest score - 10). An unknown
character counts as its UTF-8 bytes if the vocabulary has byte pieces, else runs of
unknown characters count once. White space follows the model: a dummy prefix, and spaces as U+2581.

No piece crosses from a letter to U+2581 or touches a character outside the longer pieces, so
texts fall into segments that are counted on their own and remembered (a bounded memory per
worker; what falls out is counted again). Scores are added in double precision.

Results for odd input: null and empty text have 0 tokens; repeated rows are counted alike; texts of any
length are counted whole in linear time; extra columns are kept, but for one named
``n_tokens``, which is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textwarden.llm.storage import loosened

SPACE = "▁"
#: Segments that a worker remembers, in each of two generations.
REMEMBER = 400_000


@dataclass
class Vocabulary:
    """Pieces with scores, and how the model treats unknown characters and spaces."""

    scores: dict[str, float]
    byte_fallback: bool = True
    dummy_prefix: bool = True
    unknown_penalty: float = 10.0
    _made: tuple | None = field(default=None, repr=False, compare=False)
    _new: dict[str, int] = field(default_factory=dict, repr=False, compare=False)
    _old: dict[str, int] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None, "_new": {}, "_old": {}}

    def made(self) -> tuple:
        """Automaton, unknown score, segment pattern and one-character pieces; built once in each worker."""
        if self._made is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for p, s in self.scores.items():
                a.add_word(p, (len(p), s))
            a.make_automaton()
            long = [p for p in self.scores if len(p) > 1]
            crossing = any(SPACE in p.lstrip(SPACE) for p in long)
            inner = "".join(re.escape(c) for c in sorted({c for p in long for c in p} - {SPACE}))
            # a piece may run over spaces between letters: then the whole text is one segment
            pattern = re.compile(r"(?s).+") if crossing or not inner else re.compile(f"(?s){SPACE}*[{inner}]+|{SPACE}+|.")
            unknown = min(self.scores.values(), default=0.0) - self.unknown_penalty
            self._made = (a, unknown, pattern, frozenset(p for p in self.scores if len(p) == 1))
        return self._made

    def segment_count(self, s: str) -> int:
        """Pieces of the best segmentation of one segment, times 4; bits 2 and 1: it starts, ends with an unknown run that could go on."""
        auto, unknown, _, known = self.made()
        n = len(s)
        low = float("-inf")
        best, count = [low] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        if known.issuperset(s):  # matches come by end, and for an end the longest first
            for end, (size, score) in auto.iter(s):
                end += 1
                x = best[end - size] + score
                if x > best[end]:
                    best[end] = x
                    count[end] = count[end - size] + 1
            return count[n] << 2
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, hit in auto.iter(s):
            ends[end].append(hit)
        run, lead = [False] * (n + 1), [False] * (n + 1)  # whether the best segmentation ends, starts with an unknown character
        for e in range(1, n + 1):
            for size, score in ends[e - 1]:
                x = best[e - size] + score
                if x > best[e]:
                    best[e], count[e], lead[e] = x, count[e - size] + 1, lead[e - size]
            if s[e - 1] not in known:
                x = best[e - 1] + unknown
                if x > best[e]:
                    best[e], run[e], lead[e] = x, True, lead[e - 1] or e == 1
                    count[e] = count[e - 1] + (len(s[e - 1].encode()) if self.byte_fallback else 0 if run[e - 1] else 1)
        return count[n] << 2 | (0 if self.byte_fallback else lead[n] << 1 | run[n])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        _, _, pattern, _ = self.made()
        s = text.replace(" ", SPACE)
        if self.dummy_prefix:
            s = SPACE + s
        total, last, get = 0, 0, self._new.get
        for seg in pattern.findall(s):
            c = get(seg)
            if c is None:
                c = self._old.get(seg)
                if c is None:
                    c = self.segment_count(seg)
                if len(seg) <= 64:
                    if len(self._new) >= REMEMBER:
                        self._old, self._new = self._new, {}
                        get = self._new.get
                    self._new[seg] = c
            total += (c >> 2) - (1 if last & 1 and c & 2 else 0)
            last = c
        return total


def load_sentencepiece(path: str) -> Vocabulary:
    """The normal pieces of a sentencepiece model, read as a unigram vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    usual = [i for i in ids if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Vocabulary({sp.id_to_piece(i): sp.get_score(i) for i in usual}, byte_fallback=any(sp.is_byte(i) for i in ids))


def count_tokens(docs: DataFrame, vocab: Vocabulary, text_col: str = "text") -> DataFrame:
    """The columns of docs and n_tokens. The vocabulary, a file of fixed size, goes with the task."""
    docs = loosened(docs.drop("n_tokens"))
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared(vocab)
        for batch in batches:
            texts = batch.column(names.index(text_col))
            n = pa.array([own.count(texts[i].as_py()) for i in range(len(batch))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], [*names, "n_tokens"])

    kinds = ", ".join(f"`{k}` {v}" for k, v in docs.dtypes)
    return docs.mapInArrow(work, f"{kinds}, n_tokens long")


_SHARED: list[Vocabulary] = []


def shared(vocab: Vocabulary) -> Vocabulary:
    """The worker's copy of an equal vocabulary, with its automaton and memory, across tasks."""
    if not _SHARED or _SHARED[0] is not vocab and _SHARED[0] != vocab:
        _SHARED[:] = [vocab]
    return _SHARED[0]
