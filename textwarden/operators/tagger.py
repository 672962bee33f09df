"""A sequence tagger of our own: an averaged perceptron over words, trained over partitions, decoded by Viterbi.

Training is by parameter mixing: in each round every partition goes once over its rows from the common weights, and sends
the changes it made as rows (feature, label, change); these are added up by a shuffle and averaged. Features are hashed to
``2 ** bits`` slots, so the weights that travel (and the table that the driver holds) have a size of their own, whatever the rows.
The last weights are the mean over the rounds. Decoding finds the best labels of many sentences at once: words that are outside whatever stands beside them are settled first, and the
stretches between these are searched step by step over places, all that are as long together.

Words are runs of letters and digits, with ``.``, ``-``, ``_``, ``'`` and ``@`` between such runs, or single other characters. A sentence ends with ``.``, ``!``
or ``?`` before white space, and with a line. Every text is tagged whole. Ties go to the label that comes first.

Null and empty texts have no words and no spans. Rows for training whose tokens and tags differ in number are left out.
"""

from __future__ import annotations

import itertools
import re
import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions.batches import pieces
from textwarden.sources.writers import settled

WORD = r"[\p{L}\p{N}]+(?:[.@_'-][\p{L}\p{N}]+)*|[^\x09-\x0D\x20\p{L}\p{N}]"
_WORD = re.compile(r"[^\W_]+(?:[.@_'-][^\W_]+)*|[^\x09-\x0D\x20]")
_SHAPE = ((re.compile(r"[a-z]+"), "x"), (re.compile(r"[A-Z]+"), "X"), (re.compile(r"[0-9]+"), "d"), (re.compile(r"[^Xxd]+"), "o"))
OUTSIDE = "O"


def shape(word: str) -> str:
    """Lower-case letters, capitals, digits and other characters, a sign for each run."""
    if word.isascii() and word.isalpha() and word[1:].islower():
        return "x" if word[0].islower() else "Xx"
    for rx, to in _SHAPE:
        word = rx.sub(to, word)
    return word


def words(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Places of the words, and the first word of each sentence (with the number of words last)."""
    at = [m.span() for m in _WORD.finditer(text)]
    first = [0]
    for i in range(1, len(at)):
        gap = text[at[i - 1][1] : at[i][0]]
        if "\n" in gap or (gap and text[at[i - 1][0] : at[i - 1][1]] in (".", "!", "?")):
            first.append(i)
    return at, [*first, len(at)] if at else [0]


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 0 white space, 1 a letter or digit, 2 what may stand between these, 3 any other."""
    kinds = np.full(sys.maxunicode + 1, 3, np.uint8)
    kinds[np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)] = 1
    kinds[[ord(c) for c in ".@_'-"]] = 2
    kinds[[*range(9, 14), 32]] = 0
    return kinds


def split(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts put together with a line end after each, starts and ends of all their words in it, and which begin a sentence; the same words and sentences as those of :func:`words`."""
    whole = "".join(f"{t}\n" for t in texts)
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[code]
    inner = kind == 1
    between = (kind[1:-1] == 2) & inner[:-2] & inner[2:]
    inner[1:-1] |= between
    other = ~inner & (kind != 0)
    start, end = other.copy(), other.copy()
    start |= inner & ~np.append(False, inner[:-1])
    end |= inner & ~np.append(inner[1:], False)
    a, z = np.flatnonzero(start), np.flatnonzero(end) + 1
    line = (code == 10).cumsum(dtype=np.int32)[a]
    stop = np.isin(code[a], [ord(c) for c in ".!?"])
    new = np.ones(len(a), bool)
    new[1:] = (line[1:] != line[:-1]) | (stop[:-1] & (a[1:] > z[:-1]))
    return whole, a, z, new


#: Signs of a shape by a number from 1, each with a character of its kind; a shape of at most SIGNS signs is a number to the base 5.
_KIND_OF = np.array([4] * 129, np.uint8)
_KIND_OF[97:123], _KIND_OF[65:91], _KIND_OF[48:58] = 1, 2, 3
LIKE, SIGNS = " aA0.", 27


def alike(whole: str, a: np.ndarray, z: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Words of different shapes, one of each, and which of them has the shape of each word from a to z."""
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KIND_OF[np.minimum(code, 128)]
    first, inside = np.zeros(len(code), bool), np.zeros(len(code) + 1, np.int8)
    first[a] = True
    np.add.at(inside, a, 1)
    np.add.at(inside, z, -1)
    turn = np.append(True, kind[1:] != kind[:-1])
    at = np.flatnonzero((first | turn) & (inside[:-1].cumsum(dtype=np.int8) > 0))
    begin = np.flatnonzero(first[at])
    size = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, size)
    key = np.add.reduceat(kind[at] * 5 ** np.minimum(place, SIGNS - 1).astype(np.int64), begin) if len(at) else np.zeros(0, np.int64)
    long = np.flatnonzero(size > SIGNS)
    key[long] = -1 - long  # each for itself
    keys, back = np.unique(key, return_inverse=True)
    signs = lambda k: [k // 5**i % 5 for i in range(SIGNS) if k >= 5**i] if k > 0 else kind[at[begin[-1 - k] : begin[-1 - k] + size[-1 - k]]].tolist()
    return ["".join(LIKE[x] for x in signs(k)) for k in keys.tolist()], back


class Names(NamedTuple):
    """Features of a word, of the word before it and of the one after, each a prefix and what is told of the word; ``pair`` is the prefix for the shapes of the one before and its own."""

    own: tuple[tuple[str, str], ...]
    before: tuple[tuple[str, str], ...]
    after: tuple[tuple[str, str], ...]
    pair: str | None = None


#: What is told of words, from them in lower case and their shapes.
TOLD: dict[str, Callable[[list[str], list[str]], list[str]]] = {
    "nothing": lambda low, shapes: [""] * len(low), "word": lambda low, shapes: low, "shape": lambda low, shapes: shapes, "length": lambda low, shapes: [str(min(len(w), 12)) for w in low],
    "head": lambda low, shapes: [w[:3] for w in low], "tail": lambda low, shapes: [w[-3:] for w in low],
}
#: The word itself, its shape, length, start and end, its neighbours' words and shapes, and its shape after the one before.
FEATURES = Names(
    (("bias", "nothing"), ("w=", "word"), ("s=", "shape"), ("n=", "length"), ("a=", "head"), ("z=", "tail")), (("l=", "word"), ("ls=", "shape")), (("r=", "word"), ("rs=", "shape")), "ss=",
)


def hashed(prefix: str, values: list[str], slots: int) -> np.ndarray:
    """The slots of features by their names, prefix and value."""
    first, few = zlib.crc32(prefix.encode()), dict.fromkeys(values)
    if 2 * len(few) > len(values):
        return np.array([zlib.crc32(v.encode(), first) for v in values], np.int64) % slots
    table = {v: zlib.crc32(v.encode(), first) % slots for v in few}
    return np.array([table[v] for v in values], np.int64)


class Seen:
    """The slots of the features of the different words that a task has met, about ``most`` of them at a time; number 0 is the place beyond a sentence's ends."""

    def __init__(self, slots: Callable[[str, list[str]], np.ndarray], names: Names = FEATURES, most: int = 1 << 17, emit: np.ndarray | None = None):
        """With ``emit``, a row for each slot, the sums of its rows are kept for each word."""
        self.of_names, self.names, self.most, self.emit = slots, names, most, emit
        self.wide = tuple(map(len, names[:3]))
        self._anew()

    def _anew(self) -> None:
        self.ids: dict[str, int] = {}
        self.shapes: dict[str, int] = {"<": 0}
        self.pairs: dict[int, int] = {}
        edge = [self.of_names(p, [x])[0] for x, ps in (("<", self.names.before), (">", self.names.after)) for p, _ in ps]
        self.rows = np.array([[0] * self.wide[0] + edge], np.int32)  # the slots of a word, as the one before, and as the one after
        self.shape_of = np.zeros(1, np.int32)
        self.sums = None if self.emit is None else self._summed(self.rows)

    def _summed(self, rows: np.ndarray) -> list[np.ndarray]:
        """Of words as they are, as the ones before, and as the ones after."""
        return [self.emit[x].sum(1) for x in np.split(rows, np.cumsum(self.wide)[:2], 1)]

    def _add(self, words: list[str]) -> None:
        low, shapes = [w.lower() for w in words], [*map(shape, words)]
        told = {k: TOLD[k](low, shapes) for k in {k for ps in self.names[:3] for _, k in ps}}
        rows = np.array([self.of_names(p, told[k]) for ps in self.names[:3] for p, k in ps], np.int32).T
        self.rows = np.concatenate([self.rows, rows])
        if self.sums:
            self.sums = [np.concatenate(x) for x in zip(self.sums, self._summed(rows), strict=True)]
        if self.names.pair:
            self.shape_of = np.concatenate([self.shape_of, np.array([self.shapes.setdefault(s, len(self.shapes)) for s in shapes], np.int32)])

    def of(self, words: list[str]) -> np.ndarray:
        """The numbers of words."""
        if len(self.ids) > self.most:
            self._anew()
        ids = self.ids
        out = [ids.get(w, 0) for w in words]
        if 0 in out:
            lacking = list(dict.fromkeys(w for w, i in zip(words, out, strict=True) if not i))
            first = len(self.rows)
            self._add(lacking)
            ids.update(zip(lacking, range(first, first + len(lacking)), strict=True))
            out = [i or ids[w] for w, i in zip(words, out, strict=True)]
        return np.array(out, np.int32)

    def pair_slots(self, before: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of the different pairs of shapes, and which of them each word has."""
        keys, back = np.unique(self.shape_of[before].astype(np.int64) << 32 | self.shape_of[own], return_inverse=True)
        lacking = [k for k in keys.tolist() if k not in self.pairs]
        if lacking:
            names = list(self.shapes)
            self.pairs.update(zip(lacking, self.of_names(self.names.pair, [f"{names[k >> 32]}|{names[k & 0xFFFFFFFF]}" for k in lacking]).tolist(), strict=True))
        return np.array([self.pairs[k] for k in keys.tolist()], np.int32), back


def slots_of(rows: np.ndarray, wide: tuple[int, int, int], ids: np.ndarray, before: np.ndarray, after: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Words x slots."""
    a, b = wide[0], wide[0] + wide[1]
    return np.concatenate([rows[ids, :a], rows[before, a:b], rows[after, b:], pair[:, None]], 1)


def neighbours(ids: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words before and after; ``new`` marks the first words of sentences."""
    before, after = np.zeros_like(ids), np.zeros_like(ids)
    before[1:] = np.where(new[1:], 0, ids[:-1])
    after[:-1] = np.where(new[1:], 0, ids[1:])
    return before, after


#: Words that are scored at once.
AT_ONCE = 1 << 14


@dataclass
class Model:
    """labels, emit (slots x labels), move (labels x labels, from row to column), start; ``slots`` turns the names of features to rows of emit."""

    labels: tuple[str, ...]
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray
    slots: dict[str, int] | None = None  # none: hashed
    names: Names = FEATURES

    def of_names(self, prefix: str, values: list[str]) -> np.ndarray:
        """Rows of emit of features; the number of rows stands for a feature without one."""
        return hashed(prefix, values, len(self.emit)) if self.slots is None else np.array([self.slots.get(prefix + v, len(self.emit)) for v in values], np.int64)

    def seen(self) -> Seen:
        return Seen(self.of_names, self.names, emit=np.concatenate([self.emit, np.zeros((1, len(self.labels)), self.emit.dtype)]))

    @property
    def only_shapes(self) -> bool:
        """Whether nothing but the shapes of words counts."""
        return {k for ps in self.names[:3] for _, k in ps} == {"shape"}

    def scored(self, seen: Seen, ids: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Words x labels of the words of sentences, by their numbers."""
        before, after = neighbours(ids, new)
        own, left, right = seen.sums
        out = own[ids].astype(np.float64)
        out += left[before]
        out += right[after]
        if self.names.pair:
            keys, back = seen.pair_slots(before, ids)
            out += seen.emit[keys][back]
        return out

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Words x labels of one sentence."""
        seen = self.seen()
        return self.scored(seen, seen.of(tokens), np.arange(len(tokens)) == 0)


def _paths(scores: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best labels of stretches of words that begin at ``first``: step by step over places, for all stretches that are as long."""
    out = np.zeros(len(scores), np.int64)
    size = np.diff(np.append(first, len(scores)))
    order = np.argsort(-size, kind="stable")
    begin, size = first[order], size[order]
    deep = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, deep + 1), "right").tolist()  # stretches with a word at each place
    wide = range(len(move))
    back, last, best = [np.zeros((0, 0), np.int8)], np.zeros(len(size), np.int64), scores[begin].T.copy()
    step = [x[:, None] for x in move]
    for t in range(1, deep):
        k = live[t]
        if k < live[t - 1]:
            last[k : live[t - 1]] = best[:, k:].argmax(0)
        most, of = best[0, :k] + step[0], np.zeros((len(move), k), np.int8)
        for j in wide[1:]:  # the first of the best
            way = best[j, :k] + step[j]
            of[way > most] = j
            np.maximum(most, way, out=most)
        back.append(of)
        best = most + scores[begin[:k] + t].T
    if deep:
        last[: live[-1]] = best.argmax(0)
    label = np.zeros(0, np.int64)
    for t in range(deep - 1, -1, -1):
        k, longer = live[t], len(label)
        if longer:
            label = back[t + 1][label, np.arange(longer)]
        label = np.append(label, last[longer:k])
        out[begin[:k] + t] = label
    return out


def decoded(move: np.ndarray, start: np.ndarray, scores: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The best labels of the words of sentences, as numbers; ``new`` marks the first words.

    A word for which the first label is better than each other, whatever stands beside it, has it on any best path; only the stretches between such words are searched.
    """
    left = np.maximum((move - move[:, :1]).max(0), start - start[0])
    right = np.maximum((move - move[:1]).max(1), 0)
    open_ = ~(scores[:, 1:] - scores[:, :1] + (left + right)[1:] < -1e-6).all(1)
    out = np.zeros(len(scores), np.int64)
    at = np.flatnonzero(open_)
    if not len(at):
        return out
    begins = new[at] | ~open_[at - 1] | (at == 0)
    ends = np.append(new, True)[at + 1] | ~np.append(open_, False)[at + 1]
    own = scores[at]
    own[begins] += np.where(new[at[begins], None], start, move[0])
    inside = ends & ~np.append(new, True)[at + 1]  # a word that has the first label follows
    own[inside] += move[:, 0]
    out[at] = _paths(own, np.flatnonzero(begins), move)
    return out


def viterbi(m: Model, scores: list[np.ndarray]) -> list[np.ndarray]:
    """The best labels of each sentence, as numbers."""
    size = np.array([len(s) for s in scores], np.int64)
    first = np.append(0, size.cumsum())
    new = np.zeros(first[-1], bool)
    new[first[:-1][size > 0]] = True
    flat = np.concatenate([np.zeros((0, len(m.labels))), *scores])
    return np.split(decoded(m.move, m.start, flat, new), first[1:-1]) if len(scores) else []


class Part(NamedTuple):
    """Sentences to learn from: the slots of the different words (see Seen), and of each word its number, those beside it, the slots of its pair of shapes, its label, and whether it is a first one."""

    rows: np.ndarray
    wide: tuple[int, int, int]
    ids: np.ndarray
    before: np.ndarray
    after: np.ndarray
    pair: np.ndarray
    truth: np.ndarray
    new: np.ndarray


def _places(first: np.ndarray, n: int, order: np.ndarray) -> np.ndarray:
    """The places of n words, in sentences that begin at ``first``, with the sentences in another order."""
    size = np.diff(np.append(first, n))[order]
    return np.repeat(first[order] - (size.cumsum() - size), size) + np.arange(n)


def _learn(p: Part, emit: np.ndarray, move: np.ndarray, start: np.ndarray, seed: int) -> None:
    """One pass of the perceptron over the sentences, one after the other; the weights are changed in place.

    Many sentences are decoded at once; behind the first mistake, which changes the weights, they are decoded again. So the result is that of decoding them one by one.
    """
    first = np.flatnonzero(p.new)
    at = _places(first, len(p.new), np.random.default_rng(seed).permutation(len(first)))
    p = p._replace(**{k: getattr(p, k)[at] for k in ("ids", "before", "after", "pair", "truth", "new")})
    first = np.append(np.flatnonzero(p.new), len(p.new))
    i, many = 0, 1
    while i < len(first) - 1:
        # as many sentences as went without a mistake last time, and no more words than are scored at once unless one sentence has them
        j = max(i + 1, min(i + many, int(np.searchsorted(first, first[i] + AT_ONCE, "right")) - 1, len(first) - 1))
        at = slice(first[i], first[j])
        slots = slots_of(p.rows, p.wide, p.ids[at], p.before[at], p.after[at], p.pair[at])
        guess = decoded(move, start, emit[slots].sum(1).astype(np.float64), p.new[at])
        wrong = np.flatnonzero(guess != p.truth[at])
        if not len(wrong):
            i, many = j, min(2 * many, AT_ONCE)
            continue
        k = int(np.searchsorted(first, first[i] + wrong[0], "right")) - 1
        a, b = first[k] - first[i], first[k + 1] - first[i]
        own, y, g = slots[a:b], p.truth[at][a:b].astype(np.int64), guess[a:b]
        off = y != g
        for label, by in ((y, 1), (g, -1)):
            np.add.at(emit, (own[off], label[off, None]), by)
            moved = off[1:] | off[:-1]
            np.add.at(move, (label[:-1][moved], label[1:][moved]), by)
            start[label[0]] += by * off[0]
        i, many = k + 1, max(1, 2 * (k - i))


#: Words of a part: a task of the training holds so many.
PART_WORDS = 1 << 19
_PACKED = "rows binary, ids binary, pair binary, truth binary, fresh binary"


def _packs(labels: tuple[str, ...], slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of tokens and tags of a partition as one row, its Part."""
    index = {t: i for i, t in enumerate(labels)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(lambda prefix, values: hashed(prefix, values, slots), most=sys.maxsize)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            size = np.asarray(batch.column(0).value_lengths()).astype(np.int64)
            coded = batch.column(0).flatten().dictionary_encode()
            known = coded.dictionary.to_pylist()
            ids = np.append(seen.of(known), seen.of([""]))[coded.indices.fill_null(len(known)).to_numpy()]
            stop = np.append([w in (".", "!", "?") for w in known], False)[coded.indices.fill_null(len(known)).to_numpy()]
            tags = batch.column(1).flatten().dictionary_encode()
            truth = np.append([index[t] for t in tags.dictionary.to_pylist()], 0).astype(np.int16)[tags.indices.fill_null(-1).to_numpy()]
            new = np.append(False, stop[:-1])
            new[size.cumsum() - size] = True
            held.append((ids, truth, new))
        if not held:
            return
        ids, truth, new = (np.concatenate(x) for x in zip(*held, strict=True))
        beside = neighbours(ids, new)
        keys, back = seen.pair_slots(beside[0], ids)
        pair = keys[back]
        # the same order whichever way the rows came
        names, first = slots_of(seen.rows, seen.wide, ids, *beside, pair), np.flatnonzero(new)
        keys = [repr((names[a:b].tolist(), truth[a:b].tolist())) for a, b in itertools.pairwise([*first.tolist(), len(new)])]
        at = _places(first, len(new), np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64))
        ids, pair, truth, new = ids[at], pair[at], truth[at], new[at]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (seen.rows, ids, pair, truth, new)], ["rows", "ids", "pair", "truth", "fresh"])

    return work


def _part(batch: pa.RecordBatch, i: int) -> Part:
    rows, ids, pair, truth, new = (np.frombuffer(batch.column(k)[i].as_py(), kind) for k, kind in enumerate((np.int32, np.int32, np.int32, np.int16, np.bool_)))
    wide = tuple(map(len, FEATURES[:3]))
    return Part(rows.reshape(-1, sum(wide)), wide, ids, *neighbours(ids, new), pair, truth, new)


def fit(rows: DataFrame, tokens: str = "tokens", tags: str = "tags", rounds: int = 5, bits: int = 15, part_rows: int = 5000, seed: int = 3) -> Model | None:
    """A model from rows of tokens and tags; None without any. The driver holds 2 ** bits weights for each label.

    Equal rows count once; a task holds about ``part_rows`` of them, or PART_WORDS words. The rows are made once: they go to the shared folder, and then their parts, as numbers.
    """
    d = rows.where(f"size(`{tokens}`) = size(`{tags}`) AND size(`{tags}`) > 0").select(F.col(tokens).alias("tokens"), F.col(tags).alias("tags")).distinct()
    d = settled(d)
    named = [r.t for r in d.select(F.explode("tags").alias("t")).where("t IS NOT NULL").distinct().orderBy("t").collect()]  # a row for each label
    if not named:
        return None
    labels = tuple(sorted(named, key=lambda t: (t != OUTSIDE, t)))
    wide, slots = len(labels), 1 << bits
    n, n_words = d.selectExpr("count(1)", "sum(size(tokens))").first()
    d = d.repartition(max(4, -(-n // part_rows), -(-n_words // PART_WORDS)), F.xxhash64("tokens", "tags"))
    d = settled(d.mapInArrow(_packs(labels, slots), _PACKED))
    parts = d.count()
    # rows of the weights: the slots, then the moves from each label, then the start
    total = np.zeros((slots + wide + 1, wide), np.float32)
    mean = np.zeros_like(total)

    def passed(weights: np.ndarray, turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    own = weights.copy()
                    _learn(_part(batch, i), own[:slots], own[slots : slots + wide], own[slots + wide], seed + turn)
                    change = own - weights
                    at = np.argwhere(change)
                    yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(change[at[:, 0], at[:, 1]].astype(np.float64))], ["slot", "label", "change"])

        return work

    for turn in range(rounds):
        changes = d.mapInArrow(passed(total.copy(), turn), "slot int, label int, change double")
        for r in changes.groupBy("slot", "label").agg((F.sum("change") / parts).alias("change")).collect():  # at most a row for each weight
            total[r.slot, r.label] += r.change
        mean += total / rounds
    return Model(labels, mean[:slots], mean[slots : slots + wide], mean[slots + wide])


def load(m: Model) -> Callable[[list[str]], list[list[tuple[int, int, str]]]]:
    """A tagger for :func:`layers.tag`: (start, end, label) of the stretches of words of each text with one label; with B- and I- before labels, B- begins anew."""
    seen = m.seen()
    names = [t[2:] if t[:2] in ("B-", "I-") else t for t in m.labels]
    name_of = np.array([sorted(set(names)).index(n) for n in names])
    outside, begins = np.array([n == OUTSIDE for n in names]), np.array([t[:2] == "B-" for t in m.labels])

    def tag(texts: list[str]) -> list[list[tuple[int, int, str]]]:
        whole, a, z, new = split(texts)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(a):
            return out
        if m.only_shapes:
            like, back = alike(whole, a, z)
            ids = seen.of(like)[back]
        else:
            ids = seen.of([whole[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)])
        labels = decoded(m.move, m.start, m.scored(seen, ids, new), new)
        # a span ends before the next word that begins one or is outside
        same = np.append(False, ~new[1:] & (name_of[labels[1:]] == name_of[labels[:-1]]) & ~begins[labels[1:]])
        first = np.flatnonzero(~same & ~outside[labels])
        turns = np.flatnonzero(~same)
        last = np.append(turns, len(a))[np.searchsorted(turns, first) + 1] - 1
        base = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        row = np.searchsorted(base, a[first], "right") - 1
        for i, x, y, k in zip(row.tolist(), (a[first] - base[row]).tolist(), (z[last] - base[row]).tolist(), labels[first].tolist(), strict=True):
            out[i].append((x, y, names[k]))
        return out

    return tag


def token_rows(df: DataFrame, key: str, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """(key, tokens, tags): words of texts, tagged with the class of the first (then longest) span that covers them whole, B- at its start and I- after."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at, _ = words(text or "")
                left = sorted(((s["start"], -s["end"], s["class"]) for s in spans or []), reverse=True)
                tags, active, last = [], [], None
                for a, b in at:
                    while left and left[-1][0] <= a:
                        active.append(left.pop())
                    active = [s for s in active if -s[1] > a]
                    here = next((s for s in active if -s[1] >= b), None)
                    tags.append(OUTSIDE if here is None else f"{'I' if here is last else 'B'}-{here[2]}")
                    last = here
                out.append(([(text or "")[a:b] for a, b in at], tags))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.list_(pa.string())), pa.array([x[1] for x in out], pa.list_(pa.string()))], [key, "tokens", "tags"])

    d = df.select(key, text_col, F.expr(f"transform(`{spans_col}`, s -> struct(s.start AS start, s.end AS `end`, s.class AS class))").alias("spans"))
    return d.mapInArrow(work, f"`{key}` {dict(df.dtypes)[key]}, tokens array<string>, tags array<string>")
