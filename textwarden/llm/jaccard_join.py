"""Similarity join of n-gram sets by PartEnum signatures, and its connected components.

Two sets link if 100 * |intersection| >= percent * |union|.

1. Documents with equal sets are one node, named by a 64-bit hash of its set.
2. Signatures. Sizes fall into bands so that linked sets lie in the same or neighbouring bands. For the
   band pair that ends at size r, linked sets differ in at most k = (2 r) (100 - percent) / (100 + percent)
   n-grams. The domain of n-grams is hashed into n1 = k / 2 + 1 partitions of ``SUB`` subpartitions each. In some
   partition two linked sets differ in at most one n-gram, so of the subsets that leave one subpartition out, one
   at least holds the same n-grams of both: its signature is shared. A set sends all these subsets but the
   smallest: where linked sets surely share q subsets, the largest of the shared has q - 1 smaller ones in either
   set, so each may leave its q - 1 smallest out (k and q from the set's own size and those it can link with).
3. Signatures go to hash ranges, packed for a few MB of documents at a time. Nodes that share one are a group,
   groups with common members are a family.
4. Links of a family of a load of up to ``UNIT``: its sets meet in one task, where members are compared by prefix filter
   and exact count until all that link are joined.
5. Larger families. Each node is compared with its most frequent group leader, which joins most of a set's near copies.
   What is left is signed again, by n-grams that are rare in the family (counts over the whole family): partitions
   that hold a rarer n-gram are sent first, and those with one that no other member has not at all. Groups inside one
   component can't change it and are dropped. The rest form new families, which again meet in one task; one
   that is still larger is dealt to chunks, and a node goes to those chunks only with which it shares a signature.
   Nothing emits all pairs of a group. Sets travel as 48-bit hashes: two different n-grams of a compared pair pass for
   one with probability below 1e-8.
6. Families and components by contraction: each node goes to its smallest neighbour (from the third round on by a hash drawn
   for the round), and on to that one's, so that a chain shrinks by a factor a round. Rounds are written to the shared folder.

Results for odd input: null, blank or empty text has an empty set (0 n-grams) and is its own component;
fewer words than n make one n-gram of all words; repeated rows are equal sets and link; null ids take part
in links but never name a component (a component of null ids only has a null name); a similarity of exactly ``percent``
links; a very long text is one set like any other; extra columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm import blocks as B
from textwarden.llm.hashing import U64, Rolling, expand, mix
from textwarden.llm.storage import give_back, removed, stored

#: Load of a family that is compared in one task: a member counts 1, and 1 more for each WEIGHT n-grams.
UNIT, WEIGHT = 4096, 1024
#: Most keys whose rows are joined by broadcast: those with one row in HOT or more.
HOT = 1000
#: Subpartitions of a partition; a signature leaves one out.
SUB = 3


def block_sets(b: B.Block, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' sorted distinct n-gram hashes end to end, their sizes, and each set's name (0 if empty)."""
    words, first = B.word_hashes(b, fold=True)
    roll = Rolling(words)
    size = np.diff(first)
    grams = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    start = expand(first[:-1], grams)
    doc = np.repeat(np.arange(b.n), grams)
    end = start + np.repeat(np.minimum(size, n), grams)
    h = roll.of(start, end)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    count = np.bincount(doc, minlength=b.n)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h + U64(1)), dtype=U64)))
    cut = np.concatenate(([0], np.cumsum(count)))
    name = mix((total[cut[1:]] - total[cut[:-1]]) ^ mix(count.astype(U64) + U64(77)))
    return h, count, np.where(count > 0, name, U64(0))


def bands(longest: int, percent: int) -> np.ndarray:
    """Last sizes of the bands, up to two beyond the longest."""
    last, low = [], 1
    beyond = 0
    while beyond < 2:
        last.append(100 * low // percent)
        beyond += last[-1] >= longest
        low = last[-1] + 1
    return np.array(last, np.int64)


def signatures(h: np.ndarray, count: np.ndarray, percent: int, sub: int = SUB, spare: float = 0.0, rarity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all (non-empty) sets, and the set each belongs to.

    ``spare`` adds that share of partitions, which allows more subsets to be left out. With ``rarity`` (in how many sets
    each n-gram occurs) subsets with the rarest n-grams are sent first, and those with an n-gram of one set only not at all.
    """
    if not len(h):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    last = bands(int(count.max()), percent)
    own = np.searchsorted(last, count)
    doc = np.repeat(np.arange(len(count)), count)
    weight = mix(h + U64(3))
    place = mix(h ^ U64(0x51ED270B)) >> U64(32)
    sigs, of = [], []
    for j in (own, own + 1):
        k = 2 * last[j] * (100 - percent) // (100 + percent)
        largest = np.minimum(last[j], 100 * count // percent)  # that this set can link with
        own_k = np.where((j == own) | (largest > last[own]), (count + largest) * (100 - percent) // (100 + percent), 0)
        first = ((k // 2 + 1) * (1 + spare)).astype(np.int64)
        cells = first * sub
        base = np.cumsum(cells) - cells
        cell = base[doc] + (place * cells[doc].astype(U64) >> U64(32)).astype(np.int64)
        total = np.zeros(cells.sum(), U64)
        np.add.at(total, cell, weight)
        total = total.reshape(-1, sub)
        total = (total.sum(axis=1, dtype=U64)[:, None] - total).ravel()
        if rarity is None:
            held = np.bincount(cell, minlength=len(total)).reshape(-1, sub)
            rank = 65535 - np.minimum(held.sum(axis=1)[:, None] - held, 65535).ravel()
        else:
            least = np.full(len(total), 65535, np.int64)
            np.minimum.at(least, cell, np.minimum(rarity, 65535).astype(np.int64))
            least = least.reshape(-1, sub)
            rank = np.stack([np.delete(least, i, axis=1).min(axis=1) for i in range(sub)], axis=1).ravel()
        # own_k differences spoil at most so many subsets: one each in as many partitions as there are, then a second
        spoilt = np.where(own_k <= first, (sub - 1) * own_k, (sub - 2) * first + own_k)
        sent = np.where(own_k > 0, spoilt + 1, 0)  # sets that can differ in nothing are equal
        owner = np.repeat(np.arange(len(count)), cells)
        order = np.argsort(owner << 16 | rank, kind="stable")
        keep = order[np.arange(len(order)) - base[owner] < sent[owner]]
        if rarity is not None:
            keep = keep[rank[keep] > 1]
        label = j[owner[keep]].astype(U64) * U64(0x100000001B3) + (keep - base[owner[keep]]).astype(U64)
        sigs.append(mix(total[keep] ^ mix(label + U64(0x5BD1E995))))
        of.append(owner[keep])
    return np.concatenate(sigs), np.concatenate(of)


def roots(node: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of nodes in groups laid end to end: the smallest node that groups with common members reach."""
    if not len(node):
        return node
    names, at = np.unique(node, return_inverse=True)
    label, start = np.arange(len(names)), np.cumsum(size) - size
    while True:
        low = np.repeat(np.minimum.reduceat(label[at], start), size)
        new = label.copy()
        np.minimum.at(new, at, low)
        new = new[new]  # a label is a node, whose own label is no larger
        if (new == label).all():
            return names[label[at]]
        label = new


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[B.Block]:
    """Documents of a task in chunks of a few MB."""
    held, size = [], 0
    for batch in batches:
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            held.append(part)
            size += part.column("text").nbytes
            if size >= B.BLOCK_BYTES:
                yield _block(held)
                held, size = [], 0
                give_back()
    if held:
        yield _block(held)


def _block(held: list[pa.RecordBatch]) -> B.Block:
    """The documents as a block, which holds any other columns in its order too."""
    table = pa.Table.from_batches(held)
    b = B.Block(table)
    b.carried = {c: table[c].take(b.order) for c in table.column_names if c not in ("doc_id", "text")}
    return b


def _slices(sig: np.ndarray, of: np.ndarray, buckets: int, columns: list[np.ndarray], low: int = 0, high: int = 1 << 64) -> list[tuple]:
    """(bucket, signatures, members, a packed array for each of the columns of members) of each hash range met."""
    order = np.argsort(sig, kind="stable")
    sig, of = sig[order], of[order]
    cut = B.slices(sig, buckets, low, high)
    rows = []
    for i in np.flatnonzero(np.diff(cut)):
        part = slice(cut[i], cut[i + 1])
        used, place = np.unique(of[part], return_inverse=True)
        rows.append((int(i), B.pack_sorted(sig[part]), B.pack(place.astype(np.uint32)), *[c[used].tobytes() for c in columns]))
    return rows


def _met(table: pa.Table, columns: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sizes of the groups of one hash range, and the columns' values of their members (distinct by the first column), laid end to end."""
    sig, values = [], [[] for _ in columns]
    for row in zip(*(table[c].to_pylist() for c in ("sigs", "of", *columns)), strict=True):
        sig.append(B.unpack_sorted(row[0]))
        place = B.unpack(row[1], np.uint32)
        for v, x in zip(values, row[2:], strict=True):
            v.append(np.frombuffer(x, np.int64)[place])
    if not sig:
        return np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in columns]
    sig, values = np.concatenate(sig), [np.concatenate(v) for v in values]
    # only signatures met more than once need the finer order
    order = np.argsort(sig, kind="stable")
    same = sig[order[1:]] == sig[order[:-1]]
    keep = np.zeros(len(order), bool)
    keep[1:] |= same
    keep[:-1] |= same
    order = order[keep]
    order = order[np.lexsort((values[0][order], sig[order]))]
    sig, values = sig[order], [v[order] for v in values]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (values[0][1:] != values[0][:-1])
    sig, values = sig[new], [v[new] for v in values]
    head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(sig)))
    head, size = head[size > 1], size[size > 1]
    pick = expand(head, size)
    return size, [v[pick] for v in values]


def _groups(docs: DataFrame, lay: B.Layout, n: int, percent: int) -> DataFrame:
    """(node, root, leader, sigs): nodes that share signatures with others.

    root is the smallest node that groups of one hash range lead to, leader the smallest node of the groups
    that the node is in most often there. One row per node and root. Of the nodes of a chunk that share a signature only the
    smallest is sent for it, and is root and leader of the others; so a signature of a third of all rows is one entry a chunk.
    Beyond :data:`blocks.FAN` hash ranges signatures go to coarse ranges of some chunks first, and from there to the ranges.
    """
    supers, buckets, fine = lay.steps

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            h, count, name = block_sets(b, n)
            live = np.flatnonzero(count)
            _, lead = np.unique(name[live], return_index=True)
            lead = np.sort(live[lead])
            start = np.cumsum(count) - count
            sig, of = signatures(h[expand(start[lead], count[lead])], count[lead], percent)
            names = name[lead].view(np.int64)
            order = np.argsort(sig, kind="stable")
            order = order[np.lexsort((names[of[order]], sig[order]))]
            sig, of = sig[order], of[order]
            new = np.append(True, sig[1:] != sig[:-1])[: len(sig)]
            rows = [(*row, None) for row in _slices(sig[new], of[new], buckets, [names])]
            pairs = np.stack((names[of], names[of[new]][np.cumsum(new) - 1]))[:, ~new] if len(sig) else np.zeros((2, 0), np.int64)
            if pairs.size:
                rows.append((int(pairs[1, 0] % buckets), None, None, None, pairs.tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "sigs", "of", "names", "pairs"])

    def meet(table: pa.Table) -> pa.Table:
        local = [np.frombuffer(x, np.int64).reshape(2, -1) for x in table["pairs"].drop_null().to_pylist()]
        size, (node,) = _met(table.filter(pc.is_valid(table["sigs"])), ["names"])
        start = np.cumsum(size) - size
        root = roots(node, size)
        leader = np.repeat(node[start], size) if len(size) else node
        if local:
            local = np.concatenate(local, axis=1)
            node, root, leader = np.concatenate((node, *local)), np.concatenate((root, local[1], local[1])), np.concatenate((leader, local[1], local[1]))
        # per node and root the leader met most often, of equals the smallest
        order = np.lexsort((leader, root, node))
        n2, l2, r2 = node[order], leader[order], root[order]
        head = np.flatnonzero(np.append(True, (n2[1:] != n2[:-1]) | (l2[1:] != l2[:-1]) | (r2[1:] != r2[:-1]))) if len(n2) else np.zeros(0, np.int64)
        times = np.diff(np.append(head, len(n2)))
        n2, l2, r2 = n2[head], l2[head], r2[head]
        order = np.lexsort((l2, -times, r2, n2))
        first = order[np.append(True, (n2[order][1:] != n2[order][:-1]) | (r2[order][1:] != r2[order][:-1]))] if len(order) else order
        return pa.table({"node": n2[first], "root": r2[first], "leader": l2[first], "sigs": times[first]})

    kind = "bucket int, sigs binary, of binary, names binary, pairs binary"

    def relay(table: pa.Table) -> pa.Table:
        """The signatures that some chunks sent to a coarse range, cut into its ranges; pairs go on as they are."""
        i = table["bucket"][0].as_py()
        pairs = table["pairs"].drop_null().to_pylist()
        table = table.filter(pc.is_valid(table["sigs"]))
        sig = [B.unpack_sorted(x) for x in table["sigs"].to_pylist()]
        names = [np.frombuffer(x, np.int64)[B.unpack(of, np.uint32)] for of, x in zip(table["of"].to_pylist(), table["names"].to_pylist(), strict=True)]
        rows = []
        if sig:
            one, of = np.unique(np.concatenate(names), return_inverse=True)
            rows = [(i * fine + r[0], *r[1:], None) for r in _slices(np.concatenate(sig), of, fine, [one], *B.coarse_range(i, buckets))]
        rows += [(i * fine + k % fine, None, None, None, x) for k, x in enumerate(pairs)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), *[pa.binary()] * 4), strict=True)], ["bucket", "sigs", "of", "names", "pairs"])

    sent = docs.mapInArrow(send, kind)
    if supers:
        some = sent.withColumn("super", F.pmod(F.xxhash64("sigs", "pairs"), F.lit(supers)))
        sent = B.dealt(some, lay, "super", "bucket").groupBy("super", "bucket").applyInArrow(relay, kind)
    met = B.dealt(sent, lay, "bucket").groupBy("bucket").applyInArrow(meet, "node long, root long, leader long, sigs long")
    best = F.struct(F.col("leader") != F.col("node"), "sigs", -F.col("leader"))
    return met.groupBy("node", "root").agg(F.max_by("leader", best).alias("leader"), F.max("sigs").alias("sigs"))


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The rows wanted (node, family, members, leader) with size and grams, packed. Texts move once, compressed, one of each node and chunk."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            _, count, names = block_sets(b, n)
            live = np.flatnonzero(count)
            _, lead = np.unique(names[live], return_index=True)
            lead = live[lead]
            z = B.zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays([pa.array(names[lead].view(np.int64)), pa.array([z.compress(b.text(i)) for i in lead], pa.binary())], ["node", "packed"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                z = B.zstandard.ZstdDecompressor()
                texts = pa.array([z.decompress(x) if x else b"" for x in part["packed"].to_pylist()], pa.binary())
                b = B.Block(pa.table({"doc_id": part["node"], "text": texts}))
                h, count, _ = block_sets(b, n)
                short = h >> U64(16)  # the order stays
                cut = np.cumsum(count)[:-1]
                cols = [part[c].take(b.order) for c in ("node", "family", "members", "leader")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(count, pa.int64()), pa.array([B.pack_sorted(x) for x in np.split(short, cut)], pa.binary())], ["node", "family", "members", "leader", "size", "grams"])

    named = docs.mapInArrow(name, "node long, packed binary")
    one = named.join(wanted, "node").groupBy("node").agg(*[F.first(c).alias(c) for c in ("family", "members", "leader", "packed")])
    return one.mapInArrow(sets, "node long, family long, members long, leader long, size long, grams binary")


def _linked(sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a node and its leader that link, by exact intersection."""
    one = sets.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"), F.col("size").alias("na"), F.col("grams").alias("ga"))
    two = sets.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("grams").alias("gb"))
    both = one.join(two, "b").where(f"{percent} * greatest(na, nb) <= 100 * least(na, nb)")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ga, gb in zip(batch["ga"].to_pylist(), batch["gb"].to_pylist(), strict=True):
                x, y = B.unpack_sorted(ga), B.unpack_sorted(gb)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ga", "gb").mapInArrow(test, "a long, b long")


def _contract(edges: DataFrame) -> DataFrame | None:
    """(node, comp) for the nodes of the edges; None without edges."""
    maps = []
    edges = stored(edges.where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        # names are hashes, so their own order does for a start
        drawn = lambda c: F.struct((F.col(c) if len(maps) < 2 else F.xxhash64(c, F.lit(len(maps)))).alias("draw"), F.col(c).alias("name"))  # noqa: B023, E731
        up = ends.groupBy("node").agg(F.min(drawn("other")).alias("low")).select("node", F.least("low", drawn("node")).getField("name").alias("up"))
        low = stored(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("comp")), "up").select("node", "comp"), "low")
        maps.append(low)
        a, b = low.select(F.col("node").alias("a"), F.col("comp").alias("ca")), low.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        fewer = stored(edges.join(a, "a").join(b, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "edges")
        removed(edges)
        edges = fewer
    removed(edges)
    if not maps:
        return None
    out = maps[0]
    for m in maps[1:]:
        step = m.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        out = out.join(step, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))
    if len(maps) == 1:
        return out
    whole = stored(out, "comps")
    removed(*maps)
    return whole


def unit_links(node: np.ndarray, comp: np.ndarray, grams: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, enough to join all components that links join."""
    size = np.array([len(g) for g in grams])
    body = np.concatenate(grams)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(grams)), size)
    _, token, freq = np.unique(body, return_inverse=True, return_counts=True)
    order = np.lexsort((token, freq[token], owner))
    prefix = size - -(-percent * size // 100) + 1
    take = order[expand(start, prefix)]
    mine = token[take]
    by = np.argsort(mine, kind="stable")
    posted = owner[take][by]
    n_posted = np.bincount(mine, minlength=len(freq))
    post_at = np.cumsum(n_posted) - n_posted
    at = np.cumsum(prefix) - prefix
    label = np.unique(comp, return_inverse=True)[1]
    left, out = len(np.unique(label)), []
    for x in range(len(grams)):
        if left < 2:
            break
        mark = mine[at[x] : at[x] + prefix[x]]
        mark = mark[n_posted[mark] > 1]
        near = posted[expand(post_at[mark], n_posted[mark])]
        near = near[(near > x) & (label[near] != label[x])]
        near = np.unique(near[percent * np.maximum(size[near], size[x]) <= 100 * np.minimum(size[near], size[x])])
        if not len(near):
            continue
        common = np.isin(token[expand(start[near], size[near])], token[start[x] : start[x] + size[x]])
        common = np.add.reduceat(common.astype(np.int64), np.cumsum(size[near]) - size[near])
        for y in near[100 * common >= percent * (size[near] + size[x] - common)].tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                left -= 1
                out.append((int(node[x]), int(node[y])))
    return out


def _solved(sets: DataFrame, percent: int) -> DataFrame:
    """(node, comp) of families that fit into a task."""

    def solve(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        pairs = unit_links(node, node, [B.unpack_sorted(x) for x in table["grams"].to_pylist()], percent)
        root = {x: x for x in node.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in pairs:
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        return pa.table({"node": pa.array(node, pa.int64()), "comp": pa.array([find(x) for x in node.tolist()], pa.int64())})

    return sets.select("family", "node", "grams").groupBy("family").applyInArrow(solve, "node long, comp long")


def _signed_again(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root, comp, load, own, mates) of the nodes (family, members, node, comp, grams) that share a signature with another component's.

    root joins the groups of one hash range, own is the node's chunk in its family, mates the chunks of the other
    components' nodes that it meets there.
    """
    unit = UNIT
    total = sets.agg(F.sum(F.octet_length("grams"))).first()[0] or 0
    lay = B.Layout(B.LEAST + total // B.BLOCK_BYTES, B.LEAST + total // B.BUCKET_BYTES)
    blocks = sets.select(F.pmod(F.xxhash64("node"), F.lit(lay.blocks)).cast("int").alias("block"), "family", "members", "node", "comp", "grams")

    def laid(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """n-grams, told apart by family and sorted in each set, and the sets' sizes; in the order of the rows."""
        family = mix(table["family"].to_numpy().view(U64))
        grams = [np.sort(mix(B.unpack_sorted(g) ^ f)) for g, f in zip(table["grams"].to_pylist(), family, strict=True)]
        return np.concatenate(grams) if grams else np.zeros(0, U64), np.array([len(g) for g in grams], np.int64)

    def send(table: pa.Table, back: pa.Table) -> pa.Table:
        names = ["bucket", "sigs", "of", "nodes", "comps", "loads", "owns"]
        kinds = [pa.int32(), *[pa.binary()] * 6]
        rows = []
        if len(table):
            h, count = laid(table)
            values, place = np.unique(h, return_inverse=True)
            sig, of = signatures(h, count, percent, sub=2, spare=1.0, rarity=B.block_counts(values, back)[place])
            node = table["node"].to_numpy()
            own = (node.view(U64) >> U64(40)).astype(np.int64) % -(-table["members"].to_numpy() // unit)
            rows = _slices(sig, of, lay.buckets, [node, table["comp"].to_numpy(), 1 + count // WEIGHT, own])
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def meet(table: pa.Table) -> pa.Table:
        size, (node, comp, load, own) = _met(table, ["nodes", "comps", "loads", "owns"])
        group = np.repeat(np.arange(len(size)), size)
        start = np.cumsum(size) - size
        if len(size):
            mixed = np.maximum.reduceat(comp, start) != np.minimum.reduceat(comp, start)
            keep = mixed[group]
            node, comp, load, own, size = node[keep], comp[keep], load[keep], own[keep], size[mixed]
            group = np.repeat(np.arange(len(size)), size)
        root = roots(node, size)
        # per group and chunk: its components, as far as needed to tell whether a node finds another's there
        order = np.lexsort((comp, own, group))
        g2, o2, c2 = group[order], own[order], comp[order]
        head = np.flatnonzero(np.append(True, (g2[1:] != g2[:-1]) | (o2[1:] != o2[:-1]))) if len(g2) else np.zeros(0, np.int64)
        cell_group, cell_own = g2[head], o2[head]
        low, high = (c2[head], c2[np.append(head[1:], len(c2)) - 1]) if len(g2) else (c2, c2)
        per = np.bincount(cell_group, minlength=int(group.max()) + 1 if len(group) else 0)
        n = per[group]
        member = np.repeat(np.arange(len(node)), n)
        cell = expand((np.cumsum(per) - per)[group], n)
        other = (low[cell] != comp[member]) | (high[cell] != comp[member])
        pairs = np.stack((node[member[other]], cell_own[cell[other]]), axis=1)
        pairs = np.unique(pairs, axis=0)
        names, first = np.unique(node, return_index=True)
        cut = np.searchsorted(pairs[:, 0], names)
        mates = [x.tolist() for x in np.split(pairs[:, 1], cut[1:])] if len(names) else []
        return pa.table({"node": names, "root": root[first], "comp": comp[first], "load": load[first], "own": own[first], "mates": pa.array(mates, pa.list_(pa.int64()))})

    counts = B.corpus_counts(blocks, lay, lambda t: laid(t)[0])
    sent = blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(send, "bucket int, sigs binary, of binary, nodes binary, comps binary, loads binary, owns binary")
    return sent.groupBy("bucket").applyInArrow(meet, "node long, root long, comp long, load long, own long, mates array<long>")


def _joined(units: DataFrame, sets: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links between components of the nodes (keys, node, comp) that meet under the same keys."""

    def join(table: pa.Table) -> pa.Table:
        pairs = unit_links(table["node"].to_numpy(), table["comp"].to_numpy(), [B.unpack_sorted(x) for x in table["grams"].to_pylist()], percent)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return units.join(sets.select("node", "grams"), "node").groupBy(*keys).applyInArrow(join, "a long, b long")


def units(met: DataFrame, comps: DataFrame) -> DataFrame:
    """(part, u, v, node, comp): which nodes meet in which task, for the nodes of :func:`_signed_again` and their new families (node, comp).

    A family of a load of up to UNIT meets as one; of a larger one the chunks u and v meet, each with those nodes only
    that share a signature with another component's in the other.
    """
    one = met.groupBy("node").agg(*[F.first(c).alias(c) for c in ("comp", "load", "own")], F.array_distinct(F.flatten(F.collect_list("mates"))).alias("mates"))
    placed = one.join(comps.select("node", F.col("comp").alias("part")), "node")
    size = placed.groupBy("part").agg(F.sum("load").alias("n"))
    pairs = F.expr(f"CASE WHEN n <= {UNIT} THEN array(struct(0L AS u, 0L AS v)) ELSE transform(mates, m -> struct(least(m, own) AS u, greatest(m, own) AS v)) END")
    return placed.join(size, "part").select("part", F.explode(pairs).alias("pair"), "node", "comp").select("part", "pair.u", "pair.v", "node", "comp")


def _large(sets: DataFrame, percent: int, nothing: DataFrame) -> DataFrame:
    """(node, comp) of large families."""
    edges = stored(_linked(sets, percent), "links")
    comps = _contract(edges)
    comps = nothing if comps is None else comps
    labelled = sets.select("family", "members", "node", "grams").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    met = stored(_signed_again(labelled, percent), "met")
    parts = _contract(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    if parts is None:
        return comps
    found = stored(_joined(units(met, parts), sets, ["part", "u", "v"], percent), "links")
    removed(met, parts)
    return comps if found.isEmpty() else _contract(edges.union(found))


def looked_up(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """All rows with the columns of table, which has a row for each key and in ``size`` how many rows have it.

    Keys of a thousandth of these rows or more, so at most HOT, are broadcast; rows with a null key move nowhere; the
    rest meet by the key. So no task gets all rows of a frequent one.
    """
    more = [c for c in table.columns if c not in (key, size)]
    total = table.agg(F.sum(size)).first()[0] or 0
    often = F.col(size) * HOT >= total
    hot = F.broadcast(table.where(often).select(key, *more))
    keyed = rows.where(F.col(key).isNotNull()).drop(size)
    rest = keyed.join(F.broadcast(table.where(often).select(key)), key, "left_anti").join(table.where(~often).select(key, *more), key, "left")
    without = rows.where(F.col(key).isNull()).drop(size).withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in more})
    return keyed.join(hot, key).unionByName(rest).unionByName(without)


def components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach)."""
    return memberships(docs, n, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def memberships(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, component_id, and component, which names a component even where ids are not
    unique; it is null for a document with an empty set."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            _, count, names = block_sets(b, n)
            ids, keys = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (b.doc_id, b.carried["text_key"]))
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(count, pa.int64()), pa.array(names.view(np.int64), mask=count == 0)], ["doc_id", "text_key", "n_shingles", "node"])

    rows = stored(d.mapInArrow(name, f"doc_id {dict(d.dtypes)['doc_id']}, text_key long, n_shingles long, node long"), "rows")
    d = d.drop("text_key")
    groups = stored(_groups(d, B.layout(d), n, percent), "groups")
    nothing = docs.sparkSession.createDataFrame([], "node long, comp long")
    families = _contract(groups.select(F.col("node").alias("a"), F.col("root").alias("b")))
    comps = sets = None
    if families is not None:
        named = families.select("node", F.col("comp").alias("family"))
        size = named.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
        best = groups.groupBy("node").agg(F.max_by("leader", F.struct(F.col("leader") != F.col("node"), "sigs", -F.col("leader"))).alias("leader"))
        wanted = named.join(size, "family").join(best, "node").select("node", "family", "members", "leader")
        sets = stored(_sets(d, wanted, n), "sets")
        small, large = sets.where(f"members <= {UNIT}"), sets.where(f"members > {UNIT}")
        # few members, but long ones
        load = F.sum(F.expr(f"1 + size div {WEIGHT}"))
        heavy = stored(small.groupBy("family").agg(load.alias("load")).where(f"load > {UNIT}"), "heavy")
        if not heavy.isEmpty():
            large = large.unionByName(small.drop("members").join(heavy.withColumnRenamed("load", "members"), "family").select(*large.columns))
            small = small.join(heavy, "family", "left_anti")
        comps = _solved(small, percent)
        if not large.isEmpty():
            comps = comps.union(_large(large, percent, nothing))
    # a row per node first: a document that occurs a million times is one row of each task
    least = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    placed = stored(least.join(nothing if comps is None else comps, "node", "left").select("node", "least", "copies", F.coalesce("comp", "node").alias("comp")), "placed")
    removed(groups, families, sets)
    first = stored(placed.groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1"), "first")
    named = stored(looked_up(placed, first, "comp", "nodes").select("node", "comp", F.coalesce("component_id", "least").alias("component_id"), "copies"), "named")
    removed(placed, first)
    found = looked_up(rows, named, "node", "copies")
    name = F.expr("CASE WHEN node IS NULL THEN doc_id ELSE component_id END").alias("component_id")
    return found.select("doc_id", "text_key", "n_shingles", name, F.col("comp").alias("component"))
