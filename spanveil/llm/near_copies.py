"""Near copies by the similarity of their word shingles: long SimHash fingerprints find candidates, whole texts decide.

What simhash.py does for a fixed number of differing bits, this does for a Jaccard
similarity: bits that go together are parts, dynamic programming gives each part the
radius at which it is probed from estimated candidate counts, candidates are verified.
Two texts at the least similarity differ in so many bits that no set of radii is sure to
find all of them at a bearable cost, so radii are chosen for a stated chance of a miss.
"""

from __future__ import annotations

from itertools import chain, combinations
from math import acos, ceil, comb, log, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.base import FEW, cut, free, joined, named, whole, without
from spanveil.llm.components import components
from spanveil.llm.simhash import BITS, Part, candidates, grouped_bits, in_blocks, sums_by_bit

#: 64-bit words of a fingerprint: those whose parts are probed, and those that go with each probe to verify it.
PROBED, CARRIED = 16, 2
#: Chance that no part finds a pair at the least similarity, if its bits differ independently.
MISS = 1e-3
#: Cost of looking at a candidate, as a share of that of a probe.
LOOK = 0.01
#: A bucket with more candidates than so many for each text is crowded: of its pairs, only a tree is listed.
MANY = 3
#: Smaller buckets are never crowded.
SMALL = 32
#: Texts of a crowd that one task compares with each other, and their bytes.
TILE, TILE_BYTES = 4_000, 8_000_000
#: Pairs of one text that a task compares.
PER_PART = 500
_GOLDEN, _MIX1, _MIX2, _STEP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x100000001B3))


def mixed_up(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * _MIX1
    h = (h ^ h >> np.uint64(27)) * _MIX2
    return h ^ h >> np.uint64(31)


class WordHashes(dict):
    """Hashes of words, kept while there is room."""

    def __init__(self, room: int = 200_000):
        super().__init__()
        self.room = room

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 42)
        if len(self) < self.room:
            self[word] = h
        return h


def shingles(text: bytes, words: int, known: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of so many lower-cased words; of all words of a shorter text."""
    own = text.lower().split()
    one = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
    n, width = max(1, len(own) - words + 1), min(words, len(own))
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = mixed_up(h * _STEP + one[k : k + n])
    return np.unique(h)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketch(own: np.ndarray) -> bytes:
    """The fingerprint: bits that are set in over half of the hashes derived from the shingles, little-endian."""
    counts, steps = np.zeros((PROBED + CARRIED) * BITS, np.int64), np.arange(1, PROBED + CARRIED + 1, dtype=np.uint64) * _GOLDEN
    for at in range(0, len(own), 8192):
        counts += sums_by_bit(mixed_up(own[at : at + 8192, None] + steps))
    return np.packbits(2 * counts > len(own), bitorder="little").tobytes()


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest of the text, sketch, bytes of the text for each row."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            text = batch.column(2).cast(pa.binary())
            made = [sketch(shingles(x.as_py(), words, known)) for x in text]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary()), pc.binary_length(text).cast(pa.int64())], ["doc_id", "digest", "sketch", "size"])

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(whole(text_col), 256)).alias("digest"), whole(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest binary, sketch binary, size long")


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """Within each probed word, how many fingerprints have each two bits set: PROBED tables of 64 x 64, whatever the corpus."""

    def tables(batches):
        total = np.zeros((PROBED, BITS, BITS), np.int64)
        for batch in batches:
            every = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for at in range(0, len(every), 4096):
                bits = np.unpackbits(every[at : at + 4096, : PROBED * 8], axis=1, bitorder="little").astype(np.float32).reshape(-1, PROBED, BITS).transpose(1, 0, 2)
                total += (bits.transpose(0, 2, 1) @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(PROBED), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], ["word", "counts"])

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for word, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[word] = total.get(word, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["word", "counts"])

    out = np.zeros((PROBED, BITS, BITS), np.int64)
    for r in nodes.select("sketch").mapInArrow(tables, "word int, counts binary").repartition("word").mapInArrow(summed, "word int, counts binary").collect():
        out[r.word] = np.frombuffer(bytes(r.counts), np.int64).reshape(BITS, BITS)
    return out


def differing(least: float) -> float:
    """The share of bits in which two sets of that similarity differ: the angle between them over that of a half turn."""
    return acos(min(1.0, 2 * least / (1 + least))) / pi


def allotted(together: np.ndarray, n: int, least: float, miss: float = MISS) -> list[list[Part]]:
    """Parts of each probed word and their radii, at least cost for that chance of a miss.

    For each number of parts in a word, dynamic programming over all parts chooses radius
    -1 (not probed), 0 or 1 for each. A radius costs its probes and the candidates it is
    estimated to bring; what it gains is the log of the chance that the part misses a pair.
    """
    share, best = differing(least), (float("inf"), float("inf"), [])
    for k in (2, 3, 4, 5, 6, 8):
        groups = [(word, bits) for word in range(PROBED) for bits in grouped_bits(together[word], n, k)]
        need = ceil(-log(miss) * 50)
        state: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for word, bits in groups:
            near = candidates(bits, together[word], n, 1)
            hit = [sum(comb(len(bits), d) * share**d * (1 - share) ** (len(bits) - d) for d in range(e + 1)) for e in (0, 1)]
            options = [(-1, 0, 0.0)] + [(e, int(-log(max(1e-9, 1 - hit[e])) * 50), 1 + e * len(bits) + LOOK * near[e]) for e in (0, 1)]
            then: dict[int, tuple[float, tuple]] = {}
            for gain, (cost, radii) in state.items():
                for e, more, price in options:
                    at, option = min(need, gain + more), (cost + price, (radii, e))
                    if at not in then or option[0] < then[at][0]:
                        then[at] = option
            state = then
        gain = max(state)
        cost, radii = state[gain]
        if (need - gain, cost) < best[:2]:
            chosen: list[list[Part]] = [[] for _ in range(PROBED)]
            for word, bits in reversed(groups):
                radii, e = radii
                chosen[word].append(Part(bits, e))
            best = (need - gain, cost, chosen)
    return best[2]


def probes(nodes: DataFrame, parts: list[list[Part]]) -> DataFrame:
    """key, node, m0, m1, own: a row for each part's own bucket and for those within its radius."""
    masks = []
    for word, own in enumerate(parts):
        for part in own:
            if part.radius >= 0:
                flips = [sum(1 << b for b in x) for k in range(part.radius + 1) for x in combinations(part.bits, k)]
                masks.append((word, np.uint64(sum(1 << b for b in part.bits)), np.array(flips, np.uint64)))

    names = np.arange(1, len(masks) + 1, dtype=np.uint64) * _GOLDEN

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            every = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(batch.num_rows, -1)
            for i, (word, mask, flips) in enumerate(masks):
                key = mixed_up(((every[:, word] & mask)[:, None] ^ flips) + names[i])
                own = np.zeros(key.shape, np.bool_)
                own[:, 0] = True
                rows = [np.repeat(x, len(flips)) for x in (node, every[:, PROBED].view(np.int64), every[:, PROBED + 1].view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *map(pa.array, rows), pa.array(own.ravel())], ["key", "node", "m0", "m1", "own"])

    return nodes.select("node", "sketch").mapInArrow(run, "key long, node long, m0 long, m1 long, own boolean")


def apart(m: np.ndarray, x, y) -> np.ndarray:
    """Differing bits of the carried words."""
    return np.bitwise_count(m[x] ^ m[y]).sum(-1, dtype=np.int64)


def tree(m: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within `near` bits over each set of rows that hang together, those of few differing bits first.

    Sets for fewer bits lie within those for more, so a larger number adds links between sets only.
    """
    label, a, b = np.arange(len(m)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for most in (near // 3, near // 2, 3 * near // 4, near):
        left, now, n = np.arange(len(m)), np.zeros(len(m), np.int64), 0
        while len(left):
            todo, left, n = [left[0]], left[1:], n + 1
            now[todo[0]] = n
            while todo and len(left):
                one = todo.pop()
                hit = apart(m, left, one) <= most
                found, left = left[hit], left[~hit]
                now[found] = n
                todo += found.tolist()
                found = found[label[found] != label[one]]
                a.append(np.full(len(found), one))
                b.append(found)
        label = now
    return np.concatenate(a), np.concatenate(b)


def bucket_pairs(node: np.ndarray, m: np.ndarray, own: np.ndarray, near: int, many: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of nodes of one bucket within `near` bits, and whether they are a tree of these only.

    All pairs with an owner, if they are at most `many` for each row; else a tree.
    """
    first, a, b, n = np.flatnonzero(own), [], [], 0
    for at in range(0, len(first), 256):
        some = first[at : at + 256]
        x, y = np.nonzero(apart(m, some[:, None], np.arange(len(m))[None, :]) <= near)
        x = some[x]
        ok = (node[x] != node[y]) & (~own[y] | (x < y))
        a.append(x[ok])
        b.append(y[ok])
        n += int(ok.sum())
        if n > many * len(m):
            x, y = tree(m, near)
            ok = node[x] != node[y]
            return node[x[ok]], node[y[ok]], True
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    return node[a], node[b], False


def pairs_in_buckets(rows: DataFrame, near: int, many: int, block: int) -> DataFrame:
    """a < b, crowd: pairs to compare, or (crowd) a tree of those of a bucket that has too many.

    rows: key, node, m0, m1, own, whose buckets lie together, what they own first.
    """

    def run(batches):
        held = None
        for batch in chain(batches, [None]):
            new = None if batch is None else [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cols = new if held is None else held if new is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if cols is None or not len(cols[0]):
                continue
            starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            ends = np.r_[starts[1:], len(cols[0])]
            done = len(starts) if new is None else len(starts) - 1
            a, b, crowd = told(cols, starts[:done], ends[:done])
            if new is not None:
                held = [x[starts[-1] :] for x in cols]
                if len(held[0]) > 3 * block:  # what the bucket owns came first and stays
                    x, y, z = told(held, np.array([0]), np.array([len(held[0])]))
                    a, b, crowd = np.r_[a, x], np.r_[b, y], np.r_[crowd, z]
                    held = [x[held[4]] for x in held]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(crowd)], ["a", "b", "crowd"])

    def told(cols, starts, ends):
        key, node, m0, m1, own = cols
        m, sizes = np.stack([m0, m1], 1).view(np.uint64), ends - starts
        a, b, crowd = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.bool_)]
        big = sizes > SMALL
        for x, y in zip(starts[big], ends[big], strict=True):
            p, q, is_tree = bucket_pairs(node[x:y], m[x:y], own[x:y], near, many)
            a, b, crowd = [*a, np.minimum(p, q)], [*b, np.maximum(p, q)], [*crowd, np.full(len(p), is_tree)]
        # small ones together: each row with those after it in its bucket
        for size in np.unique(sizes[(sizes > 1) & ~big]):
            left, right = np.triu_indices(size, 1)
            every = starts[sizes == size]
            for at in range(0, len(every), max(1, 2_000_000 // len(left))):
                some = every[at : at + max(1, 2_000_000 // len(left)), None]
                x, y = (some + left).ravel(), (some + right).ravel()
                ok = (own[x] | own[y]) & (node[x] != node[y])
                x, y = x[ok], y[ok]
                ok = apart(m, x, y) <= near
                x, y = x[ok], y[ok]
                a, b, crowd = [*a, np.minimum(node[x], node[y])], [*b, np.maximum(node[x], node[y])], [*crowd, np.zeros(len(x), np.bool_)]
        return np.concatenate(a), np.concatenate(b), np.concatenate(crowd)

    return rows.select("key", "node", "m0", "m1", "own").mapInArrow(run, "a long, b long, crowd boolean")


def likely(share: float) -> int:
    """So many bits of whole fingerprints are likely to differ at most, if that share does."""
    bits = (PROBED + CARRIED) * BITS
    return ceil(bits * share + 4 * (bits * share * (1 - share)) ** 0.5)


def screened(pairs: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """The pairs whose whole fingerprints differ in no more bits than is likely for that share."""
    most = likely(share)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u8").reshape(-1, PROBED + CARRIED) for i in (2, 3))
            ok = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(ok)).columns[:2], ["a", "b"])

    a, b = (nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def similar_pairs(texts: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose whole texts (node, text) have that similarity; pairs of one text are dealt to several tasks if they are many."""
    often = cut(pairs.groupBy("a").count().where(F.col("count") > PER_PART))
    often = F.broadcast(often) if often.count() <= FEW else often
    parts = F.coalesce(F.ceil(F.col("count") / PER_PART), F.lit(1)).cast("int")
    dealt = lambda part: F.xxhash64("a", part).alias("to")
    firsts = pairs.select("a").distinct().join(often, "a", "left").select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    firsts = firsts.join(texts, firsts.a == texts.node).select(dealt(F.col("part")), "a", F.lit(None).cast("long").alias("b"), "text")
    others = pairs.join(often, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    others = others.join(texts, others.b == texts.node).select(dealt(F.col("part")), "a", "b", "text")

    def run(batches):
        of, own, known = None, np.zeros(0, np.uint64), WordHashes()
        for batch in batches:
            a, b = [], []
            for x, y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.binary()), strict=True):
                if y is None:
                    of, own = x, shingles(text.as_py(), words, known)
                elif x == of and similarity(own, shingles(text.as_py(), words, known)) >= least:
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return firsts.union(others).repartition("to").sortWithinPartitions("to", "a", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


class Held:
    """The texts of a tile that others are compared with, and what hangs together so far."""

    def __init__(self):
        self.n, self.node, self.own, self.into = 0, [], [], {}
        self.m, self.label, self.size = np.zeros((64, PROBED + CARRIED), np.uint64), np.zeros(64, np.int64), np.zeros(64, np.int64)

    def root(self, label: int) -> int:
        while label in self.into:
            label = self.into[label]
        return label

    def add(self, node: int, label: int, m: np.ndarray, own: np.ndarray) -> None:
        if self.n == len(self.m):
            self.m, self.label, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.m, self.label, self.size))
        self.m[self.n], self.label[self.n], self.size[self.n] = m, self.root(label), len(own)
        self.node.append(node)
        self.own.append(own)
        self.n += 1

    def linked(self, label: int, m: np.ndarray, own: np.ndarray, most: int, least: float) -> list[int]:
        """Nodes that link this text to all that it is similar to, the nearest fingerprints first."""
        n, label, out, step = self.n, self.root(label), [], 8
        gap, size, labels = np.bitwise_count(self.m[:n] ^ m).sum(1, dtype=np.int64), self.size[:n], self.label[:n]
        left = np.flatnonzero((gap <= most) & (labels != label) & (np.minimum(size, len(own)) / np.maximum(size, len(own)) >= least))
        left = left[np.argsort(gap[left], kind="stable")]
        while len(left):
            some, left, step = left[:step], left[step:], min(2 * step, 512)
            every = np.concatenate([self.own[j] for j in some])
            hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            both = np.add.reduceat(hit, np.r_[0, np.cumsum(size[some])[:-1]], dtype=np.int64)
            for j in some[both / (len(own) + size[some] - both) >= least].tolist():
                if (other := int(labels[j])) != label:
                    out.append(self.node[j])
                    labels[labels == other] = label
                    self.into[other] = label
            left = left[labels[left] != label]
        return out


def tile_links(rows: DataFrame, words: int, least: float, most: int) -> DataFrame:
    """a, b: links between similar texts of each tile that hold together what all of its similar pairs do.

    rows: tile, side, node, label, sketch, text. Texts of side 0 are held, those of side 1
    compared with them, those of side 2 both; two of one label are not compared. No more
    than one link for each text that is not yet linked leaves a tile.
    """

    def run(batches):
        at, held, known = None, Held(), WordHashes()
        for batch in batches:
            a, b = [], []
            for tile, side, node, label, m, text in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5).cast(pa.binary()), strict=True):
                if tile != at:
                    at, held = tile, Held()
                m, own = np.frombuffer(m, "<u8"), shingles(text.as_py(), words, known)
                if side:
                    found = held.linked(label, m, own, most, least)
                    a += [node] * len(found)
                    b += found
                if side != 1:
                    held.add(node, label, m, own)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = rows.select("tile", "side", "node", "label", "sketch", "text").repartition("tile").sortWithinPartitions("tile", "side", "node")
    return rows.mapInArrow(run, "a long, b long")


def with_roots(roots: DataFrame) -> DataFrame:
    """node, root of components, the roots themselves too."""
    return roots.union(roots.select("root", "root")).distinct()


def in_parts(rows: DataFrame, by: str, tile: int, name: str) -> DataFrame:
    """rows with how many parts (`name`) its rows of one `by` are dealt to: each of about `tile` texts and TILE_BYTES at most."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("size") / TILE_BYTES)).cast("int")
    return joined(rows, cut(rows.groupBy(by).agg(parts.alias(name), F.count(F.lit(1)).alias("n"))), by)


def labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the label of what they hang together with so far."""
    every = roots.withColumnRenamed("root", "label")
    return rows.join(F.broadcast(every) if every.count() <= FEW else every, "node", "left").withColumn("label", F.coalesce("label", "node"))


def crossed(members: DataFrame, roots: DataFrame, tile: int) -> DataFrame:
    """tile, side, node, label, sketch, digest: the tiles in which texts of different parts of a crowd meet.

    members: node, crowd, parts, size, sketch, digest of crowds of several parts. Of the
    label that most texts of a crowd have, no two are compared: all other texts are held,
    in parts of their own, and each of these meets every text of the crowd.
    """
    rows = cut(labelled(members, roots))
    most = rows.groupBy("crowd", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("crowd").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
    rows = cut(joined(rows, cut(most.select("crowd", F.col("top.label").alias("common"), "n")), "crowd"))
    others = cut(in_parts(rows.where("label != common"), "crowd", tile, "held_parts"))
    told = cut(others.groupBy("crowd").agg(F.first("held_parts").alias("held_parts"), F.lit(1).cast("long").alias("n")))
    told = told.join(rows.groupBy("crowd").agg(F.count(F.lit(1)).alias("rows")), "crowd").select("crowd", "held_parts", F.col("rows").alias("n"))
    rows = joined(rows, cut(told), "crowd")
    part = lambda parts: F.pmod(F.xxhash64("node"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    held = others.withColumn("i", part(F.col("held_parts"))).withColumn("j", every("parts")).withColumn("side", F.lit(0))
    met = rows.withColumn("j", part(F.col("parts"))).withColumn("i", every("held_parts")).withColumn("side", F.lit(1))
    columns = [F.xxhash64("crowd", "i", "j").alias("tile"), "side", "node", "label", "sketch", "digest"]
    return held.select(*columns).union(met.select(*columns))


def similar_nodes(docs: DataFrame, nodes: DataFrame, words: int, least: float, block: int, many: int, tile: int, text_col: str) -> DataFrame:
    """node, root of the nodes (digest, node, sketch, size) that are similar to another."""
    n, share = nodes.count(), differing(least)
    carried = CARRIED * BITS
    near = ceil(carried * share + 3.5 * (carried * share * (1 - share)) ** 0.5)
    rows = in_blocks(probes(nodes, allotted(bit_counts(nodes), n, least)), block, "node")
    found = cut(pairs_in_buckets(rows.repartition("key").sortWithinPartitions("key", F.col("own").desc(), "node"), near, many, block))
    few = lambda x: F.broadcast(x) if x.count() <= FEW else x

    # what crowded buckets hold meets in tiles, so pairs within a crowd need not be listed
    crowds = with_roots(cut(components(found.where("crowd").select("a", "b")))).withColumnRenamed("root", "crowd")
    members = cut(crowds.join(nodes.select("node", "digest", "sketch", "size"), "node"))
    members = cut(in_parts(members, "crowd", tile, "parts"))
    place = few(cut(members.select("node", F.col("crowd").alias("of"), "parts")))
    pairs = found.groupBy("a", "b").agg(F.max("crowd").alias("crowd")).join(place.withColumnRenamed("node", "a"), "a", "left")
    there = place.select(F.col("node").alias("b_node"), F.col("of").alias("b_of"))
    # but for the trees of those crowds that are dealt to several parts
    pairs = pairs.join(there, (F.col("b") == F.col("b_node")) & (F.col("of") == F.col("b_of")) & (~F.col("crowd") | (F.col("parts") == 1)), "left_anti")
    pairs = cut(screened(cut(pairs.select("a", "b")), nodes, share))

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(members.select("node")).distinct().join(nodes.select("node", "digest"), "node")
    texts = docs.select(F.unhex(F.sha2(whole(text_col), 256)).alias("digest"), whole(text_col).alias("text")).join(few(cut(asked)), "digest").select("node", "text")
    texts = cut(texts.dropDuplicates(["node"]))
    roots = cut(components(similar_pairs(texts, pairs, words, least)))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    within = labelled(members, roots).withColumn("tile", F.xxhash64("crowd", part)).withColumn("side", F.lit(2))
    # what hangs together so far is as many links as nodes
    roots = cut(components(tile_links(within.join(texts, "node"), words, least, likely(share)).union(roots)))
    dealt = members.where("parts > 1")
    if dealt.limit(1).count():
        across = crossed(dealt, roots, tile)
        roots = cut(components(tile_links(across.join(texts, "node"), words, least, likely(share)).union(roots)))
    return roots


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8, block: int = 20_000, many: int = MANY, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the text), component_id and component_digest of each document that is similar to another text.

    Two texts are similar if the sets of their shingles of `words` words have a Jaccard
    similarity of `least` or more; words are lower-cased in A-Z and cut at ASCII white
    space; a shorter text is one shingle, and texts without words are alike. component_id
    is the smallest id that links between similar texts lead to. Shingles are compared by
    64-bit hashes.

    Each distinct text gets a SimHash fingerprint of 18 words of 64 bits from its distinct
    shingles. Parts of the first 16 are probed (see `allotted`), the last two verify a probe
    where it meets others, then the whole fingerprint does, and whole texts decide. A pair at `least` is not met about once
    in a thousand times, one of greater similarity less often; fingerprints of texts with
    few shingles differ somewhat more. Of a bucket with many candidates, only a tree is
    listed. What such trees hold together is a crowd, whose texts lie together in tasks of
    `tile` texts each: all pairs that are not linked yet are compared there, and only links
    that are needed leave the task, so rows grow with texts and not with pairs. Parts of a
    crowd that does not fit in one task are compared with each other, but for what the
    crowd's largest group holds: no pair that meets is given up.

    Null texts are empty. Null ids take part; a component of null ids only has a null
    component_id. Ids and rows may repeat. An empty table gives an empty result.
    """
    rows = cut(sketches(docs, words, id_col, text_col))
    nodes = cut(rows.groupBy("digest").agg(F.first("sketch").alias("sketch"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()))
    roots = similar_nodes(docs, nodes, words, least, block, many, tile, text_col)
    roots = cut(with_roots(roots))
    linked = cut(nodes.select("digest", "n", "node").join(F.broadcast(roots) if roots.count() <= FEW else roots, "node").select("digest", "root", "n"))
    members = cut(joined(rows.select("doc_id", "digest"), linked, "digest"))
    firsts = members.groupBy("root").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest"))).alias("first"), F.count(F.lit(1)).alias("n"))
    return joined(members, cut(firsts), "root").select("doc_id", "digest", F.col("first.doc_id").alias("component_id"), F.col("first.digest").alias("component_digest"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each group of similar texts, that of the smallest id; documents without an id stay.

    A document is its id and its text: an id with several texts loses those that go only.
    """
    gone_id, gone_digest = free(docs.columns, "gone_id", "gone_digest")
    groups = similar_groups(docs, id_col=id_col, text_col=text_col, **how)
    gone = groups.where((F.col("doc_id") != F.col("component_id")) | (F.col("digest") != F.col("component_digest"))).where("doc_id IS NOT NULL")
    gone = cut(gone.select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest)).distinct())
    return without(docs, gone, (named(id_col) == F.col(gone_id)) & (F.unhex(F.sha2(whole(text_col), 256)) == F.col(gone_digest)))
