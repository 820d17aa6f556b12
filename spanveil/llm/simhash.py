"""SimHash fingerprints, and near copies by the generalised pigeonhole principle."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.base import FEW, cut, joined, named, whole
from spanveil.llm.components import components, forest

BITS = 64
#: Cost of verifying a candidate, as a share of that of a probe that is sent to its bucket.
VERIFY = 0.02


def fingerprint(text: bytes, words: int = 4) -> int:
    """Bits that are set in over half of the hashes of the text's word shingles."""
    own = text.lower().split()
    if not own:
        return 0
    n = max(1, len(own) - words + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(own[i : i + words]), 42) for i in range(at, min(n, at + 65536))], "<u8")
        counts += sums_by_bit(hashes[:, None])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in batch.column(1).cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(named(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def sums_by_bit(hashes: np.ndarray) -> np.ndarray:
    """For 64-bit hashes (rows, columns): in how many rows each bit is set.

    Added up in binary: three rows of one weight become one of that weight and one of
    twice that, until so few are left that their bits are added one by one.
    """
    counts, weight, level = np.zeros(hashes.shape[1] * BITS, np.int64), 1, hashes
    few = max(2, 2048 // hashes.shape[1])
    while len(level):
        carried = []
        while len(level) > few:
            k = len(level) // 3
            a, b, c, rest = level[:k], level[k : 2 * k], level[2 * k : 3 * k], level[3 * k :]
            odd = a ^ b
            carried.append(a & b | c & odd)
            level = np.concatenate([odd ^ c, rest])
        bits = np.unpackbits(np.ascontiguousarray(level, "<u8").view(np.uint8), axis=1, bitorder="little")
        counts += weight * bits.sum(0, dtype=np.int64)
        level, weight = np.concatenate(carried) if carried else level[:0], 2 * weight
    return counts


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have each two bits set; 64 x 64 numbers, whatever the corpus."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array((i * BITS + j).ravel()), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])

    out = np.zeros(BITS * BITS)
    for r in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(BITS, BITS)


@dataclass
class Part:
    """Bits that are looked at together, and how far a probe may be from what it finds; -1: not probed."""

    bits: list[int]
    radius: int


def grouped_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in groups; each group takes in the bit that goes most with those it has."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    alike = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(alike, 0)
    left, groups = np.arange(BITS), []
    for k in range(parts):
        own, with_own = [], alike[np.ix_(left, left)].sum(1)
        for _ in range(len(left) // (parts - k)):
            at = int(with_own.argmax())
            with_own = np.delete(with_own if own else np.zeros(len(left)), at)
            own.append(int(left[at]))
            left = np.delete(left, at)
            with_own = with_own + alike[left, own[-1]]
        groups.append(sorted(own))
    return groups


def candidates(bits: list[int], together: np.ndarray, n: int, most: int) -> list[float]:
    """Estimated number of fingerprints within each distance on these bits of one taken at random."""
    p = np.diag(together)[bits] / max(n, 1)
    at = np.zeros(most + 1)
    at[0] = 1
    for differs in 2 * p * (1 - p):
        at[1:] = at[1:] * (1 - differs) + at[:-1] * differs
        at[0] *= 1 - differs
    return list(n * np.cumsum(at))


def allotted(together: np.ndarray, n: int, distance: int) -> list[Part]:
    """Parts and their radii at least cost: the radii add up to distance - parts + 1.

    Fingerprints within the distance are then within the radius of one part at least.
    For each number of parts, dynamic programming over them divides the sum.
    """
    best: tuple[float, list[Part]] = (float("inf"), [])
    for parts in range(2, distance + 2):
        groups = grouped_bits(together, n, parts)
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            near = candidates(bits, together, n, distance)
            cost = [0.0] + [sum(comb(len(bits), k) for k in range(e + 1)) + VERIFY * near[e] for e in range(distance + 1)]
            then: dict[int, tuple[float, list[int]]] = {}
            for used, (so_far, radii) in state.items():
                for e in range(-1, distance - used + 1):
                    option = (so_far + cost[e + 1], [*radii, e])
                    if used + e + 1 not in then or option < then[used + e + 1]:
                        then[used + e + 1] = option
            state = then
        if distance + 1 in state and state[distance + 1][0] < best[0]:
            cost, radii = state[distance + 1]
            best = (cost, [Part(b, e) for b, e in zip(groups, radii, strict=True)])
    return best[1]


def probes(fps: DataFrame, parts: list[Part]) -> DataFrame:
    """key, fp, own: a row for each fingerprint's own bucket in each part, and one for each bucket near it."""
    masks = []
    for part in parts:
        if part.radius >= 0:
            mask = sum(1 << b for b in part.bits)
            flips = [sum(1 << b for b in x) for k in range(part.radius + 1) for x in combinations(part.bits, k)]
            masks.append((np.uint64(mask), np.array(flips, np.uint64)))

    def run(batches):
        odd, step = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            size = max(1, 500_000 // sum(len(flips) for _, flips in masks))
            for at in range(0, len(every), size):
                fp = every[at : at + size]
                for i, (mask, flips) in enumerate(masks):
                    with np.errstate(over="ignore"):
                        key = (((fp & mask)[:, None] ^ flips) + np.uint64(i) * step) * odd
                    own = np.zeros(key.shape, np.bool_)
                    own[:, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64)), pa.array(own.ravel())], ["key", "fp", "own"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, own boolean")


def linked(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree of links over each set of these fingerprints that hang together: each is taken up once."""
    left, a, b = fp, [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            near = np.bitwise_count(left ^ one) <= distance
            if near.any():
                found, left = left[near], left[~near]
                todo += list(found)
                a.append(np.full(len(found), one))
                b.append(found)
    none = np.zeros(0, fp.dtype)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def bucket_links(key: np.ndarray, fp: np.ndarray, own: np.ndarray, distance: int, small: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Links in buckets that lie together in full, sorted by key with a bucket's own rows first."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    owned = np.add.reduceat(own.astype(np.int64), starts)
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for i in np.flatnonzero((owned * sizes > small)):
        every = fp[starts[i] : starts[i] + sizes[i]]
        if owned[i] * sizes[i] <= 4_000_000:
            left, right = np.nonzero(np.bitwise_count(every[: owned[i], None] ^ every) <= distance)
            x, y = forest(every[left], every[right])
        else:
            x, y = linked(np.unique(every), distance)
        a.append(x)
        b.append(y)
    few = np.flatnonzero((owned > 0) & (sizes > 1) & (owned * sizes <= small))
    for at in range(0, len(few), 20_000):
        some = few[at : at + 20_000]
        rows = np.repeat(starts[some] - np.r_[0, np.cumsum(sizes[some])[:-1]], sizes[some]) + np.arange(sizes[some].sum())
        times = np.repeat(owned[some], sizes[some])
        left = np.repeat(rows, times)
        right = np.repeat(np.repeat(starts[some], sizes[some]) - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        ok = (np.bitwise_count(fp[left] ^ fp[right]) <= distance) & (left > right) & (fp[left] != fp[right])
        a.append(fp[left[ok]])
        b.append(fp[right[ok]])
    return np.concatenate(a), np.concatenate(b)


def verified_links(rows: DataFrame, distance: int, block: int) -> DataFrame:
    """a, b: links that hold together whatever these buckets link; no more than a tree for some 100,000s of rows."""

    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.bool_))
        links, n = [], 0

        def told():
            a, b = forest(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            new = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False))
            key, fp, own = (np.concatenate(x) for x in zip(held, new, strict=True))
            if not len(key):
                continue
            last = np.searchsorted(key, key[-1], "left")
            if last:
                links.append(bucket_links(key[:last], fp[:last], own[:last], distance))
            key, fp, own = key[last:], fp[last:], own[last:]
            if len(key) > 3 * block:  # a bucket with more probes than fit: what it owns came first and stays
                links.append(linked(np.unique(fp), distance))
                key, fp, own = key[own], fp[own], own[own]
            held = (key, fp, own)
            n = sum(len(x) for x, _ in links)
            if n > 300_000:
                yield told()
        if len(held[0]):
            links.append(bucket_links(*held, distance))
        if links:
            yield told()

    return rows.select("key", "fp", "own").mapInArrow(run, "a long, b long")


def in_blocks(rows: DataFrame, block: int, by: str = "fp") -> DataFrame:
    """The rows, those of buckets that own over `block` fingerprints dealt to several buckets.

    Each of these owns a share, and meets all fingerprints of the bucket, so no pair is lost.
    """
    large = cut(rows.where("own").groupBy("key").count().where(F.col("count") > block))
    if not large.limit(1).count():
        return rows
    held = F.broadcast(large) if large.count() <= FEW else large
    parts = F.ceil(F.col("count") / block).cast("int")
    share = F.pmod(F.xxhash64(by), parts)
    dealt = rows.join(held, "key", "left").withColumn("part", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), parts - 1))))
    dealt = dealt.withColumn("own", F.col("own") & (F.col("count").isNull() | (share == F.col("part"))))
    return dealt.withColumn("key", F.when(F.col("part") == 0, F.col("key")).otherwise(F.xxhash64("key", "part"))).select(*rows.columns)


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, block: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for each row of docs.

    Words are lower-cased in A-Z and cut at ASCII white space; shingles have `words`
    words, or all of a shorter text; a text without words has fingerprint zero and is
    linked like any other. Fingerprints link at `distance` or fewer differing bits, and
    component_id is the smallest id that links lead to.

    Each distinct fingerprint is looked at once, so exact copies cost nothing here. Bits
    that go together are put in parts; the radius at which each part is probed comes from
    the corpus's own bit counts (see `allotted`), and every candidate is verified. In a
    bucket, fingerprints that hang together give a tree of links and not all pairs; a
    bucket that owns more than `block` is dealt to several. Components come from links by
    rounds of joins, with nothing but counts on the driver. Fingerprints and components
    that many rows have are broadcast, the others joined.

    Null texts are empty. Null ids take part; a component of null ids only has a null
    component_id. Repeated rows give repeated rows. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, words, id_col, text_col))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    together = bit_counts(distinct)
    rows = probes(distinct, allotted(together, distinct.count(), distance))
    rows = in_blocks(rows, block).repartition("key").sortWithinPartitions("key", F.col("own").desc())
    roots = components(verified_links(rows, distance, block))
    known = cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    known = cut(joined(known.select("fp", F.col("n").alias("rows"), "root"), cut(smallest), "root"))
    out = joined(fps, known.select("fp", F.col("rows").alias("n"), "component_id"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
