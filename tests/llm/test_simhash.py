import random

import numpy as np
import pytest
import xxhash

from spanveil.llm import simhash
from spanveil.llm.components import components, forest
from spanveil.llm.simhash import allotted, fingerprint, linked, near_duplicates


def brute_fingerprint(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    own = [w for w in low.split(" ") if w]
    if not own:
        return 0
    hashes = [xxhash.xxh64(" ".join(own[i : i + words]).encode(), 42).intdigest() for i in range(max(1, len(own) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=4):
    """fps: (id, fp); the smallest id reachable, by id's position."""
    left, out = set(range(len(fps))), {}
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            i = todo.pop()
            near = [j for j in left if bin(fps[i][1] ^ fps[j][1]).count("1") <= distance]
            left -= {*near}
            todo += near
            group += near
        least = min((fps[i][0] for i in group if fps[i][0] is not None), default=None)
        out |= dict.fromkeys(group, least)
    return [out[i] for i in range(len(fps))]


def check(rows, got, distance=4):
    fps = [(a, brute_fingerprint(b)) for a, b in rows]
    want = sorted(((a, f"{fp:016x}", c) for (a, fp), c in zip(fps, brute_components(fps, distance), strict=True)), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], near_duplicates(docs).collect())


@pytest.mark.parametrize("block", [20_000, 3])
def test_edge_cases_and_near_copies(spark, block):
    r = random.Random(2)
    vocabulary = [f"w{i}é" for i in range(300)]
    base = [r.choice(vocabulary) for _ in range(150)]
    rows = [(0, None), (1, ""), (2, " \t\x0b\n"), (3, "One"), (4, "oNE"), (5, "ONÉ"), (6, "a b c"), (7, "a  b\tc"), (None, "a b c"), (None, "only here"), (8, "x " * 70_000), (9, "a\x85b c d e"), (6, "a b c")]
    for i in range(10, 150):
        copy = list(base)
        for _ in range(i % 4):
            copy[r.randrange(150)] = r.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame([(a, b, 1, "clash") for a, b in rows], "doc_id long, text string, component_id int, fp string")
    check(rows, near_duplicates(docs, block=block).collect())


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def planted(r, n):
    fps = [r.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        fp = r.choice(fps)
        for b in r.sample(range(64), r.randint(1, 6)):
            fp ^= 1 << b
        fps.append(fp)
    return np.unique(np.array(fps, np.uint64))


@pytest.mark.parametrize("distance,corpus", [(4, 1_000), (4, 10**7), (4, 10**9), (6, 10**6), (1, 100)])
def test_no_link_is_lost_for_any_allotment(spark, distance, corpus):
    r = random.Random(distance)
    fps = planted(r, 300)
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    parts = allotted(bits.T @ bits * (corpus / len(fps)), corpus, distance)
    assert sorted(b for p in parts for b in p.bits) == list(range(64))
    assert sum(p.radius for p in parts) == distance - len(parts) + 1
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    rows = simhash.probes(frame, parts).repartition("key").sortWithinPartitions("key", simhash.F.col("own").desc())
    a, b = zip(*((np.uint64(x.a % 2**64), np.uint64(x.b % 2**64)) for x in simhash.verified_links(rows, distance, 50).collect()), strict=True)
    node, root = forest(np.array(a, np.uint64), np.array(b, np.uint64))
    root = dict(zip(node.tolist(), root.tolist(), strict=True))
    got = [root.get(x, x) for x in fps.tolist()]
    assert got == brute_components([(x, x) for x in fps.tolist()], distance)


def test_linked_and_forest_hold_together_the_same():
    fps = planted(random.Random(9), 400)
    node, root = forest(*linked(fps, 4))
    root = dict(zip(node.tolist(), root.tolist(), strict=True))
    assert [root.get(x, x) for x in fps.tolist()] == brute_components([(x, x) for x in fps.tolist()])


def test_forest_holds_together_what_links_do():
    for seed in range(300):
        r = random.Random(seed)
        n = r.randint(2, 60)
        links = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(1, 2 * n))]
        root = [*range(n)]
        for _ in range(n):
            for x, y in links:
                root[x] = root[y] = min(root[x], root[y])
        a, b = (np.array(x, np.int64) for x in zip(*links, strict=True))
        node, top = forest(a, b)
        assert dict(zip(node.tolist(), top.tolist(), strict=True)) == {x: root[x] for link in links for x in link if root[x] != x}


@pytest.mark.parametrize("few", [1000, 0])
def test_components_of_a_chain_a_star_and_nulls(spark, few):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(500)] + [(5, 5), (None, 3), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), few=few).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 500)}


def test_fingerprint_takes_half_for_zero():
    two = [xxhash.xxh64_intdigest(x, 42) for x in (b"a b c d", b"b c d e")]
    assert fingerprint(b"a b C d e") == two[0] & two[1]


def test_sums_by_bit():
    r = np.random.default_rng(1)
    for rows, columns in ((0, 1), (1, 1), (5, 18), (2100, 1), (5000, 1), (700, 18)):
        hashes = r.integers(0, 2**63, (rows, columns), np.uint64)
        want = [sum(int(x) >> b & 1 for x in hashes[:, c]) for c in range(columns) for b in range(64)]
        assert simhash.sums_by_bit(hashes).tolist() == want
