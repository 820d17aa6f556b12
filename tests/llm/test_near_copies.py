import random

import numpy as np
import pytest

from spanveil.llm import near_copies
from spanveil.llm.components import forest
from spanveil.llm.near_copies import allotted, differing, similar_groups, tree, without_near_copies


def shingles(text, words):
    own = text.lower().split()
    return {b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def brute_groups(rows, least=0.8):
    """rows: (id, text); the sets of ids that similar texts link."""
    sets = [shingles((t or "").encode(), 5) for _, t in rows]
    left, out = set(range(len(rows))), []
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            i = todo.pop()
            near = [j for j in left if similarity(sets[i], sets[j]) >= least]
            left -= {*near}
            todo += near
            group += near
        out.append(sorted(rows[i][0] for i in group))
    return out


def copies_at(r, least, most, words=400):
    """A text and a copy of it whose similarity lies between the two."""
    while True:
        base = [f"w{r.randrange(10**6)}" for _ in range(words)]
        copy = list(base)
        for _ in range(r.randint(1, 12)):
            copy[r.randrange(words)] = f"v{r.randrange(10**6)}"
        if least <= similarity(*(shingles(" ".join(x).encode(), 5) for x in (base, copy))) < most:
            return " ".join(base), " ".join(copy)


def test_planted_copies_from_080_to_095_go_and_less_similar_ones_stay(spark):
    r = random.Random(3)
    rows, far = [], []
    for low, high in [(0.80, 0.82), (0.82, 0.85), (0.85, 0.9), (0.9, 0.95)]:
        for _ in range(15):
            rows += [(len(rows) + i, t) for i, t in enumerate(copies_at(r, low, high))]
    for _ in range(15):
        far += [(len(rows) + len(far) + i, t) for i, t in enumerate(copies_at(r, 0.74, 0.8))]
    kept = {x.doc_id for x in without_near_copies(spark.createDataFrame(rows + far, "doc_id long, text string")).collect()}
    assert kept == {*range(0, len(rows), 2), *(i for i, _ in far)}


@pytest.mark.parametrize(("block", "many"), [(20_000, 3), (20, 3), (20_000, 0)])
def test_large_groups_chains_and_edge_cases(spark, block, many):
    r = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "oNE"), (5, "ONÉ"), (6, "a b c"), (7, "a  b\tc")]
    for i in range(8, 8 + 4 * 32):
        copy = list(base)
        copy[r.randrange(200)] = f"v{i}"
        rows.append((i, " ".join(copy)))
    for i in range(200, 240):  # each is similar to the next ones only
        rows.append((i, " ".join(f"c{k}" for k in range(i * 12, i * 12 + 200))))
    want = [g for g in brute_groups(rows) if len(g) > 1]
    got = similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block, many=many).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: g[0] for g in want for i in g}


def crowd_below(r, n, families):
    """Families of copies; texts of different families are below 0.8, most of them just so. None is from 0.77 to 0.85."""
    base, rows, sets = [f"w{k}" for k in range(200)], [], []
    firsts = [[(r.randrange(200), f"u{f}_{k}") for k in range(2)] for f in range(families)]
    while len(rows) < n:
        copy = list(base)
        for k, word in [*r.choice(firsts), (r.randrange(200), f"v{r.randrange(10**6)}")]:
            copy[k] = word
        own = shingles(" ".join(copy).encode(), 5)
        if not any(0.77 <= similarity(own, x) < 0.85 for x in sets):
            sets.append(own)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_rows_of_a_large_group_grow_with_its_texts_not_with_its_pairs(spark, monkeypatch):
    rows, listed, held = crowd_below(random.Random(9), 400, 60), [], near_copies.screened
    monkeypatch.setattr(near_copies, "screened", lambda pairs, *how: listed.append(pairs.count()) or held(pairs, *how))
    want = [g for g in brute_groups(rows) if len(g) > 1]
    got = similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: g[0] for g in want for i in g}
    assert len(want) > 10 and sum(listed) < 10 * len(rows), (len(want), listed)


@pytest.mark.parametrize("many", [3, 0])
def test_parts_of_a_crowd_meet_each_other(spark, many):
    rows = [*crowd_below(random.Random(10), 200, 30), (1_000, "One"), (1_001, "one")]
    want = [g for g in brute_groups(rows) if len(g) > 1]
    got = similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), many=many, tile=30).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: g[0] for g in want for i in g} and len(want) > 10


def test_an_id_with_two_texts_loses_only_the_copy(spark):
    r = random.Random(6)
    (a, b), (c, d), (e, f) = (copies_at(r, 0.85, 0.95) for _ in range(3))
    rows = [(1, a), (5, b), (5, c), (9, d), (3, e), (3, f), (None, b)]
    kept = [tuple(x) for x in without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 4 and {(1, a), (5, c), (None, b)} < {*kept} and len({(3, e), (3, f)} & {*kept}) == 1


def test_empty_table(spark):
    assert without_near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_radii_are_chosen_for_the_chance_of_a_miss():
    r = np.random.default_rng(1)
    together = np.zeros((16, 64, 64), np.int64)
    bits = r.random((16, 2000, 64)) < 0.5
    for w in range(16):
        together[w] = bits[w].astype(int).T @ bits[w].astype(int)
    probed = {}
    for n in (2_000, 2_000_000):
        parts = [p for own in allotted(together * (n // 2_000), n, 0.8) for p in own]
        assert sorted(b for p in parts for b in p.bits) == sorted([*range(64)] * 16)
        share, miss = differing(0.8), 1.0
        for p in parts:
            k = len(p.bits)
            miss *= 1 - {-1: 0, 0: (1 - share) ** k, 1: (1 - share) ** k + k * share * (1 - share) ** (k - 1)}[p.radius]
        assert miss <= 1.2e-3
        probed[n] = np.mean([len(p.bits) for p in parts])
    assert probed[2_000] < probed[2_000_000]


def test_fingerprints_differ_as_the_similarity_says():
    r, known, gaps = random.Random(8), near_copies.WordHashes(), []
    for _ in range(40):
        a, b = copies_at(r, 0.80, 0.81)
        x, y = (np.frombuffer(near_copies.sketch(near_copies.shingles(t.encode(), 5, known)), np.uint8) for t in (a, b))
        gaps.append(np.bitwise_count(x ^ y).sum() / (len(x) * 8))
    assert abs(np.mean(gaps) - differing(0.8)) < 0.01


def test_tree_spans_what_hangs_together():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, (4, 2), np.uint64)
    m = np.concatenate([b ^ (np.uint64(1) << r.integers(0, 63, (30, 2)).astype(np.uint64)) for b in base])
    a, b = tree(m, 10)
    nodes, roots = forest(a.astype(np.uint64), b.astype(np.uint64))
    assert {*zip(nodes.tolist(), roots.tolist(), strict=True)} == {(i, i // 30 * 30) for i in range(120) if i % 30} and len(a) < 4 * 4 * 30
