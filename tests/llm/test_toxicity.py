import random
import zlib

import numpy as np
import pytest

from spanveil.llm import toxicity as tox
from spanveil.llm.toxicity import toxicity


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    words = ["the", "of", "rain", "house", "green", "walk", "under", "light", "paper", "seven"]
    docs, labels = [], []
    for i in range(600):
        own = [r.choice(words) for _ in range(r.randint(5, 60))]
        if i % 4 == 0:
            own.insert(r.randrange(len(own)), r.choice(["idiotic", "moron", "Scumbag!"]))
        docs.append((i, " ".join(own), "x", 1.0))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(600, None, "x", None), (601, "", "x", 0.0), (None, "a moron", "x", 0.0), (602, "light " * 60_000 + "moron", "x", 0.0), (602, "again", "x", 0.0)]
    labels += [(None, 1, 1), (700, None, None), (3, 1, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, predicted double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_and_scores_each_row(tables):
    docs, labels = tables
    got = toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.97
    by = {(r.doc_id, round(r.score, 6)) for r in got}
    assert len({s for d, s in by if d in (600, 601)}) == 1
    assert any(r.doc_id == 602 and r.predicted == 1 for r in got)


def test_held_out_labels_change_nothing(spark, tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(tox.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda rows: sorted(((r.doc_id, r.score) for r in rows), key=str)
    assert key(toxicity(docs, labels).collect()) == key(toxicity(docs, turned).collect())


def test_without_labels_or_rows(spark, tables):
    docs, labels = tables
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity(docs.limit(0), labels).collect() == []


def test_grams_in_chunks_are_those_of_each_text(monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice("abc é!") for _ in range(r.randint(0, 90))) for _ in range(40)]
    whole = set(zip(*map(np.ndarray.tolist, tox.unique_grams(texts)), strict=True))
    each = {(i, p) for i, t in enumerate(texts) for p in tox.unique_grams([t])[1].tolist()}
    monkeypatch.setattr(tox, "_CHUNK", 17)
    assert whole == each == set(zip(*map(np.ndarray.tolist, tox.unique_grams(texts)), strict=True))


def plain_scores(learn, texts, orders=tox.ORDERS, rounds=200):
    """The classifier over n-grams as strings, with dense features. learn: (text, label)."""
    low = lambda t: "".join((c.lower() if c.isalpha() else " ") if ord(c) < 128 else c for c in t)
    own = lambda t: {(n, low("\n" * 6 + t + "\n" * 6)[i : i + n]) for n in orders for i in range(12 + len(t) - n + 1)}
    sets, y = [own(t) for t, _ in learn], np.array([x for _, x in learn])
    n1, n0 = y.sum(), (1 - y).sum()
    chosen = {}
    for g in set().union(*sets):
        p, q = sum(g in s for s, x in zip(sets, y, strict=True) if x), sum(g in s for s, x in zip(sets, y, strict=True) if not x)
        share, at = n1 / len(y), p / (p + q)
        stat = 2 * ((p * np.log(at / share) if p else 0) + (q * np.log((1 - at) / (1 - share)) if q else 0))
        if p + q >= 3 and stat > 24:
            chosen[g] = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
    names, r = [*chosen], np.array([*chosen.values()])
    x = np.array([[(g in s) * k for g, k in zip(names, r, strict=True)] for s in sets])
    c = np.where(y == 1, 1 / np.sqrt(n1), 1 / np.sqrt(n0))
    c, theta, m, v = c / c.sum(), np.zeros(len(r) + 1), 0, 0
    for k in range(1, rounds + 1):
        error = c * (1 / (1 + np.exp(-(x @ theta[:-1] + theta[-1]))) - y)
        g = np.append(x.T @ error + 1e-4 * theta[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.05 * (1 - 0.9 * k / rounds) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return [1 / (1 + np.exp(-sum(w * chosen[g] for g, w in zip(names, theta, strict=False) if g in own(t)) - theta[-1])) for t in texts]


def test_scores_are_those_of_a_plain_statement(spark):
    r = random.Random(9)
    words = ["rain", "house", "green", "Été", "walk"]
    rows = [(i, " ".join([r.choice(words) for _ in range(8)] + (["moron"] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(150)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity(docs, labels).collect()}
    want = plain_scores([(t, y) for i, t, y in rows if not got[i].held_out], [t for _, t, _ in rows])
    assert max(abs(got[i].score - s) for (i, _, _), s in zip(rows, want, strict=True)) < 1e-4


def test_features_in_blocks_are_the_same():
    r = np.random.default_rng(2)
    width, own = 900, [np.sort(np.random.default_rng(i).choice(900, k, replace=False)) for i, k in enumerate([0, 3, 20, 40, 500, 900] * 5)]
    rows = [tox.encoded(x, width) for x in own]
    assert all(len(x) <= width // 8 + 2 for x in rows) and all((tox.decoded(x, width) == y).all() for x, y in zip(rows, own, strict=True))
    labels, scale = r.integers(0, 2, len(rows)), r.standard_normal(width)
    one, two = (tox.fit(tox.Presence(rows, width, block, room), labels, scale, rounds=20) for block, room in ((500, 10**6), (7, 100)))
    assert np.allclose(one[0], two[0]) and np.isclose(one[1], two[1])


def test_held_out_accuracy_on_the_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = [(r.score, r.predicted, r.toxic) for r in toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()]
    toxic, clean = ([s for s, _, t in got if t == x] for x in (1, 0))
    assert np.mean([(s > c) + (s == c) / 2 for s in toxic for c in clean]) > 0.95
    assert np.mean([p for _, p, t in got if t == 1]) > 0.8 and np.mean([p for _, p, t in got if t == 0]) < 0.02
