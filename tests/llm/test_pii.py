import hashlib
import random
import re

import numpy as np
import pytest

from spanveil.llm.pii import Fragment, added_spans, base_spans, digest, find_pii, put_together, reconciled, windows, written
from spanveil.llm.pii_model import KINDS, NEVER, START, TAGS, Examples, Network, trained

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        own = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x.lstrip("0")[:9] or "0") <= 255 for x in m[0].split("."))) or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15):
                own.append(m.span())
        out[kind] = own
    return out


@pytest.fixture(scope="module")
def net():
    return trained(["the house and of with rain", "der die und enheit"])


def test_base_spans_against_the_patterns():
    r = random.Random(6)
    for _ in range(20_000):
        text = "".join(r.choice(["a", "b_", "@", ".", "1", "25", "+", " ", "-", "(", ")", "é", "4111", "%", "0.", "x@y.z"]) for _ in range(r.randint(1, 25)))
        assert base_spans(text) == brute(text), text
    for text in ("4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.1.1.1", "0" * 5000 + ".1.1.1", "1" * 5000 + ".1.1.1", "1.1.1." + "0" * 6000 + "255", "\U0001f600 1.1.1.1"):
        assert base_spans(text) == brute(text)


def test_long_runs_take_no_square_time():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "1 " * 150_000):
        base_spans(text)


def test_network_finds_spans_of_lines_not_seen(net):
    hit, want, said = ({k: 0 for k in KINDS} for _ in range(3))
    examples = Examples(77, ["then in there was a boy", "le que ment aux"])
    for _ in range(200):
        text, spans = examples.line(400)
        got = {*added_spans([text], net)[0]}
        gold = {(KINDS[k], a, b) for k, a, b in spans}
        for k in KINDS:
            own, true = ({s for s in x if s[0] == k} for x in (got, gold))
            hit[k], want[k], said[k] = hit[k] + len(own & true), want[k] + len(true), said[k] + len(own)
    for k in KINDS:
        assert hit[k] / want[k] >= 0.9 and hit[k] / said[k] >= 0.9, (k, hit[k], want[k], said[k])


def test_spans_at_every_place_of_a_window_and_longer_than_one(net):
    for before in range(60, 260, 7):
        text = ("the house and " * 30)[:before] + " 10[.]20[.]30[.]40 and the rain " + "of the house " * 20
        assert ("ip", before + 1, before + 18) in added_spans([text], net)[0], before
    for n in (90, 170, 300):
        text = "with the house " + "abcdefghij" * (n // 10) + "@house.org and the rain"
        assert ("email", 15, 15 + n + 10) in added_spans([text], net)[0], n


def test_fragments_are_put_together():
    one = lambda k, a, b, left=False, right=False, gain=1.0: Fragment(k, a, b, np.full(b - a, gain), left, right)
    assert put_together([one("ip", 5, 160, False, True), one("ip", 80, 200, True, False, 3.0)]) == {("ip", 5, 200): 75 + 80 * 2 + 40 * 3}
    assert put_together([one("ip", 100, 110), one("ip", 100, 110)]) == {("ip", 100, 110): 10}
    assert {*put_together([one("ip", 100, 110), one("ip", 110, 120), one("card", 105, 108)])} == {("ip", 100, 110), ("ip", 110, 120), ("card", 105, 108)}
    assert {*put_together([one("ip", 0, 160, False, True), one("ip", 80, 240, True, True), one("ip", 160, 300, True, False)])} == {("ip", 0, 300)}


def test_decode_is_the_best_of_all_paths():
    from itertools import product

    net = Network.fresh(5)
    chars = np.random.default_rng(1).integers(1, 120, (3, 4))
    tags, _ = net.decode(chars)
    score, trans = net.run(chars), net.w["trans"] + NEVER
    for i in range(3):
        value = lambda path, i=i: START[path[0]] + sum(score[i, t, x] for t, x in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False))
        assert abs(value(tuple(tags[i])) - max(map(value, product(range(TAGS), repeat=4)))) < 1e-4


def test_gradient():
    net = Network.fresh(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    chars, tags = Examples(3, ["abc def ghi"]).batch(3, 12)
    _, g = net.gradient(chars, tags)
    r = np.random.default_rng(0)
    for k, w in net.w.items():
        at = tuple(r.integers(0, s) for s in w.shape) if k != "embed" else (chars[0, 0], 2)
        was, losses = w[at], []
        for e in (0.01, -0.01):
            w[at] = was + e
            losses.append(net.gradient(chars, tags)[0])
        w[at] = was
        assert abs((losses[0] - losses[1]) / 0.02 - g[k][at]) < 1e-2 * max(1, abs(g[k][at]))


def test_reconciling_is_the_heaviest_choice():
    from itertools import combinations

    r = random.Random(8)
    for _ in range(200):
        spans = {("ip", a := r.randrange(20), a + r.randint(1, 8)): r.random() for _ in range(7)}
        best = max((sum(spans[s] for s in c) for n in range(8) for c in combinations(spans, n) if all(x[2] <= y[1] or y[2] <= x[1] for x, y in combinations(c, 2))), default=0)
        assert abs(sum(spans[s] for s in reconciled(spans)) - best) < 1e-9


def test_windows_cover_every_digit_twice_or_at_an_end():
    for n in (0, 1, 159, 160, 161, 240, 241, 1000):
        for at in range(0, n, 7):
            text = "x" * at + "7" + "x" * (n - at - 1)
            own = windows(text)
            assert own and all(w <= at < w + 160 for w in own)


def test_operator(spark):
    rows = [(1, None), (2, ""), (3, "mail a.b@c.de and call (212) 555-0188 now"), (4, "x" * 200_000 + " 1.2.3.4"), (None, "+1 (017) 555-7713"), (3, "\U0001f600 10.0.0.1"), (8, "0" * 5000 + ".1.1.1"), (5, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 473696257 on 2024-01-02')]
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, spans string, n_ip int")
    got = sorted(digest(find_pii(docs)).collect(), key=str)
    want = sorted(((a, *(len(brute(b or "")[k]) for k in KINDS), hashlib.sha256(written(brute(b or "")).encode()).hexdigest()) for a, b in rows), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    for r in got:
        if r.doc_id == 5:
            assert r.spans == ""
    assert digest(find_pii(docs.limit(0))).collect() == []


def test_base_stays_and_clean_documents_are_left_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    added = 0
    for r in digest(find_pii(docs)).collect():
        base = written(brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert {*filter(None, base.split(","))} <= {*r.spans.split(",")}
        added += len([*filter(None, r.spans.split(","))]) - len([*filter(None, base.split(","))])
    assert added <= 10
