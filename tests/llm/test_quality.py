import random
import re
from collections import Counter
from math import comb

import pytest

from spanveil.llm import quality as q
from spanveil.llm.quality import chosen_cutoffs, quality, repeated_words, safe, text_counts


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    times = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if times[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", " \n\t", "a b\n\na b\n \n \na b", "é\x85ü \xa0 x", "w " * 9, "w " * 8, "#*$%&|<> \U0001f600", "x" * 100_000, " ".join(f"u{i}" for i in range(50)) + " " + " ".join(f"u{i}" for i in range(30, 45))]


def test_counts_against_brute_force(spark):
    r = random.Random(4)
    texts = TEXTS + [" ".join(r.choice("ab") for _ in range(r.randint(1, 60))) + r.choice(["", "\n", "\nab\nab"]) for _ in range(200)]
    assert [text_counts(t or "")[:5] for t in texts] == [brute(t) for t in texts]
    docs = spark.createDataFrame([(i, t, None if i % 2 else "en", "clash") for i, t in enumerate(texts)] + [(None, "no id", "en", "x")], "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([(0, 1, None), (None, 1, 0), (1, None, 1)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality(docs, labels).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeated = brute(t)
        failed = n < 20 or 100 * repeated > 30 * n
        assert tuple(got[i])[:7] == (i, n, chars, symbols, dup, repeated, failed) and got[i].kept == (not failed)
    assert quality(docs.limit(0), labels).collect() == [] and len(got) == len(texts) + 1


def test_equal_hashes_are_not_taken_for_equal_windows(monkeypatch):
    monkeypatch.setattr(q, "hash", lambda _: 1, raising=False)
    assert repeated_words([str(i).encode() for i in range(30)]) == 0


def test_bound_is_the_exact_binomial_one():
    for n, k, p, doubt in [(100, 0, 0.03, 0.05), (99, 0, 0.03, 0.05), (400, 5, 0.03, 0.05), (400, 6, 0.03, 0.05), (50, 0, 0.5, 1e-9)]:
        tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert safe(k, n, p, doubt) == (tail <= doubt)


def test_cutoffs_stop_at_the_first_that_fails():
    n = 5000
    cutoffs = chosen_cutoffs({"en": n}, {("en", 0, i): 0 if i < 10 else 500 if i == 10 else 0 for i in range(60)}, 0.03, 0.05)
    assert cutoffs["en", 0] == q.RULES[0][3][9]
    assert chosen_cutoffs({"en": 100}, {}, 0.03, 0.05) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_false_rejections_stay_under_the_limit(spark, seed):
    r = random.Random(seed)

    def text(bad):
        words = [f"word{r.randrange(10**6)}" for _ in range(40)]
        return " ".join(w + ("###" if r.random() < (0.9 if bad else 0.02) else "") for w in words)

    rows = [(i, text(i % 5 == 0), "en" if i % 2 else "fr", int(i % 5 != 0)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, good int")
    labels = docs.where("doc_id < 4000").selectExpr("doc_id", "good AS quality")
    got = quality(docs, labels).join(docs.select("doc_id", "good", "lang"), "doc_id").collect()
    for lang in ("en", "fr"):
        own = [x for x in got if x.lang == lang and x.good]
        assert sum(not x.kept for x in own) <= 0.03 * len(own)
    bad = [x for x in got if not x.good]
    assert sum(not x.kept and x.failed_rule == "symbols" for x in bad) > 0.9 * len(bad)


def test_small_strata_use_the_whole_share_in_one_sequence():
    strata = dict.fromkeys(("de", "fr", "es"), 300) | {"en": 5000}
    middle = len(q.RULES[0][3]) // 2
    rejected = {("de", 0, i): 0 if i < 7 else 300 for i in range(60)} | {("fr", 1, i): 300 for i in range(29)}
    got = chosen_cutoffs(strata, rejected, 0.03, 0.05)
    assert {k: v for k, v in got.items() if k[0] == "de"} == {("de", 0): q.RULES[0][3][6]}
    assert {k: v for k, v in got.items() if k[0] == "fr"} == {("fr", 0): q.RULES[0][3][middle - 1]}
    assert {r for s, r in got if s == "es"} == {*range(len(q.RULES))} == {r for s, r in got if s == "en"}
    assert not any(s == "xx" for s, _ in chosen_cutoffs(strata | {"xx": 150}, {}, 0.03, 0.05))
