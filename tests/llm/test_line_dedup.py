import re
from collections import defaultdict

import pytest

from spanveil.llm.line_dedup import line_dedup, shared_lines


def brute(rows, sites):
    where = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                where[line].add(site or "")
    out = []
    for doc, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(where.get(x, ())) < sites]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    own = [(i, f"Home\nonly {i}\n\nat five\n" + ("at four\n" if i % 10 < 4 else "") + "end", f"s{i % 10}") for i in range(200)]
    own = [(d, t if int(s[1]) < 5 else t.replace("at five\n", ""), s) for d, t, s in own]
    return own + [(300, None, "s1"), (301, "", None), (302, " \n \n\t", None), (None, "Home\n Home\nHome\r", "s2"), (303, "Home\n" * 20_000, "s3"), (1, "Home", "s1"), (1, "Home\nmore", "s1")]


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_against_brute_force(spark, rows, most):
    docs = spark.createDataFrame([(a, b, c, "clash") for a, b, c in rows], "doc_id long, text string, source string, line string")
    got = sorted(map(tuple, line_dedup(docs, 5, most_broadcast=most).collect()), key=str)
    assert got == brute(rows, 5)
    assert line_dedup(docs.limit(0), 5, most_broadcast=most).collect() == []


def test_sites_far_over_and_near_the_threshold(spark):
    many = [(i, "everywhere\n" + ("near" if i < 300 else "below" if i < 599 else "other"), f"site{i}") for i in range(4000)]
    docs = spark.createDataFrame(many, "doc_id long, text string, source string")
    assert shared_lines(docs, 300).count() == 3
    assert shared_lines(docs, 301).count() == 2
    assert line_dedup(docs, 300).where("n_removed > 0").count() == 4000
