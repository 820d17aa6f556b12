import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanveil.llm.mixing import mix, mixed


def form(t):
    marks = sum(len(t) - len(t.replace(m, "")) for m in ("***", "###", "$$$", "%%%", "&&&"))
    return "table" if len(t) - len(t.replace(" | ", "")) >= 15 else "symbols" if marks >= 15 else "capitals" if t.upper() == t != t.lower() else "prose"


def brute(rows, keep=0.8, power=0.9):
    cells = defaultdict(float)
    key = lambda s, l, t: (s or "\x00", l or "\x00", form(t or ""))
    for _, t, l, s in rows:
        cells[key(s, l, t)] += math.ceil(len((t or "").encode()) / 4)
    n = sum(cells.values())
    weight = {c: v / n for c, v in cells.items()}
    targets = []
    for d in range(3):
        own = defaultdict(float)
        for c, v in cells.items():
            own[c[d]] += v
        raised = {k: v**power for k, v in own.items() if v}
        targets.append({k: v / sum(raised.values()) for k, v in raised.items()})
    for _ in range(200):
        for d in range(3):
            total = defaultdict(float)
            for c, w in weight.items():
                total[c[d]] += w
            weight = {c: w * targets[d].get(c[d], 0) / total[c[d]] if total[c[d]] else 0 for c, w in weight.items()}
    ratio = {c: weight[c] * n / cells[c] if cells[c] else 0 for c in cells}
    low, high = 0.0, 1e9
    for _ in range(300):
        rate = (low + high) / 2
        low, high = (rate, high) if sum(cells[c] * min(1, rate * ratio[c]) for c in cells) < keep * n else (low, rate)
    out = []
    for d, t, l, s in rows:
        p = min(1, rate * ratio[key(s, l, t)])
        u = int(hashlib.md5(f"mix:{'' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52
        out.append((d, round(ratio[key(s, l, t)], 5), round(p, 5), u < p))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(1200):
        text = ["some prose here " * (i % 40 + 1), "A | b | c | d | e | f | g", "x***y### z$$$ a%%% b&&& c***", "SHOUT LOUD"][0 if i % 9 else i % 4]
        out.append((i, text, ["en", "fr", None][i % 3 if i % 5 else 0], "hot" if i % 3 == 0 else f"s{i % 7}"))
    return out + [(5000, None, "en", "hot"), (5001, "", None, None), (None, "no id", "en", "s1"), (7, "again", "en", "s1"), (5002, "y" * 100_000, "en", "s2")]


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, weight string, tokens int")
    got = mixed(docs)
    assert sorted(((r.doc_id, round(r.mix_weight, 5), round(r.mix_probability, 5), r.mix_kept) for r in got.collect()), key=str) == brute(rows)
    kept = mix(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[3] for r in brute(rows))


def test_targets_are_met(spark, rows):
    docs = spark.createDataFrame([r for r in rows if r[2] and r[3] and r[1]], "doc_id long, text string, lang string, source string")
    targets = {"lang": spark.createDataFrame([("en", 0.5), ("fr", 0.5)], "value string, target double")}
    got = mixed(docs, targets=targets).selectExpr("lang", "mix_tokens * mix_weight AS w").groupBy("lang").sum("w").collect()
    total = sum(r[1] for r in got)
    assert {r.lang: round(r[1] / total, 6) for r in got} == {"en": 0.5, "fr": 0.5}


def test_empty_tables_and_texts(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert mixed(spark.createDataFrame([], schema)).collect() == []
    assert len(mixed(spark.createDataFrame([(1, None, None, None), (2, "", "en", "a")], schema)).collect()) == 2


def test_columns_of_the_same_names_are_left_alone(spark, rows):
    names = ["mix_cell", "MIX_Tokens", "mix_topic", "mix_source", "mix_kept", "a.b"]
    docs = spark.createDataFrame([(*r, *(f"{n}!" for n in names)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    kept = mix(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[3] for r in brute(rows))
    assert {tuple(r)[4:] for r in kept.collect()} == {tuple(f"{n}!" for n in names)}


def test_own_token_counts_and_what_is_reported(spark):
    docs = spark.createDataFrame([(i, "x", ["en", "fr"][i % 2], ["a", "b", "c"][i % 3], 10 + i % 7) for i in range(900)], "doc_id long, text string, lang string, source string, n int")
    report = {}
    got = mixed(docs, tokens=F.col("n"), report=report).collect()
    assert all(r.mix_tokens == r.n for r in got)
    assert report["worst"] <= 1e-9 and report["rounds"] and report["whole"] < 1
    assert abs(sum(r.n * r.mix_probability for r in got) / sum(r.n for r in got) - 0.8) < 1e-9
    # French stands in one source only, which may not give half of the mix
    apart = docs.withColumn("source", F.when(F.col("lang") == "fr", "a").otherwise("b"))
    targets = {"lang": spark.createDataFrame([("en", 0.5), ("fr", 0.5)], "value string, target double"), "source": spark.createDataFrame([("a", 0.1), ("b", 0.9)], "value string, target double")}
    mixed(apart, targets=targets, report=report).collect()
    assert report["worst"] > 0.3


def test_many_cells_give_what_few_do(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50), ["en", "fr", None][i % 3], ["a", "b"][i % 2]) for i in range(600)], "doc_id long, text string, lang string, source string")
    key = lambda df: sorted((r.doc_id, round(r.mix_probability, 9), r.mix_kept) for r in df.collect())
    assert key(mixed(docs)) == key(mixed(docs, few_cells=0))
