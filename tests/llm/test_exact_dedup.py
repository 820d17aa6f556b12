import hashlib
from collections import defaultdict

from spanveil.llm.exact_dedup import exact_duplicates, without_copies


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    top = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return sorted(((d, top[t or ""], len(groups[t or ""]), d == top[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=str)


def test_against_brute_force(spark):
    rows = [(i, f"t{i % 7}" if i % 3 else "hot") for i in range(3000)] + [(9000, None), (9001, ""), (9001, ""), (None, "hot"), (None, "alone"), (9002, "x" * 200_000), (9003, "Hot"), (9004, "hot ")]
    docs = spark.createDataFrame([(a, b, "clash", 5) for a, b in rows], "doc_id long, text string, digest string, group_size int")
    assert sorted(map(tuple, exact_duplicates(docs).collect()), key=str) == brute(rows)
    # with room for one counter only, the others are shuffled
    assert sorted(map(tuple, exact_duplicates(docs, tracked=4).collect()), key=str) == brute(rows)


def test_frequent_text_is_settled_without_shuffle(spark):
    from pyspark.sql import functions as F

    from spanveil.llm.exact_dedup import frequent_digests

    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("digest"))
    assert "hot" in {r.digest for r in frequent_digests(rows, 64).collect()}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_duplicates(docs).collect() == []
    assert without_copies(docs).collect() == []


def test_frequent_texts_beyond_what_the_summary_names(spark):
    """Two hundred texts of 20 rows each, with 16 counters: most are shuffled, none is lost."""
    rows = [(i, f"text {i % 200}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert sorted(map(tuple, exact_duplicates(docs, tracked=16).collect()), key=str) == brute(rows)


def test_without_copies_with_ids_that_repeat_and_names_that_clash(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "c"), (None, "a"), (None, "d"), (4, None), (5, "")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, gone_id int, `text.sha` string")
    got = without_copies(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, "a"), (3, "b"), (3, "c"), (None, "d"), (5, "")], key=str)
