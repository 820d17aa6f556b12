"""Exact deduplication in which frequent texts never meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.base import cut, free, named, whole, without

#: Summaries are merged in so many parts, and those then in one.
PARTS = 64


def frequent_digests(rows: DataFrame, tracked: int) -> DataFrame:
    """Digests that a Misra-Gries summary of so many counters holds to be frequent.

    Each input partition is summed up by itself; the summaries merge in PARTS tasks, and
    what these make in one, which therefore reads PARTS summaries of fixed size.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")
    summaries = rows.groupBy(part).agg(F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("summary"))
    # grouped by a constant, as a summary of no rows can't be read
    top = summaries.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(summary, {tracked}), {tracked})").alias("top"))
    return top.select(F.explode("top").alias("one")).select(F.col("one.item").alias("digest"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 4096) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when no byte differs; a null text is an empty one. Of equal texts
    the largest doc_id stays. The summary finds every digest with more than about
    1/tracked of all rows. All that it names (`tracked` at most) are counted exactly and
    their winners broadcast, so their rows are settled where they were read. Only the
    digests of the others are shuffled; a group of these has at most about 1/tracked of
    all rows.

    Null ids lose against any other; a group of null ids only stays whole. Rows that
    share both id and text are one document: all say the same. An empty table gives an
    empty result. Other columns of docs are not looked at.
    """
    rows = cut(docs.select(named(id_col).alias("doc_id"), F.sha2(whole(text_col), 256).alias("digest")))
    winners = cut(rows.join(F.broadcast(frequent_digests(rows, tracked)), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    settled = rows.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    others = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select("digest", "doc_id", F.max("doc_id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"))
    return settled.unionByName(others).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that `exact_duplicates` keeps, with the columns of docs.

    What goes is named by id and digest, so an id with two texts loses only the copy; a
    document without an id goes if one with an id has its text.
    """
    gone_id, gone_digest = free(docs.columns, "gone_id", "gone_digest")
    gone = exact_duplicates(docs, id_col, text_col, **how).where("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_digest))
    return without(docs, cut(gone.distinct()), named(id_col).eqNullSafe(F.col(gone_id)) & (F.sha2(whole(text_col), 256) == F.col(gone_digest)))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))
"""
