"""Removal of lines that many sites share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.base import FEW, frequent, named, stored, whole

#: Sketches of 2^12 registers: their relative standard error.
LG_K, ERROR = 12, 1.04 / 64


def site_lines(docs: DataFrame, site_col: str, text_col: str) -> DataFrame:
    """site and hash of each line with a word."""
    lines = docs.select(F.coalesce(named(site_col).cast("string"), F.lit("")).alias("site"), F.explode(F.split(whole(text_col), "\n", -1)).alias("line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("site", F.xxhash64("line").alias("line"))


def shared_lines(docs: DataFrame, sites: int = 5, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """line, n: hashes of the lines that stand in texts of `sites` sites or more, and how often they occur.

    Each task counts a line and sketches its sites by HyperLogLog where it reads it, and
    these are merged, so that a line that a third of all rows hold is one row a task. A
    line that occurs less often than that is out. Where the estimate is within four standard
    errors of the threshold (and one site), the distinct sites are counted exactly, after
    each task has made its own pairs of line and site distinct.
    """
    lines = site_lines(docs, site_col, text_col)
    sketched = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", LG_K).alias("sketch"))
    spread = stored(sketched.where(F.col("n") >= sites).select("line", "n", F.hll_sketch_estimate("sketch").alias("about")))
    margin = 1 + 4 * ERROR * sites
    near = spread.where(F.abs(F.col("about") - sites) <= margin).select("line", "n")
    if near.count() <= FEW:
        pairs = lines.join(F.broadcast(near), "line").groupBy("line", "n", "site").agg(F.lit(1).alias("one"))
    else:
        pairs = lines.groupBy("line", "site").agg(F.lit(1).alias("one")).join(near, "line")
    exact = pairs.groupBy("line", "n").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= sites).select("line", "n")
    return spread.where(F.col("about") > sites + margin).select("line", "n").unionByName(exact)


def without_lines(text: str, drop) -> tuple[str, int, int]:
    """The text without the lines that `drop` names, the number of its lines, and of those dropped."""
    lines = text.split("\n")
    gone = drop(lines)
    return "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), int(sum(gone))


def line_dedup(docs: DataFrame, sites: int = 5, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", most_broadcast: int = 500_000) -> DataFrame:
    """doc_id, text without the lines that `sites` sites or more share, n_lines, n_removed.

    Lines are what \\n parts; they are equal when no byte differs; a line without a word
    stays. All copies of a shared line go. The most frequent shared lines, at most
    `most_broadcast`, are broadcast as hashes. Where there are more, the lines of each
    document that are not among these are joined to the rarer ones, none of which is in
    many rows.

    A null text is empty and has one line; null sites are one site; ids may be null or
    repeat; an empty table gives an empty result.
    """
    shared = stored(shared_lines(docs, sites, site_col, text_col))
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    schema = "doc_id long, text string, n_lines long, n_removed long"
    least = frequent(shared, most_broadcast)
    packed = shared.where(F.col("n") >= least).select("line").toPandas()["line"].to_numpy(np.int64)
    known = np.sort(packed)

    def listed(lines):
        hashes = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in lines], np.uint64).view(np.int64)
        word = np.array([bool(x.strip(" \t\n\r\x0b\x0c")) for x in lines])
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        return (known[at] == hashes) & word if len(known) else np.zeros(len(lines), np.bool_)

    def run(batches):
        for batch in batches:
            out = [without_lines(x.as_py(), listed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], ["doc_id", "text", "n_lines", "n_removed"])

    done, rare = rows.mapInArrow(run, schema), shared.where(F.col("n") < least).select("line")
    if not rare.limit(1).count():
        return done
    # a row of its own, as ids may repeat; the rest of the text is cut again
    done = stored(done.withColumn("row", F.monotonically_increasing_id()))
    lines = done.select("row", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("row", "at", F.xxhash64("line").alias("line"))
    gone = lines.join(rare, "line").groupBy("row").agg(F.collect_list("at").alias("gone"))
    told = done.join(gone, "row", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    # all lines of a text may be gone already: what is left of it is then no line
    left = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("gone", i))
    return told.select("doc_id", F.array_join(left, "\n").alias("text"), "n_lines", (F.col("n_removed") + F.size("gone")).cast("long").alias("n_removed"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth FROM documents),
shared AS (
  SELECT line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= 5)
SELECT doc_id, count(*) AS n_lines, count(s.line) AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN s.line IS NULL THEN l.line END, chr(10) ORDER BY nth), '')) AS text_sha256
FROM lines l LEFT JOIN shared s ON l.line = s.line GROUP BY doc_id
"""
