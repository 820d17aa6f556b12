"""Stable numbered tokens for distinct entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanveil.functions.durable import cut
from spanveil.functions.text import lookup_key

PREFIX, SUFFIX = "<<", ">>"
MAPPING = "pseudonym string, original string, lookup_key string, label string, n long"


def mentions(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each entity with its key and the place that fixes the order of numbering: document, then from the back."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.posexplode("entities").alias("ordinal", "e"))
    return found.select(lookup_key(F.col("e.text")).alias("lookup_key"), F.struct(F.col("doc_id"), (-F.col("e.start")).alias("back"), F.col("ordinal"), F.col("e.text").alias("original"), F.col("e.entity_type").alias("entity_type")).alias("first"))


def distinct_entities(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """lookup_key with its first mention, which gives the spelling and the type; counted where it is read, then merged."""
    return mentions(docs, id_col).groupBy("lookup_key").agg(F.min("first").alias("first"))


def numbered(entities: DataFrame, label: str | None, start: DataFrame | None) -> DataFrame:
    """Numbers without gaps in the order of first mentions, on from `start` (label, n).

    Keys are dealt by range of that order, so that one label with most of the keys is
    numbered by many tasks: each counts its own, and the counts before it are added.
    """
    own = entities.withColumn("label", F.col("first.entity_type") if label is None else F.lit(label))
    dealt = cut(own.repartitionByRange("label", "first").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("label", "part").count().select("label", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("label", "part").orderBy("first"))
    ranked = dealt.withColumn("rank", rank).join(counts, ["label", "part"])
    known = F.lit(0)
    if start is not None:
        ranked = ranked.join(start.withColumnRenamed("n", "known"), "label", "left")
        known = F.coalesce("known", F.lit(0))
    return ranked.withColumn("n", (known + F.col("before") + F.col("rank")).cast("long"))


def token(label: Column, n: Column, prefix: str = PREFIX, suffix: str = SUFFIX) -> Column:
    return F.concat(F.lit(prefix), label, F.lit("_"), n.cast("string"), F.lit(suffix))


def counters(mapping: DataFrame, label: str | None = None, prefix: str = PREFIX, suffix: str = SUFFIX) -> DataFrame:
    """label, n: the last number given out, read from the tokens; one over all of them if a label is set."""
    body = F.regexp_replace(F.col("pseudonym"), "^" + _quoted(prefix) + "|" + _quoted(suffix) + "$", "")
    parsed = mapping.select(F.regexp_extract(body, r"^([A-Z_]+)_([0-9]+)$", 1).alias("label"), F.regexp_extract(body, r"^([A-Z_]+)_([0-9]+)$", 2).alias("n")).where("n <> ''")
    return parsed.select(F.col("label") if label is None else F.lit(label).alias("label"), F.col("n").cast("long").alias("n")).groupBy("label").agg(F.max("n").alias("n"))


def _quoted(x: str) -> str:
    return "".join("\\" + c for c in x)


def assigned(docs: DataFrame, known: DataFrame | None = None, label: str | None = None, id_col: str = "doc_id", prefix: str = PREFIX, suffix: str = SUFFIX, start: DataFrame | None = None) -> DataFrame:
    """The mapping of the entities of docs: `known` rows (see MAPPING) and one for each new key; see `told`."""
    return told(distinct_entities(docs, id_col), known, label, prefix, suffix, start)


def told(entities: DataFrame, known: DataFrame | None = None, label: str | None = None, prefix: str = PREFIX, suffix: str = SUFFIX, start: DataFrame | None = None) -> DataFrame:
    """The mapping of distinct entities (lookup_key, first): known rows and one for each new key.

    A key keeps the token that it has, whatever type it is found as later. Numbers go on
    from the largest known for the label, or from `start` (label, n) where that is larger.
    """
    last = None
    if known is not None:
        entities = entities.join(known.select("lookup_key"), "lookup_key", "left_anti")
        last = counters(known, label, prefix, suffix)
    if start is not None:
        last = start.select("label", "n") if last is None else last.unionByName(start.select("label", "n")).groupBy("label").agg(F.max("n").alias("n"))
    ranked = numbered(entities, label, last)
    rows = ranked.select(token(F.col("label"), F.col("n"), prefix, suffix).alias("pseudonym"), F.col("first.original").alias("original"), "lookup_key", "label", "n")
    return rows if known is None else known.select("pseudonym", "original", "lookup_key", "label", "n").unionByName(rows)


def hydrated(pairs: DataFrame) -> DataFrame:
    """A mapping from stored pairs (pseudonym, original)."""
    part = lambda i: F.regexp_extract("pseudonym", r"([A-Z_]+)_([0-9]+)", i)
    return pairs.select("pseudonym", "original", lookup_key(F.col("original")).alias("lookup_key"), part(1).alias("label"), F.nullif(part(2), F.lit("")).cast("long").alias("n"))


def summary(mapping: DataFrame) -> DataFrame:
    """Distinct entities and the last number, by label; no originals."""
    return mapping.groupBy("label").agg(F.count(F.lit(1)).alias("entities"), F.max("n").alias("last_n"))


def snapshot(mapping: DataFrame, label: str | None = None, prefix: str = PREFIX, suffix: str = SUFFIX) -> DataFrame:
    """One row: the mapping of one namespace as JSON, to be stored elsewhere."""
    pairs = mapping.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("pseudonym", "original")))).alias("pseudo_to_entity"))
    last = counters(mapping, label, prefix, suffix).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("counters"))
    return pairs.crossJoin(last).select(F.to_json(F.struct(F.lit(prefix).alias("prefix"), F.lit(suffix).alias("suffix"), F.lit(label).cast("string").alias("label"), "pseudo_to_entity", "counters")).alias("snapshot"))


def restored(spark: SparkSession, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """The mapping of a snapshot, and its counters (label, n) as they were, which may be ahead of its tokens."""
    row = spark.createDataFrame([(snapshot,)], "s string").select(F.from_json("s", "prefix string, suffix string, label string, pseudo_to_entity map<string,string>, counters map<string,bigint>").alias("x"))
    pairs = row.select(F.explode("x.pseudo_to_entity").alias("pseudonym", "original"))
    return hydrated(pairs), row.select(F.explode("x.counters").alias("label", "n"))


def pseudonyms(mapping: DataFrame) -> DataFrame:
    """pseudonym of all entities, by label and number."""
    return mapping.orderBy("label", "n").select("pseudonym")
