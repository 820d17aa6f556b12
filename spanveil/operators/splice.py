"""Replacing entities by their tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.durable import cut
from spanveil.functions.text import lookup_key
from spanveil.operators.merge import resolved

#: Keys that a map in each row's plan may hold; more are joined.
FEW_KEYS = 50_000
#: A key that more rows ask for is sent to them where they are.
OFTEN = 2_000
#: Keys up to which a map in each row is searched key by key.
FEW_IN_MAP = 200


def spliced(text: Column, entities: Column, tokens: Column) -> Column:
    """The text with each entity replaced from the back; tokens is a map by lookup key."""
    keyed = F.transform(entities, lambda e, i: F.struct((-e["start"]).alias("s"), i.alias("i"), e["end"].alias("end"), lookup_key(e["text"]).alias("k")))
    step = lambda acc, e: F.concat(F.substring(acc, F.lit(1), -e["s"]), F.coalesce(tokens[e["k"]], F.lit("")), F.substring(acc, e["end"] + 1, F.length(acc)))
    return F.aggregate(F.array_sort(keyed), text, step)


def one_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("tokens"))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, with as many _ before all of them as it takes for none to be taken (in any case)."""
    known, mark = {x.lower() for x in taken}, "_"
    while any((mark + x).lower() in known for x in wanted):
        mark += "_"
    return [mark + x for x in wanted]


def with_own_map(docs: DataFrame, wanted: Column, mapping: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """docs with a map `name` from those keys of the array `wanted` that the mapping has to their values.

    Rows are told apart by a key made here, so ids may be null or repeat. A mapping of few
    keys is sent to the rows; of a larger one, keys that many rows ask for are, and the
    others are joined, so no key has its rows in one task.
    """
    (row,) = free_names([*docs.columns, name, key, value], "row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    asked = rows.select(row, F.explode(F.array_distinct(wanted)).alias(key))
    own = met(asked, mapping.select(key, value).dropDuplicates([key]), key).groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))
    return rows.join(own, row, "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<string,string>"))).drop(row)


def met(asked: DataFrame, told: DataFrame, key: str, few: int | None = None) -> DataFrame:
    """asked joined (inner) to told, which has each key once."""
    few = FEW_KEYS if few is None else few
    if told.count() <= few:
        return asked.join(F.broadcast(told), key)
    often = cut(asked.groupBy(key).count().where(F.col("count") > OFTEN).select(key))
    if often.count() > few:
        return asked.join(told, key)
    hot = F.broadcast(often)
    return asked.join(F.broadcast(told.join(hot, key)), key).unionByName(asked.join(hot, key, "left_anti").join(told, key))


def with_tokens(docs: DataFrame, mapping: DataFrame, id_col: str) -> DataFrame:
    """docs with `tokens`, a map from the keys that a document needs to their tokens.

    A mapping of some hundred keys (its size is counted) is one map for all rows, which is
    searched key by key. A larger one is joined to the distinct keys of each row, which come
    back as one map for it.
    """
    if mapping.count() <= FEW_IN_MAP:
        return docs.crossJoin(F.broadcast(one_map(mapping, "lookup_key", "pseudonym")))
    return with_own_map(docs, F.transform("entities", lambda e: lookup_key(e["text"])), mapping, "lookup_key", "pseudonym", "tokens")


def pseudonymized(docs: DataFrame, mapping: DataFrame, overlap: str = "resolve", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `redacted`.

    overlap "resolve" replaces the better of two entities that overlap; "keep" replaces
    both, the later over the earlier one's text, which garbles tokens.
    """
    chosen = resolved(F.col("entities")) if overlap == "resolve" else F.col("entities")
    ready = with_tokens(docs.withColumn("entities", chosen), mapping, id_col)
    return ready.withColumn("redacted", spliced(F.col(text_col), F.col("entities"), F.col("tokens"))).drop("tokens")


def replacements(entities: Column, tokens: Column) -> Column:
    """Map from what stood in the text to its token, for files that are rewritten by part."""
    pairs = F.transform(entities, lambda e: F.struct(e["text"], tokens[lookup_key(e["text"])]))
    return F.map_from_entries(F.array_distinct(pairs))


def replaced_everywhere(text: Column, originals: list[tuple[str, str]]) -> Column:
    """Each original replaced wherever it stands, in the order given."""
    for original, token in originals:
        text = F.replace(text, F.lit(original), F.lit(token))
    return text
