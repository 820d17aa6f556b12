"""Detection: each document with an array of the spans found in it, in one pass over the text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import text as T
from spanveil.operators.patterns import BY_NAME, CONTEXT, CONTEXT_BOOST, CONTEXT_CHARS, PATTERNS, Pattern
from spanveil.types import ENTITIES


def none_found() -> Column:
    return F.array().cast(ENTITIES)


def matches(text: Column, regex: str | Column, hint: str | None = None) -> Column:
    """Array of (start, text) of all matches.

    The text is scanned for matches and gaps once each, and not at all without one; for
    patterns with a hint, a text without that is not even searched.
    """
    regex = F.lit(regex) if isinstance(regex, str) else regex
    both = F.arrays_zip(F.regexp_extract_all(text, regex, F.lit(0)).alias("m"), F.split(text, regex, -1).alias("g"))
    empty = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start int, text string>>").alias("out"))

    def step(acc, x):
        at = acc["pos"] + F.length(x["g"])
        more = F.array_append(acc["out"], F.struct(at.alias("start"), x["m"].alias("text")))
        return F.struct((at + F.coalesce(F.length(x["m"]), F.lit(0))).alias("pos"), F.when(x["m"].isNull(), acc["out"]).otherwise(more).alias("out"))

    has = F.regexp_like(text, regex) if hint is None else text.contains(hint) & F.regexp_like(text, regex)
    return F.when(has, F.aggregate(both, empty, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<start int, text string>>"))


def pattern_entities(text: Column, lang: Column, p: Pattern) -> Column:
    found = matches(text, p.regex, p.hint)
    if p.lang:
        found = F.when(lang.isin(*p.lang.split("|")), found).otherwise(F.array().cast("array<struct<start int, text string>>"))
    if p.check:
        found = F.filter(found, lambda m: getattr(T, p.check)(m["text"]))
    return F.transform(found, lambda m: F.struct(F.lit(p.entity_type).alias("entity_type"), m["text"].alias("text"), m["start"].cast("int").alias("start"), (m["start"] + F.length(m["text"])).cast("int").alias("end"), F.round(F.lit(p.score), 4).alias("score"), F.lit("rules").alias("source")))


def boosted(text: Column, entities: Column) -> Column:
    """Scores raised where a word for the type stands among the characters before the span."""

    def one(e):
        before = F.lower(F.substring(text, F.greatest(e["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(e["start"], F.lit(CONTEXT_CHARS))))
        near = reduce(lambda a, b: a | b, ((e["entity_type"] == t) & reduce(lambda a, b: a | b, (before.contains(w) for w in words)) for t, words in CONTEXT.items()))
        return e.withField("score", F.when(near, F.least(F.lit(1.0), F.round(e["score"] + CONTEXT_BOOST, 4))).otherwise(e["score"]))

    return F.transform(entities, one)


def rule_entities(text: Column, lang: Column, names: Iterable[str] | None = None, context: bool = True) -> Column:
    """Spans of the named patterns (all of them, if none are named); a null or empty text has none."""
    chosen = [BY_NAME[n] for n in names] if names is not None else PATTERNS
    found = F.flatten(F.array(*(pattern_entities(text, lang, p) for p in chosen)))
    found = boosted(text, found) if context else found
    return F.when(F.length(text) > 0, found.cast(ENTITIES)).otherwise(none_found())


def with_rules(docs: DataFrame, names: Iterable[str] | None = None, context: bool = True, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with `entities`, those of the rule detector appended to what is there already."""
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit("de")
    found = rule_entities(F.col(text_col), lang, names, context)
    known = F.coalesce(F.col("entities"), none_found()) if "entities" in docs.columns else None
    return docs.withColumn("entities", found if known is None else F.concat(known, found))


def spans(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each entity of each document."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode("entities").alias("ordinal", "e")).select("doc_id", "ordinal", "e.*")
