"""Restoring originals from tokens, strictly and then leniently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.operators.mapping import PREFIX, SUFFIX, _quoted
from spanveil.operators.splice import FEW_IN_MAP, free_names, with_own_map

_BODY = r"\s*[A-Za-z_]+_[0-9]+\s*"


def strict_regex(prefix: str = PREFIX, suffix: str = SUFFIX) -> str:
    return _quoted(prefix) + "[A-Z_]+_[0-9]+" + _quoted(suffix)


def lenient_regex(prefix: str = PREFIX, suffix: str = SUFFIX) -> str:
    """Any case, white space inside, and single or double quotation marks of other kinds for << and >>."""
    return f"(?:{_quoted(prefix)}|[«《＜]{{1,2}}){_BODY}(?:{_quoted(suffix)}|[»》＞]{{1,2}})"


def tokens_of(text: Column, regex: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({regex})"), F.lit(1))


def named(token: Column, prefix: str = PREFIX, suffix: str = SUFFIX) -> Column:
    """A lenient token as it is spelled in a mapping."""
    return F.concat(F.lit(prefix), F.upper(F.regexp_extract(token, r"([A-Za-z_]+_[0-9]+)", 1)), F.lit(suffix))


def swapped(text: Column, regex: str, original: Column, key=lambda t: t) -> Column:
    """Matches replaced by the original that the map has for their key; others stay."""
    both = F.arrays_zip(F.split(text, regex, -1).alias("g"), tokens_of(text, regex).alias("t"))
    parts = F.transform(both, lambda x: F.concat(x["g"], F.when(x["t"].isNull(), F.lit("")).otherwise(F.coalesce(original[key(x["t"])], x["t"]))))
    return F.when(text.rlike(regex), F.array_join(parts, "")).otherwise(text)


def with_originals(docs: DataFrame, mapping: DataFrame, prefix: str, suffix: str, id_col: str, text_col: str) -> DataFrame:
    """docs with `originals`: a map by token, whole if small, else of the tokens in the document and in what the strict pass makes of it."""
    pairs = mapping.select("pseudonym", "original")
    if pairs.count() <= FEW_IN_MAP:
        return docs.crossJoin(F.broadcast(pairs.agg(F.map_from_entries(F.collect_list(F.struct("pseudonym", "original"))).alias("originals"))))
    exact = tokens_of(F.col(text_col), strict_regex(prefix, suffix))
    (name,) = free_names(docs.columns, "first")
    first = with_own_map(docs, exact, pairs, "pseudonym", "original", name)
    once = swapped(F.col(text_col), strict_regex(prefix, suffix), F.col(name))
    loose = F.transform(tokens_of(once, lenient_regex(prefix, suffix)), lambda t: named(t, prefix, suffix))
    return with_own_map(first, F.concat(exact, loose), pairs, "pseudonym", "original", "originals").drop(name)


def revealed(docs: DataFrame, mapping: DataFrame, lenient: bool = True, prefix: str = PREFIX, suffix: str = SUFFIX, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `revealed`, `n_replaced` (strict and lenient) and `n_unresolved` (strict tokens without an original).

    The lenient pass reads what the strict one left, so an original that looks like a
    token is looked up as well. It is only made where the mapping has any token.
    """
    ready = with_originals(docs, mapping, prefix, suffix, id_col, text_col)
    text, own, exact, loose = F.col(text_col), F.col("originals"), strict_regex(prefix, suffix), lenient_regex(prefix, suffix)
    hit = lambda tokens, key: F.size(F.filter(tokens, lambda t: F.map_contains_key(own, key(t))))
    key = lambda t: named(t, prefix, suffix)
    out = ready.withColumn("revealed", swapped(text, exact, own)).withColumn("n_replaced", hit(tokens_of(text, exact), lambda t: t).cast("long"))
    out = out.withColumn("n_unresolved", F.size(tokens_of(text, exact)).cast("long") - F.col("n_replaced"))
    if lenient:
        out = out.withColumn("n_replaced", F.col("n_replaced") + hit(tokens_of(F.col("revealed"), loose), key)).withColumn("revealed", swapped(F.col("revealed"), loose, own, key))
    return out.drop("originals")


def lookup(mapping: DataFrame, pseudonym: str) -> DataFrame:
    return mapping.where(F.col("pseudonym") == pseudonym).select("pseudonym", "original")
