"""URL verdicts by rules, and by a Bloom filter cascade for what no rule fits."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.base import cut

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
HASHES, BITS_A_KEY = 7, 10


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; both empty without a ://."""
    known = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(known, "://") > 0, F.substring(known, F.instr(known, "://") + 3, F.length(known))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; nulls where none does."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda x: -len(x[1])):
        at, _, start = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def places(key: Column, level: int, bits: int) -> list[Column]:
    """The bits of a key in the filter of a level."""
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)]


def bloom_filter(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row with `words`: the filter of the keys as an array of longs."""
    at = keys.select(F.explode(F.array(*places(F.col("key"), level, bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"))
    dense = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def passes(key: Column, level: int, bits: int, words: Column) -> Column:
    said = None
    for at in places(key, level, bits):
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        one = F.call_function("getbit", word, at.bitwiseAND(F.lit(63)).cast("int")) == 1
        said = one if said is None else said & one
    return said


def cascade(universe: DataFrame, most_levels: int = 30) -> list[tuple[int, DataFrame]]:
    """Filters by level for (key, listed), each key once.

    The first level holds the listed keys, the second those others that pass the first,
    the third those listed keys that pass the second, and so on until a level lets no key
    pass in error.
    """
    levels: list[tuple[int, DataFrame]] = []
    inside, outside = universe.where("listed"), universe.where("not listed")
    for level in range(most_levels):
        n = inside.count()
        if not n:
            return levels
        bits = 64 * ceil(max(n, 7) * BITS_A_KEY / 64)
        words = cut(bloom_filter(inside, level, bits))
        levels.append((bits, words))
        wrong = cut(outside.where(passes(F.col("key"), level, bits, words.scalar())))
        inside, outside = wrong, inside
    raise RuntimeError("the cascade did not end")


def member(key: Column, levels: list[tuple[int, DataFrame]]) -> Column:
    """Whether a key of the universe is listed: exact, from the filters alone."""
    said = F.lit(len(levels) % 2 == 1)
    for level in reversed(range(len(levels))):
        bits, words = levels[level]
        said = F.when(passes(key, level, bits, words.scalar()), said).otherwise(F.lit(level % 2 == 1))
    return said


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES, most_listed: int = 50_000_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    The longest of the rules (verdict, host/path) that fits decides; else a page is blocked
    if its host is in `listed` (key). That is asked of a cascade of Bloom filters over all
    hosts of pages, so no page is shuffled or joined, and the answer is exact. Filters are
    ten bits for each key that they hold; over `most_listed` listed hosts in the pages, the
    list is joined instead.

    Null urls, and those without ://, have an empty host and path; ids may be null or
    repeat; null keys are left out; an empty table or list is fine.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keys = listed.select("key").where(F.col("key").isNotNull()).distinct().withColumn("in_list", F.lit(True))
    universe = cut(rows.select(F.col("host").alias("key")).distinct().join(keys, "key", "left").select("key", F.coalesce("in_list", F.lit(False)).alias("listed")))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"))
    if universe.where("listed").count() > most_listed:
        rows = rows.join(universe.select(F.col("key").alias("host"), "listed"), "host")
    else:
        rows = rows.withColumn("listed", member(F.col("host"), cascade(universe)))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def mirrors(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """key: hosts of mobile mirrors (m.*) and link farms (spam*) among the pages, the list of the query."""
    host, _ = host_and_path(F.col(url_col).cast("string"))
    return pages.select(host.alias("key")).distinct().where(F.col("key").startswith("m.") | F.col("key").startswith("spam"))


ORACLE = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM a),
rules(says, rule, h, p) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
fit AS (SELECT b.host, b.path, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
        FROM (SELECT DISTINCT host, path FROM b) b JOIN rules ON (b.host = h OR ends_with(b.host, '.' || h)) AND starts_with(b.path, p) GROUP BY ALL)
SELECT page_id, b.host, b.path, rule,
       coalesce(says, CASE WHEN starts_with(b.host, 'm.') OR starts_with(b.host, 'spam') THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN fit ON b.host = fit.host AND b.path = fit.path
"""
