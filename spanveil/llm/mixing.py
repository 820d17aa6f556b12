"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.base import FEW, cut, free, named, whole

log = logging.getLogger(__name__)
#: Cells and targets are matched as text; a null value is one of its own.
NULL = "\x00null"


def text_form(text: Column) -> Column:
    """The topic of a document where no better one is known: the form its text has.

    table: five or more ' | '; symbols: five or more triple marks; capitals: no lower-case
    letter but some capital; prose: everything else, an empty text too.
    """
    bars = F.length(text) - F.length(F.replace(text, F.lit(" | "), F.lit("")))
    marks = sum((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit(""))) for m in ("***", "###", "$$$", "%%%", "&&&")), F.lit(0))
    capitals = (F.upper(text) == text) & (F.lower(text) != text)
    return F.when(bars >= 15, "table").when(marks >= 15, "symbols").when(capitals, "capitals").otherwise("prose")


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """value, target: shares of the values, each raised to a power; under 1 it lifts rare ones."""
    own = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("n")).where("n > 0").select("value", F.pow("n", F.lit(power)).alias("n"))
    return own.crossJoin(F.broadcast(own.agg(F.sum("n").alias("every")))).select("value", (F.col("n") / F.col("every")).alias("target"))


def scaled(cells: DataFrame, d: str, few: bool) -> DataFrame:
    """The cells with their weights scaled to the targets of one dimension."""
    if few:
        return cells.withColumn("weight", to_target(d, F.sum("weight").over(Window.partitionBy(d))))
    totals = cells.groupBy(d).agg(F.sum("weight").alias("total"))
    return cut(cells.join(totals, d).withColumn("weight", to_target(d, F.col("total"))).drop("total"))


def to_target(d: str, total: Column) -> Column:
    return F.when(total > 0, F.col("weight") * F.col(f"target_{d}") / total).otherwise(F.lit(0.0))


def raked(cells: DataFrame, dimensions: list[str], few: bool = True, tolerance: float = 1e-9, most_rounds: int = 60, at_once: int = 3, report: dict | None = None) -> DataFrame:
    """The cells with `weight`: their share of tokens once every marginal is its target.

    cells has tokens and, for each dimension, target_<dimension>. A round scales the
    weights to the targets of one dimension after the other; rounds go on until the worst
    marginal is within the tolerance or no longer gets nearer. Cells without tokens stay at
    zero. If targets ask for more than the filled cells can give, the last dimension's are
    met and the others as nearly as rounds bring them; that is logged, and told in `report`
    (rounds, worst: the largest gap between a marginal and its target).

    Cells that one task may hold (`few`) are scaled there; otherwise marginals are
    aggregated, with partial sums where the cells lie, and joined back.
    """
    every = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumn("weight", F.col("tokens") / F.lit(float(every)) if every else F.lit(0.0))
    rounds, worst, before = 0, 0.0, float("inf")
    while rounds < most_rounds:
        for _ in range(at_once):
            for d in dimensions:
                now = scaled(now, d, few)
        now, rounds = cut(now), rounds + at_once
        off = reduce(DataFrame.unionByName, (now.groupBy(d).agg(F.sum("weight").alias("w"), F.max(f"target_{d}").alias("t")).select(F.max(F.abs(F.col("w") - F.col("t"))).alias("off")) for d in dimensions))
        worst = off.agg(F.max("off")).first()[0] or 0.0
        if worst <= tolerance or worst >= before:
            break
        before = worst
    if worst > tolerance:
        log.warning("raking ended after %d rounds with a marginal off its target by %g", rounds, worst)
    if report is not None:
        report |= {"rounds": rounds, "worst": worst}
    return now


def calibrated(cells: DataFrame, keep: float, report: dict | None = None) -> DataFrame:
    """The cells with `ratio` (weight over natural share) and `probability`.

    A document is kept with probability min(1, rate * ratio); the rate is the one at which
    the share `keep` of all tokens is expected to stay. It is found in a few sums over the
    cells: those that the rate so far would keep whole are taken out, and it rises for the
    rest, until no more are. `report` gets rate, and whole: the share of the mix in cells
    kept whole, which can't reach their target.
    """
    every = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") * F.lit(every) / F.col("tokens")).otherwise(F.lit(0.0))
    cells, rate, n = cells.withColumn("ratio", ratio), 0.0, -1
    while True:
        over = F.lit(rate) * F.col("ratio") >= 1
        sums = cells.agg(F.count_if(over & (F.col("tokens") > 0)).alias("n"), F.sum(F.when(over, F.col("tokens"))).alias("kept"), F.sum(F.when(~over, F.col("tokens") * F.col("ratio"))).alias("rest"), F.sum(F.when(over, F.col("weight"))).alias("whole"), F.max("ratio").alias("most"), F.count_if((F.col("ratio") > 0) & ~over).alias("left")).first()
        if sums.n == n or not sums.left:
            break
        n, rate = sums.n, max(rate, (keep * every - (sums.kept or 0)) / sums.rest)
    if report is not None:
        report |= {"rate": rate, "whole": sums.whole or 0.0}
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(rate) * F.col("ratio")))


def chance(id_col: str, seed: str) -> Column:
    """A number from 0 up to 1 that a document's id fixes."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(named(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


OUT = ("topic", "tokens", "weight", "probability", "kept")


def mixed(docs: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, tokens: Column | None = None, keep: float = 0.8, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", report: dict | None = None, few_cells: int = FEW) -> DataFrame:
    """docs with mix_topic, mix_tokens, mix_weight, mix_probability and mix_kept.

    Documents are counted by source, language and topic (`text_form`, where none is
    given); `tokens` is the number of tokens of a document, a quarter of its UTF-8 bytes,
    rounded up, where none is given. The weights of these cells are raked to the targets of
    each of the three: a table (value, target) in `targets`, or else the natural shares
    raised to a power (`powers`, 0.9 each). mix_weight is the weight of a document's cell
    over its natural share, and a document is kept if the number that its id fixes is under
    its probability. report: a dict that gets how near the marginals came (see `raked` and
    `calibrated`).

    Only counts by cell are shuffled. The cells (sources times languages times topics) are
    broadcast to the documents where they are few, and joined otherwise. Nulls in source
    or language are values of their own; a value without a target gets none of the mix;
    null texts are empty; ids may be null or repeat (rows with one id share their fate); an
    empty table gives an empty result. If docs has a column of one of the five names, all
    five get as many _ before them as it takes.
    """
    powers = {"source": 0.9, "lang": 0.9, "topic": 0.9} | (powers or {})
    dimensions = list(powers)
    out_topic, out_tokens, out_weight, out_probability, out_kept, cell = free(docs.columns, *(f"mix_{x}" for x in OUT), "mix_cell")
    kinds = {d: F.coalesce(named(d).cast("string"), F.lit(NULL)) for d in ("source", "lang")} | {"topic": F.coalesce(text_form(whole(text_col)) if topic is None else topic.cast("string"), F.lit(NULL))}
    size = F.ceil(F.octet_length(whole(text_col)) / 4) if tokens is None else F.coalesce(tokens, F.lit(0))
    rows = docs.withColumns({out_topic: kinds["topic"], out_tokens: size.cast("long")})
    kinds["topic"] = F.col(out_topic)
    # a hash of its own for each cell, as a key of fixed length
    rows = rows.withColumn(cell, F.xxhash64(*(kinds[d] for d in dimensions)))
    cells = cut(rows.groupBy(F.col(cell).alias("cell"), *(kinds[d].alias(d) for d in dimensions)).agg(F.sum(out_tokens).alias("tokens")))
    few = cells.count() <= few_cells
    for d in dimensions:
        own = targets[d] if targets and d in targets else tempered(cells, d, powers[d])
        own = own.select(F.coalesce(F.col("value").cast("string"), F.lit(NULL)).alias(d), F.col("target").cast("double").alias(f"target_{d}"))
        cells = cells.join(own, d, "left").withColumn(f"target_{d}", F.coalesce(f"target_{d}", F.lit(0.0)))
    cells = cut(cells.coalesce(1) if few else cells)
    told = cut(calibrated(raked(cells, dimensions, few, report=report), keep, report).select(F.col("cell").alias(cell), F.col("ratio").alias(out_weight), F.col("probability").alias(out_probability)))
    out = rows.join(F.broadcast(told) if few else told, cell)
    return out.withColumn(out_kept, chance(id_col, seed) < F.col(out_probability)).select(*map(named, docs.columns), out_topic, out_tokens, out_weight, out_probability, out_kept)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents that `mixed` keeps, with the columns of docs."""
    out = mixed(docs, **how)
    return out.where(F.col(out.columns[-1])).select(*map(named, docs.columns))


def oracle(rounds: int = 60, keep: float = 0.8, power: float = 0.9) -> str:
    """The query in SQL, with each round written out."""
    form = "CASE WHEN length(t) - length(replace(t, ' | ', '')) >= 15 THEN 'table' WHEN " + " + ".join(f"length(t) - length(replace(t, '{m}', ''))" for m in ("***", "###", "$$$", "%%%", "&&&")) + " >= 15 THEN 'symbols' WHEN upper(t) = t AND lower(t) <> t THEN 'capitals' ELSE 'prose' END"
    steps = [f"docs AS (SELECT doc_id, coalesce(source, '{{null}}') AS source, coalesce(lang, '{{null}}') AS lang, {form} AS topic, CAST(ceil(strlen(t) / 4.0) AS BIGINT) AS tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))", "cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM docs GROUP BY ALL)"]
    for d in ("source", "lang", "topic"):
        steps.append(f"t_{d} AS (SELECT {d}, n / sum(n) OVER () AS target_{d} FROM (SELECT {d}, pow(sum(tokens), {power}) AS n FROM cells GROUP BY {d} HAVING sum(tokens) > 0))")
    steps.append("w0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS weight FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    at = 0
    for _ in range(rounds):
        for d in ("source", "lang", "topic"):
            steps.append(f"w{at + 1} AS MATERIALIZED (SELECT * REPLACE (weight * target_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM w{at})")
            at += 1
    steps.append(f"r AS (SELECT *, weight * sum(tokens) OVER () / tokens AS ratio FROM w{at})")
    steps.append(f"s AS (SELECT *, ({keep} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY ratio DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(tokens * ratio) OVER (ORDER BY ratio DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate FROM r)")
    steps.append("p AS (SELECT source, lang, topic, ratio, least(1.0, (SELECT arg_max(rate, ratio) FROM s WHERE rate * ratio <= 1) * ratio) AS probability FROM s)")
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, topic, tokens, round(ratio, 6) AS weight, round(probability, 6) AS probability, CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 < probability AS kept FROM docs JOIN p USING (source, lang, topic)"
