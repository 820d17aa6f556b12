"""Quality rules whose cutoffs keep a limit on false rejections."""

from __future__ import annotations

from collections import Counter
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.base import cut, whole

WINDOW = 8
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: Rules that reject a document from a cutoff on: a name, the share (numerator, denominator)
#: that is looked at, and the cutoffs, the strictest first. They are fixed before any label is seen.
RULES = (
    ("symbols", "n_symbols", "n_words", tuple(x / 20 for x in range(60, 0, -1))),
    ("repeats", "n_repeat_words", "n_words", tuple(x / 100 for x in range(30, 1, -1))),
    ("duplicate_lines", "n_dup_lines", "n_lines", tuple(x / 50 for x in range(50, 1, -1))),
    ("capitals", "n_upper", "word_chars", tuple(x / 50 for x in range(50, 4, -1))),
    ("long_words", "word_chars", "n_words", tuple(x / 4 for x in range(100, 20, -1))),
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window which the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        h = one[:n].copy()
        for k in range(1, window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, np.bool_)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    where = np.flatnonzero(hit).tolist()
    times = Counter(tuple(words[i : i + window]) for i in where)
    edges = np.zeros(len(words) + 1, np.int64)
    for i in where:
        if times[tuple(words[i : i + window])] > 1:
            edges[i] += 1
            edges[i + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def text_counts(text: str) -> tuple[int, ...]:
    """COUNTS of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    upper = np.frombuffer(data, np.uint8)
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len({*lines}),
        repeated_words(words),
        len(lines),
        int(((upper >= 65) & (upper <= 90)).sum()),
    )


def counted(docs: DataFrame, stratum: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stratum and COUNTS of each row."""

    def run(batches):
        for batch in batches:
            rows = [text_counts(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(COUNTS)))], ["doc_id", "stratum", *COUNTS])

    schema = "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), stratum.cast("string").alias("stratum"), whole(text_col).alias("text")).mapInArrow(run, schema)


def log_tail(k: int, n: int, p: float) -> float:
    """Log of the chance of at most k successes in n at probability p."""
    if k >= n:
        return 0.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p) for i in range(k + 1)]
    top = max(terms)
    return top + log(sum(exp(t - top) for t in terms))


def safe(rejected: int, good: int, most: float, doubt: float) -> bool:
    """The exact upper bound, at confidence 1 - doubt, of the share of good documents rejected is at most `most`."""
    if not good or rejected >= most * good:
        return False
    return log_tail(rejected, good, most) <= log(doubt)


def in_one_sequence() -> list[tuple[int, int]]:
    """Steps (rule, place of the cutoff) of one fixed sequence: each rule to the middle of its cutoffs, then each to its end."""
    half = [len(cutoffs) // 2 for _, _, _, cutoffs in RULES]
    return [(r, i) for r, h in enumerate(half) for i in range(h)] + [(r, i) for r, h in enumerate(half) for i in range(h, len(RULES[r][3]))]


def chosen_cutoffs(good: dict[str, int], rejected: dict[tuple[str, int, int], int], most: float, doubt: float) -> dict[tuple[str, int], float]:
    """By (stratum, rule): the lowest cutoff that is safe with all above it.

    good: good documents by stratum. rejected: of these, how many each (stratum, rule,
    place of the cutoff) would reject. With probability 1 - doubt all rules together
    reject at most `most` of the good documents of every stratum.

    The doubt is divided by the number of strata and rules. Where a stratum has labels
    enough, the share is divided by that of rules; cutoffs of a rule are tried in their
    fixed order until one fails, which needs no correction. A smaller stratum, which its
    number of labels alone decides, goes through one fixed sequence of all rules at the
    whole share until a step fails; documents that several rules reject count for each.
    """
    found = {}
    own = doubt / (len(good) * len(RULES)) if good else doubt
    for stratum, n in good.items():
        if safe(0, n, most / len(RULES), own):
            for r, (_, _, _, cutoffs) in enumerate(RULES):
                for i, cutoff in enumerate(cutoffs):
                    if not safe(rejected.get((stratum, r, i), 0), n, most / len(RULES), own):
                        break
                    found[stratum, r] = cutoff
            continue
        so_far = [0] * len(RULES)
        for r, i in in_one_sequence():
            so_far[r] = rejected.get((stratum, r, i), 0)
            if not safe(sum(so_far), n, most, own):
                break
            found[stratum, r] = RULES[r][3][i]
    return found


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def share(rule: int) -> Column:
    _, over, under, _ = RULES[rule]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def reached(rule: int) -> Column:
    """At how many of its cutoffs the rule would reject the document."""
    own = share(rule)
    return F.size(F.filter(F.array(*map(F.lit, RULES[rule][3])), lambda cutoff: own >= cutoff))


def quality(docs: DataFrame, labels: DataFrame, most: float = 0.03, doubt: float = 0.05, stratum: Column | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule.

    base_failed: under 20 words, or over 30 % of the words in repeated windows of 8. Other
    documents are kept unless a rule of their stratum (the language, where none is given)
    rejects them. Its cutoffs come from the labelled documents that pass the base: see
    `chosen_cutoffs`; a stratum with too few labels for any cutoff rejects nothing.
    The driver gets counts by stratum, rule and cutoff, of strata with labels enough.

    Null texts have no words. Null strata are one stratum; null labels are left out; of a
    document labelled twice, each label counts. Ids may be null (never labelled) or repeat.
    An empty table gives an empty result.
    """
    rows = cut(counted(docs, F.col("lang") if stratum is None else stratum))
    rows = rows.withColumn("stratum", F.coalesce("stratum", F.lit("")))
    good = rows.where(~base_failed()).join(labels.where(F.col("quality") == 1).select("doc_id"), "doc_id")
    places = [F.lit(0), *map(reached, range(len(RULES)))]
    # at how many cutoffs, counted from the lowest up, each good document would be rejected
    least = int(log(doubt / len(RULES)) / log(1 - most))
    by = good.select("stratum", F.explode(F.array(*(F.struct(F.lit(r - 1).alias("rule"), p.alias("level")) for r, p in enumerate(places)))).alias("x")).groupBy("stratum", "x.rule", "x.level").count()
    enough = by.where(F.col("rule") == -1).where(F.col("count") >= least).select("stratum")
    known = by.join(enough, "stratum").collect()
    n_good = {x.stratum: x["count"] for x in known if x.rule == -1}
    rejected: Counter = Counter()
    for x in known:
        for i in range(len(RULES[x.rule][3]) - x.level if x.rule >= 0 else 0, len(RULES[x.rule][3]) if x.rule >= 0 else 0):
            rejected[x.stratum, x.rule, i] += x["count"]
    cutoffs = chosen_cutoffs(n_good, rejected, most, doubt)
    table = docs.sparkSession.createDataFrame([(s, [cutoffs.get((s, r)) for r in range(len(RULES))]) for s in n_good], "stratum string, cutoffs array<double>")
    fails = F.array_compact(F.array(*(F.when(share(r) >= F.col("cutoffs")[r], F.lit(RULES[r][0])) for r in range(len(RULES)))))
    judged = rows.join(F.broadcast(table), "stratum", "left").withColumn("failed_rule", F.get(fails, F.lit(0)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & F.col("failed_rule").isNull()).alias("kept"), "failed_rule")
