"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.base import FEW, cut, joined


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from each node of these links to the smallest of its component, itself left out."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while len(a):
        least = np.minimum(label[a], label[b])
        # only roots are hung elsewhere: a node that left its tree would take along a link that no other holds
        for root in (label[a], label[b]):
            np.minimum.at(label, root, least)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    away = np.flatnonzero(label != np.arange(len(names)))
    return names[away], names[label[away]]


def together(batches):
    """The components of all links (a, b) of a task."""
    pairs = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([p[0] for p in pairs], [p[1] for p in pairs]))
    node, root = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["node", "root"])


def components(links: DataFrame, most_rounds: int = 60, few: int = FEW) -> DataFrame:
    """node, root: for each node of links (a, b) but the roots, one node (the root) that all nodes of its component have.

    Up to `few` links, counted, are put together by one task, in some 10 MB. More of them
    go through alternating large and small stars: each round hangs all neighbours of a node
    to the smallest of them, and ends when a round changes nothing. Nodes with many
    neighbours are broadcast with their smallest, so a hub's links are not in one task. The
    number of rounds grows with the logarithm of the number of nodes; each is written to the
    checkpoint folder. Links to itself and repeated links do no harm; nulls are left out; no
    links give an empty result.
    """
    links = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if links.count() <= few:
        return links.coalesce(1).mapInArrow(together, "node long, root long")
    state = None
    for _ in range(most_rounds):
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = joined(both, cut(least), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = joined(large, cut(least), "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(small.union(least.select("a", "m")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
