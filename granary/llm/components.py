"""Connected components of links, by contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import remove, stored


def roots_of(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place reachable from each of ``n`` places over the pairs ``(i, j)``; whole-array steps only."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        i, j = i[apart], j[apart]
        a, b = a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewer than ``n`` pairs with the components of the given ones: each place with its root."""
    root = roots_of(i, j, n)
    some = np.flatnonzero(root != np.arange(n))
    return some, root[some]


def components(edges: DataFrame) -> tuple[DataFrame, str | None]:
    """``node, component`` (the smallest node reachable) for each node of ``edges(src, dst)``, and the folder it was written to.

    Each round points every node at its smallest neighbour, follows the pointers
    to their ends and relabels the edges; a component's nodes at least halve, so
    the rounds grow with the logarithm of its size. Every round is written to the
    shared folder. Minima are partial aggregates and nodes' pointers are unique, so
    a node with very many links is summed up where its links are read, and its joins
    can be split.
    """
    spark = edges.sparkSession
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = stored(df, name)
        paths.append(path)
        return out

    left = keep(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "links")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        up = keep(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("up")).withColumnRenamed("src", "node"), "pointers")
        while True:  # pointers only go down, so they end at a node that points at itself
            parent = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            up = keep(up.join(parent, "up", "left").select("node", F.coalesce("next", "up").alias("up"), (F.coalesce("next", "up") != F.col("up")).alias("moved")), "pointers")
            moved = not up.where("moved").isEmpty()
            up = up.select("node", "up")
            if not moved:
                break
        steps.append(up)
        new = left.join(up.select(F.col("node").alias("src"), F.col("up").alias("a")), "src").join(up.select(F.col("node").alias("dst"), F.col("up").alias("b")), "dst")
        left = keep(new.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "links")
    if not steps:
        remove(spark, *paths)
        return spark.createDataFrame([], "node long, component long"), None
    found = steps[0].select("node", F.col("up").alias("component"))
    for up in steps[1:]:
        found = found.join(up.select(F.col("node").alias("component"), F.col("up").alias("next")), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    result, at = stored(found, "components")
    remove(spark, *paths)
    return result, at
