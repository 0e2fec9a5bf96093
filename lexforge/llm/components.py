"""Connected components of a link table, by alternating large-star and small-star steps; nothing is gathered on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links a[i]-b[i] form a spanning forest: the links of one block without those that add nothing."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            keep[i] = True
    return keep


def _smaller(links: DataFrame) -> DataFrame:
    return links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(scratch: Scratch, links: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) of every node in links (a, b: long); root is the smallest node of its component."""
    links, last, turn = scratch.save(_smaller(links), f"{name}0"), None, 0
    while True:
        mark = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last or not mark[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = _smaller(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        turn += 1
        links = scratch.save(_smaller(small), f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
        last = mark
