"""First-come matching: rows, in order, each claim two keys, and a row is accepted if no accepted earlier row has either.

A row that is the first of those left by both its keys is accepted whatever comes later. Peeling such rows off takes a round for each link
of a chain of rows where each waits for the one before, so chains are contracted: a row with a single earlier row against it is accepted
exactly if that one isn't, and pointers to it are doubled, with their parity, until they reach the chain's head. Rows that several undecided
rows stand against wait for the next round, when the heads and what hangs on them are decided. A chain of n rows takes about log2(n) joins;
what counts rounds is only how deep rows with several rows against them are nested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.written import keep_until_exit, new_folder, temporary, written


def _peeled(left: DataFrame, a: str, b: str) -> DataFrame:
    """Rows that come first by both keys. Minima are aggregated before they are exchanged, so a very frequent key is no large task."""
    by_a, by_b = left.groupBy(a).agg(F.min("ordinal").alias("_a1")), left.groupBy(b).agg(F.min("ordinal").alias("_b1"))
    return left.join(by_a, a).join(by_b, b).filter("ordinal = _a1 and ordinal = _b1").select("ordinal", a, b)


def _nodes(left: DataFrame, a: str, b: str) -> DataFrame:
    """left with `against` (0, 1, or 2 for more): the rows before it by either key; and `before`, that row where it is one."""
    firsts = [left.groupBy(k).agg(F.min("ordinal").alias(f"{n}1")) for k, n in ((a, "_a"), (b, "_b"))]
    rows = written(left.join(firsts[0], a).join(firsts[1], b))
    for k, n in ((a, "_a"), (b, "_b")):
        second = rows.filter(F.col("ordinal") > F.col(f"{n}1")).groupBy(k).agg(F.min("ordinal").alias(f"{n}2"))
        rows = rows.join(second, k, "left")
        rows = rows.withColumn(n, F.when(F.col("ordinal") == F.col(f"{n}1"), 0).when(F.col("ordinal") == F.col(f"{n}2"), 1).otherwise(2))
    before = F.when(F.col("_a") + F.col("_b") == 1, F.when(F.col("_a") == 1, F.col("_a1")).otherwise(F.col("_b1")))
    return written(rows.select("ordinal", a, b, F.least(F.lit(2), F.col("_a") + F.col("_b")).alias("against"), before.alias("before")))


def _heads(chains: DataFrame) -> DataFrame:
    """(ordinal, head, odd): where the pointers (ordinal, head, odd) end, and whether by an odd number of steps."""
    moved = True
    while moved:
        on = chains.select(F.col("ordinal").alias("head"), F.col("head").alias("_next"), F.col("odd").alias("_odd"))
        step = chains.join(on, "head", "left").select(
            "ordinal", F.coalesce("_next", "head").alias("head"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"), F.col("_next").isNotNull().alias("_moved")
        )
        step = written(step)
        moved = not step.filter("_moved").isEmpty()
        chains = step.drop("_moved")
    return chains


def first_matching(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The accepted of rows (ordinal, a, b); ordinals are unique, and null is no key (the caller fills in a value for it)."""
    spark = rows.sparkSession
    path, kind = keep_until_exit(spark, new_folder(spark)), rows.select("ordinal", a, b).schema
    with temporary(spark):
        # Of rows equal in both keys only the first can be accepted.
        left = written(rows.groupBy(a, b).agg(F.min("ordinal").alias("ordinal")).select("ordinal", a, b))
        first = True
        while first or not left.isEmpty():
            if first:  # plain copies, nearly all there is in most tables, end here
                taken = _peeled(left, a, b)
            else:
                nodes = _nodes(left, a, b)
                free = nodes.filter("against = 0")
                chains = written(nodes.filter("against = 1").select("ordinal", F.col("before").alias("head"), F.lit(True).alias("odd")))
                even = _heads(chains).filter("not odd").join(free.select(F.col("ordinal").alias("head")), "head", "left_semi")
                taken = free.select("ordinal", a, b).unionByName(nodes.join(even.select("ordinal"), "ordinal", "left_semi").select("ordinal", a, b))
            taken, first = written(taken), False
            taken.write.mode("append").parquet(path)
            left = written(left.join(taken.select(a), a, "left_anti").join(taken.select(b), b, "left_anti"))
    return spark.read.schema(kind).parquet(path)
