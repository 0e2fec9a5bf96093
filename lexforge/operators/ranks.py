"""Places of rows within groups, where a group may be a large part of the table.

A window over a bare group sorts the whole group in one task. That is the shortest way while groups are small, which is checked: the largest
group's rows are counted first, and up to GROUP_ROWS a window numbers them. Beyond, rows are dealt by splitters that Spark samples from the
order, so that a task gets about the mean number of rows however values lie, and the partitions' counts are summed ahead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.written import written

#: Rows of a group that one task may sort.
GROUP_ROWS = 1_000_000


def same(a: DataFrame, b: DataFrame, keys: list[str], prefix: str) -> Column:
    """Null-safe equality of a's keys and b's prefixed ones."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[prefix + k]) for k in keys], F.lit(True))


def with_sums(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns that sums, one row a key, adds; null is a key like others."""
    renamed = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in sums.columns if c not in keys])
    return rows.join(renamed, same(rows, renamed, keys, "_k_")).drop(*[f"_k_{k}" for k in keys])


def groups_are_small(rows: DataFrame, by: list[str]) -> bool:
    """Whether no group has more than GROUP_ROWS rows; reads the group's columns only."""
    return rows.groupBy(*by).count().filter(F.col("count") > GROUP_ROWS).isEmpty()


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rn", total: str | None = None) -> DataFrame:
    """rows with `name`, their place (long) from 1 on within `by` in this order, and `total`, their group's rows, if asked for. The order
    must tell rows apart where the place of each matters."""
    if not groups_are_small(rows, by):
        return placed(rows, by, order, name, total)
    over = Window.partitionBy(*by)
    if total:
        rows = rows.withColumn(total, F.count("*").over(over))
    return rows.withColumn(name, F.row_number().over(over.orderBy(*order)).cast("long"))


def placed(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rn", total: str | None = None) -> DataFrame:
    """`numbered` for groups of any size, by a sample sort: rows are dealt by splitters that Spark samples from (by, order), sorted within
    their partition and written with their number there; the partitions' counts, at most one row for each partition and group, are summed
    ahead. Rows equal in the whole order meet in one task."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, *by, *order).sortWithinPartitions(*by, *order)
    # The id counts rows within their partition, whose number is in its upper bits.
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_at", 33))
    sizes = dealt.groupBy(*by, "_p").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    over = Window.partitionBy(*by)
    ahead = F.coalesce(F.sum("_n").over(over.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sizes.select(*by, "_p", (ahead - F.col("_from")).alias("_shift"), *([F.sum("_n").over(over).alias(total)] if total else []))
    out = with_sums(dealt, written(sums), [*by, "_p"])
    return out.withColumn(name, F.col("_at") + F.col("_shift") + 1).drop("_at", "_p", "_shift")


def with_mean_rank(rows: DataFrame, value: str, by: list[str], name: str, small: bool | None = None) -> DataFrame:
    """rows with `name`: the mean of the places that rows of the same value take within `by`. small: whether groups are, if that is known.

    In large groups counts of values are ranked: equal values are summed by each task before they meet, so one that very many rows have is
    no large task, and distinct ones are dealt by sampled splitters.
    """
    if groups_are_small(rows, by) if small is None else small:
        over = Window.partitionBy(*by)
        first, last = F.rank().over(over.orderBy(value)), F.count("*").over(over) + 1 - F.rank().over(over.orderBy(F.col(value).desc()))
        return rows.withColumn(name, (first + last) / F.lit(2.0))
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_c"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(counts.repartitionByRange(tasks, *by, value).withColumn("_p", F.spark_partition_id()))
    before = lambda c, over: F.coalesce(F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy(*by, "_p").agg(F.sum("_c").alias("_s"))
    sums = sums.select(*by, "_p", before("_s", Window.partitionBy(*by).orderBy("_p")).alias("_ahead"))
    own = dealt.withColumn("_own", before("_c", Window.partitionBy(*by, "_p").orderBy(value)))
    ranks = with_sums(own, sums, [*by, "_p"]).select(*by, value, (F.col("_ahead") + F.col("_own") + (F.col("_c") + 1) / F.lit(2.0)).alias(name))
    return with_sums(rows, ranks, [*by, value])
