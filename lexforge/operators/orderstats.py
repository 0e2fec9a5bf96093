"""Exact order statistics of large groups by refined histograms.

The value at a place of a group's order is found without ordering the group: rows between the lowest and the highest value are counted in
BINS equal bins, each with its own lowest and highest value; the bin that holds the place is kept and divided again, until a place's bin holds at
most FEW rows, or one value. Only counts are exchanged, which each task sums first; rows of the last bins, FEW for each place at most, are ordered
by a window. Three scans do for all but very uneven values; one more narrows the range by BINS. Null and NaN take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.written import written
from .ranks import same, with_sums

BINS, FEW = 1024, 10_000
MOST = 1.7976931348623157e308


def _inside(rows: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, _v) with each place of their group whose range holds them."""
    held = asked.select(*[F.col(k).alias(f"_k_{k}") for k in by], "place", "k", "_lo", "_hi")
    return rows.join(held, same(rows, held, by, "_k_") & F.col("_v").between(F.col("_lo"), F.col("_hi"))).drop(*[f"_k_{k}" for k in by])


def _narrowed(rows: DataFrame, asked: DataFrame, by: list[str], bins: int) -> DataFrame:
    """asked with the range of the bin that holds each place."""
    half = lambda c: F.col(c) / F.lit(2.0)  # noqa: E731  so that no difference overflows
    share = (half("_v") - half("_lo")) / (half("_hi") - half("_lo"))
    counted = _inside(rows, asked, by).withColumn("_bin", F.least(F.lit(bins - 1), F.floor(share * bins)))
    counted = counted.groupBy(*by, "place", "k", "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "place").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))  # a row a bin
    held = counted.withColumn("_upto", upto).filter((F.col("_upto") - F.col("_n") < F.col("k")) & (F.col("k") <= F.col("_upto")))
    return held.select(*by, "place", (F.col("k") - F.col("_upto") + F.col("_n")).alias("k"), "_lo", "_hi", "_n")


def at_places(rows: DataFrame, by: list[str], value: str, places: DataFrame, bins: int | None = None, few: int | None = None) -> DataFrame:
    """places (by, place, k) with `v`, the k-th lowest value of their group; those with no such value are left out."""
    bins, few = bins or BINS, few or FEW
    v = F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.col(value).cast("double")))
    rows = rows.select(*by, v.alias("_v")).filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ends = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    asked = written(with_sums(places.select(*by, "place", F.col("k").cast("long").alias("k")), ends, by).filter((F.col("k") >= 1) & (F.col("k") <= F.col("_n"))))
    large = (F.col("_n") > few) & (F.col("_lo") < F.col("_hi"))
    while not asked.filter(large).isEmpty():
        asked = written(asked.filter(~large).unionByName(_narrowed(rows, asked.filter(large), by, bins)))
    one = asked.filter("_lo = _hi").select(*by, "place", F.col("_lo").alias("v"))
    near = _inside(rows, asked.filter("_lo < _hi"), by)
    place = F.row_number().over(Window.partitionBy(*by, "place").orderBy("_v"))
    found = one.unionByName(near.withColumn("_rn", place).filter(F.col("_rn") == F.col("k")).select(*by, "place", F.col("_v").alias("v")))
    inf = F.lit(float("inf"))
    return found.withColumn("v", F.when(F.col("v") == MOST, inf).when(F.col("v") == -MOST, -inf).otherwise(F.col("v")))


def order_statistics(rows: DataFrame, by: list[str], value: str, wanted: dict[str, Column], bins: int | None = None, few: int | None = None) -> DataFrame:
    """(by, _n, one column for each name of wanted): the number of values of each group, and the values at the places that wanted gives as
    expressions of _n; null where a group has no such place."""
    sizes = rows.groupBy(*by).agg(F.count_if(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).alias("_n"))
    sizes = written(sizes)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("place"), k.cast("long").alias("k")) for n, k in wanted.items()]))
    found = at_places(rows, by, value, sizes.withColumn("_p", each).select(*by, "_p.place", "_p.k"), bins, few)
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("place") == n, F.col("v"))).alias(n) for n in wanted])
    held = wide.select(*[F.col(k).alias(f"_k_{k}") for k in by], *wanted)
    return sizes.join(held, reduce(lambda x, y: x & y, [sizes[k].eqNullSafe(held[f"_k_{k}"]) for k in by], F.lit(True)), "left").drop(*[f"_k_{k}" for k in by])
