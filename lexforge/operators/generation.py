"""Scores of generated text against references, counted pair by pair on Spark's executors: chrF (with word n-grams chrF++) and corpus BLEU."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def characters(text: Column) -> Column:
    """Characters without white space, as a string."""
    return F.regexp_replace(text, r"\s+", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _common(made: list | str | None, wanted: list | str | None, n: int) -> tuple[int, int, int]:
    """(n-grams of made, of wanted, those in common, clipped); null items are none."""

    def bag(items: list | str | None) -> Counter:
        if isinstance(items, str):
            return Counter([items[i : i + n] for i in range(len(items) - n + 1)])
        items = [] if items is None else [x for x in items if x is not None]
        return Counter(["\x1f".join(items[i : i + n]) for i in range(len(items) - n + 1)])

    a, b = bag(made), bag(wanted)
    return a.total(), b.total(), sum([min(a[g], b[g]) for g in a.keys() & b.keys()])


def matches(pairs: DataFrame, by: list[str], kinds: list[tuple[str, int, Column, Column]]) -> DataFrame:
    """(by, kind, n, made, wanted, matched): n-grams of hypotheses and references, and those in common, clipped pair by pair. Items are an
    array, or the characters of a string.

    A pair's n-grams are counted where its row is, one n at a time, and only the three sums leave: no n-gram is a row or is exchanged.
    """
    names = list(dict.fromkeys(k for k, *_ in kinds))
    items = {k: (made, wanted) for k, _, made, wanted in kinds}
    asked = [(names.index(k), n) for k, n, *_ in kinds]

    @F.pandas_udf("array<struct<made: long, wanted: long, matched: long>>")
    def counted(*columns: pd.Series) -> pd.Series:
        return pd.Series([[_common(row[2 * k], row[2 * k + 1], n) for k, n in asked] for row in zip(*columns, strict=True)])

    found = counted(*[x for k in names for x in items[k]])
    each = pairs.select(*by, F.posexplode(found).alias("_at", "x")).select(*by, "_at", "x.*")
    sums = each.groupBy(*by, "_at").agg(*[F.sum(c).alias(c) for c in ("made", "wanted", "matched")]).filter("made + wanted > 0")
    kind, n = (F.element_at(F.array(*[F.lit(x[i]) for x in kinds]), F.col("_at") + 1).alias(c) for i, c in enumerate(("kind", "n")))
    return sums.select(*by, kind, n, "made", "wanted", "matched")


def chrf(pairs: DataFrame, by: list[str], chars: int = 6, word_orders: int = 2, beta: float = 2.0) -> DataFrame:
    """pairs (hypothesis, reference): the F-score of n-gram precision and recall, averaged over the orders that occur, times 100."""
    kinds = [("c", n, characters(F.col("hypothesis")), characters(F.col("reference"))) for n in range(1, chars + 1)]
    kinds += [("w", n, words(F.col("hypothesis")), words(F.col("reference"))) for n in range(1, word_orders + 1)]
    precision, recall = F.coalesce(F.try_divide("matched", "made"), F.lit(0.0)), F.coalesce(F.try_divide("matched", "wanted"), F.lit(0.0))
    score = F.coalesce(F.try_divide((1 + beta**2) * precision * recall, beta**2 * precision + recall), F.lit(0.0))
    return matches(pairs, by, kinds).groupBy(*by).agg((100 * F.avg(score)).alias("chrf"))


def bleu(pairs: DataFrame, by: list[str], orders: int = 4) -> DataFrame:
    """pairs (hypothesis, reference: arrays of tokens): geometric mean of clipped precisions times the brevity penalty, times 100; 0 if an
    order has no match."""
    made, wanted = F.col("hypothesis"), F.col("reference")
    found = matches(pairs, by, [("t", n, made, wanted) for n in range(1, orders + 1)])
    one = F.col("n") == 1
    out = found.groupBy(*by).agg(
        F.when((F.count("*") == orders) & (F.min("matched") > 0), F.exp(F.avg(F.log(F.greatest("matched", F.lit(1e-9)) / F.greatest("made", F.lit(1)))))).otherwise(0.0).alias("_p"),
        F.max(F.when(one, F.col("made"))).alias("_m"), F.max(F.when(one, F.col("wanted"))).alias("_w"),
    )
    brevity = F.when(F.col("_m") >= F.col("_w"), 1.0).otherwise(F.coalesce(F.exp(1 - F.try_divide("_w", "_m")), F.lit(0.0)))
    return out.select(*by, (100 * F.col("_p") * brevity).alias("bleu"))
