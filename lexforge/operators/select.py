"""Scores and selection: combination, ranking, budgets, round-robin, thresholds, weights, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, order_key
from ..plans.written import written
from .orderstats import order_statistics
from .ranks import numbered, with_sums


def require_same_keys(long: DataFrame, keys: list[str], part: str) -> None:
    """An error if some key lacks a part that others have."""
    n = long.select(part).distinct().count()
    lacking = long.groupBy(*keys).agg(F.count_distinct(part).alias("n")).filter(F.col("n") != n).count()
    if lacking:
        raise ValueError(f"{lacking} keys are not in all of the {n} inputs")


def combine_scores(long: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """long (keys, dimension, score_raw): mean of clipped scores as score_raw, and of raw ones as raw_mean. strict: an error if some key
    lacks a dimension that others have.

    Clipped scores are summed as decimals of twelve places, so keys of equal means tie in whatever order their rows come; sums of doubles
    differ in the last bit by that order.
    """
    if strict:
        require_same_keys(long, keys, "dimension")
    clipped = clip(F.col("score_raw")).cast("decimal(14,12)")
    mean = F.sum(clipped).cast("double") / F.count(clipped)
    return long.groupBy(*keys).agg(mean.alias("score_raw"), F.avg("score_raw").alias("raw_mean"), F.count("*").alias("n_dims"))


def require_scored(pool: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    out = pool.join(scores, keys, "left")
    missing = out.filter(F.col("score_raw").isNull()).count()
    if missing:
        raise ValueError(f"{missing} candidates have no score")
    return out


def rank_by_score(rows: DataFrame, by: str = "language", key: str = "doc_id", score: str = "score_raw", whole: bool = False) -> DataFrame:
    """rows with their place `rn`. For the first few of a group a window is best, which Spark cuts short in each task; whole: all places are
    needed, so large groups are dealt over several tasks."""
    order = [F.col(score).desc(), key]
    if whole:
        return numbered(rows, [by], order)
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def rank_randomly(rows: DataFrame, seed: int, by: str = "language", key: str = "doc_id", whole: bool = False) -> DataFrame:
    order = order_key(seed, F.col(by), F.col(key))
    if whole:
        return numbered(rows.withColumn("_o", order), [by], ["_o", key]).drop("_o")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(order, key)))


def top_k(ranked: DataFrame, k: int, strict: bool = False, by: str = "language") -> DataFrame:
    """The first k of each group; strict: an error if a group is smaller."""
    if strict and (short := ranked.groupBy(by).count().filter(F.col("count") < k).count()):
        raise ValueError(f"{short} groups have fewer than {k} rows")
    return ranked.filter(F.col("rn") <= k)


def token_budget(ranked: DataFrame, target: int, group: int, tokens: str = "tokens", by: str = "language", strict: bool = True) -> DataFrame:
    """Whole groups of `group` ranked rows until their tokens reach the target: a row stays if the groups before its own hold less.

    The running sum is over groups, which are summed before the window: rows are not gathered.
    """
    rows = ranked.withColumn("grp", F.floor((F.col("rn") - 1) / group))
    sums = rows.groupBy(by, "grp").agg(F.sum(tokens).alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(by).orderBy("grp").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0)))
    if strict and (short := sums.groupBy(by).agg((F.sum("_t") < target).alias("s")).filter("s").count()):
        raise ValueError(f"{short} pools hold fewer than {target} tokens")
    return rows.join(sums.filter(F.col("_before") < target).select(by, "grp"), [by, "grp"])


def round_robin(pool: DataFrame, scores: DataFrame, dims: list[str], k: int, target: int, tokens: str = "tokens", by: str = "language", strict: bool = True) -> DataFrame:
    """Each round takes the next k of every dimension's ranking, dimensions in order; a document counts where it is first picked.

    Closed form: rank r in dimension d is picked in round ceil(r / k). The first pick is the least (round, dimension, rank); tokens add
    up by the round of first picks; the first round that reaches the target is the last. A pool that runs out before is an error if strict,
    else taken whole.
    """
    ranked = numbered(scores, [by, "dimension"], [F.col("score_raw").desc(), "doc_id"], "r")
    order = F.array_position(F.array(*[F.lit(d) for d in dims]), F.col("dimension")).cast("int")
    picks = ranked.select(by, "doc_id", "dimension", F.struct(F.ceil(F.col("r") / k).cast("int").alias("round"), order.alias("dim"), F.col("r")).alias("pick"))
    docs = picks.groupBy(by, "doc_id").agg(F.min("pick").alias("first"), F.sort_array(F.collect_list(F.struct("pick.round", "pick.dim", "dimension"))).alias("all"))
    docs = written(docs.withColumn("round", F.col("first.round")).join(pool.select(by, "doc_id", tokens), [by, "doc_id"]))
    sums = docs.groupBy(by, "round").agg(F.sum(tokens).alias("_t"))
    so_far = F.sum("_t").over(Window.partitionBy(by).orderBy("round").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("_s", so_far).groupBy(by).agg(F.min(F.when(F.col("_s") >= target, F.col("round"))).alias("last"), F.max("round").alias("_all"))
    if strict and (short := ends.filter("last is null").count()):
        raise ValueError(f"{short} pools are exhausted short of {target} tokens")
    ends = ends.select(by, F.coalesce("last", "_all").alias("last"))
    kept = docs.join(ends, by).filter(F.col("round") <= F.col("last"))
    names = F.array_join(F.transform(F.filter("all", lambda p: p["round"] <= F.col("last")), lambda p: p["dimension"]), "+")
    placed = numbered(kept, [by], ["first"])
    return placed.select(by, "doc_id", tokens, "round", names.alias("selected_by"), F.element_at(F.array(*[F.lit(d) for d in dims]), F.col("first.dim")).alias("first_dimension"), "rn")


def budget_prefix(selected: DataFrame, target: int, tokens: str = "tokens", by: str = "language") -> DataFrame:
    """The rounds of a selection that a smaller budget would have taken."""
    return token_budget(selected.withColumn("rn", F.col("round")), target, 1, tokens, by, strict=False)


def threshold_table(scores: DataFrame, k: int, by: str = "language") -> DataFrame:
    """The k-th highest score, the share kept, mean, median, the 90th of 100 (by index, not interpolated) and the share above 5."""
    size = F.col("_n")
    places = {"_k": size - k + 1, "_low": F.floor((size + 1) / 2), "_high": F.ceil((size + 1) / 2), "p90": F.floor(0.9 * (size - 1)) + 1}
    found = order_statistics(scores, [by], "score_raw", places if k > 0 else {n: p for n, p in places.items() if n != "_k"})
    sums = scores.groupBy(by).agg(F.avg("score_raw").alias("mean"), F.avg((F.col("score_raw") > 5).cast("double")).alias("share_above_5"))
    out = with_sums(sums, found, [by]).withColumnRenamed("_n", "n").withColumn("median", (F.col("_low") + F.col("_high")) / 2)
    out = out.withColumn("threshold", F.col("_k") if k > 0 else F.lit(None).cast("double"))
    kept = F.when(F.col("threshold").isNotNull(), F.lit(float(k)) / F.col("n")).alias("share_kept")
    return out.select(by, "n", "threshold", "mean", "median", "p90", "share_above_5", kept)


def describe(scores: DataFrame, by: str = "language") -> DataFrame:
    """Mean, population deviation and the 5, 50 and 95 % points at place p * (n + 1), interpolated."""
    size, points = F.col("_n"), (0.05, 0.5, 0.95)
    low = lambda p: F.greatest(F.lit(1), F.least(size - 1, F.floor(F.lit(p) * (size + 1))))
    found = order_statistics(scores, [by], "score_raw", {f"_{end}{i}": low(p) + int(end == "h") for i, p in enumerate(points) for end in "lh"})
    out = with_sums(scores.groupBy(by).agg(F.avg("score_raw").alias("mean"), F.stddev_pop("score_raw").alias("sd")), found, [by])

    def point(i, p):
        a, b = F.col(f"_l{i}"), F.col(f"_h{i}")
        return F.when(size > 1, a + (b - a) * (F.lit(p) * (size + 1) - low(p))).alias(f"p{int(100 * p)}")

    return out.select(by, "mean", "sd", *[point(i, p) for i, p in enumerate(points)])


def high_quality(scores: DataFrame, fraction: float, score: str = "score_raw", by: str = "language", least: float | None = None) -> DataFrame:
    """scores with `high`: the top fraction of each group (half to even), ties by doc_id, or all at or above `least`.

    A group's lowest high score is an order statistic; only rows that have exactly it, where not all of them are high, are placed by doc_id.
    """
    if least is not None:
        return scores.withColumn("high", F.col(score) >= least)
    take = F.bround(F.col("_n") * F.lit(fraction)).cast("long")
    cuts = order_statistics(scores, [by], score, {"_cut": F.col("_n") - take + 1}).withColumn("_take", take)
    rows = with_sums(scores, cuts.select(by, "_cut", "_take"), [by])
    tied = F.col(score) == F.col("_cut")
    counts = rows.groupBy(by).agg(F.count_if(F.col(score) > F.col("_cut")).alias("_above"), F.count_if(tied).alias("_ties"))
    rows = with_sums(rows, counts, [by])
    room = F.col("_take") - F.col("_above")
    first = numbered(rows.filter(tied & (room < F.col("_ties"))).select(by, "doc_id", room.alias("_room")), [by], ["doc_id"], "_p").filter(F.col("_p") <= F.col("_room"))
    out = rows.join(first.select(F.col(by).alias("_by"), F.col("doc_id").alias("_id"), F.lit(True).alias("_first")), tied & F.col(by).eqNullSafe(F.col("_by")) & (F.col("doc_id") == F.col("_id")), "left")
    high = (F.col(score) > F.col("_cut")) | (tied & ((room >= F.col("_ties")) | F.coalesce("_first", F.lit(False))))
    return out.withColumn("high", F.coalesce(high & (F.col("_take") > 0), F.lit(False))).select(*scores.columns, "high")


def membership(rows: DataFrame, flags: dict[str, str], other: str = "other") -> DataFrame:
    """rows with `member_of`: names of the true flag columns joined by +."""
    names = F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for n, c in flags.items()]))
    return rows.withColumn("member_of", F.when(F.size(names) > 0, F.array_join(names, "+")).otherwise(other))


def normalised_weights(rows: DataFrame, weight: str, tokens: str, by: str = "language") -> DataFrame:
    """Weights rescaled so that the mean over tokens of each group is 1."""
    mean = rows.groupBy(by).agg((F.sum(F.col(tokens) * F.col(weight)) / F.sum(tokens)).alias("_m"))
    return rows.join(mean, by).withColumn(weight, F.col(weight) / F.col("_m")).drop("_m")


def selection_summary(pool: DataFrame, selected: DataFrame, target: int, by: str = "language") -> DataFrame:
    whole = pool.groupBy(by).agg(F.count("*").alias("pool_docs"), F.avg("char_len").alias("pool_mean_chars"))
    kept = selected.groupBy(by).agg(
        F.count("*").alias("docs"), F.avg("char_len").alias("mean_chars"), F.median("char_len").alias("median_chars"), F.avg("score_raw").alias("mean_score"),
        F.min("score_raw").alias("min_score"), F.sum("tokens").alias("tokens"),
    )
    return whole.join(kept, by, "left").withColumn("over_target", F.col("tokens") - target)


def inside_outside(rows: DataFrame, flag: str, score: str, by: str = "language") -> DataFrame:
    return rows.groupBy(by, flag).agg(F.count("*").alias("n"), F.min(score).alias("lowest"), F.max(score).alias("highest"), F.avg(score).alias("mean"))


def importance(rows: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """rows with a column for each set of score columns: their mean, null if any of them is missing."""
    for name, columns in sets.items():
        total = F.col(columns[0]).cast("double")
        for c in columns[1:]:
            total = total + F.col(c)
        rows = rows.withColumn(name, total / len(columns))
    return rows
