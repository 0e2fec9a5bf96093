"""Agreement, error, loss and benchmark metrics, with totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LN2, clip, score_bin
from .ranks import groups_are_small, with_mean_rank


def pearson(x, y) -> Column:
    """Null for constant input or fewer than two rows."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def spearman(df: DataFrame, x: str, y: str, by: list[str], name: str = "spearman", small: bool | None = None) -> DataFrame:
    rows = df.select(*by, x, y)
    small = groups_are_small(rows, by) if small is None else small
    ranked = with_mean_rank(with_mean_rank(rows, x, by, "_rx", small), y, by, "_ry", small)
    return ranked.groupBy(*by).agg(pearson("_rx", "_ry").alias(name))


def error_aggregates(human: Column, predicted: Column) -> list[Column]:
    error = predicted - human
    return [
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("bias"),
        F.avg((F.abs(error) <= 0.5).cast("double")).alias("within_half"),
        F.avg((F.abs(error) <= 1.0).cast("double")).alias("within_one"),
    ]


def cell_metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs (human, raw): errors on clipped predictions, the rate of raw ones outside 0 to 5, and Spearman."""
    rows = pairs.withColumn("_p", clip(F.col("raw")))
    outside = F.avg((~F.col("raw").between(0.0, 5.0)).cast("double")).alias("out_of_range")
    cells = rows.groupBy(*by).agg(*error_aggregates(F.col("human"), F.col("_p")), outside)
    return cells.join(spearman(rows, "human", "_p", by), by)


def macro_mae(cells: DataFrame) -> DataFrame:
    return cells.agg(F.avg("mae").alias("macro_mae"))


def constant_baselines(train: DataFrame, by: list[str]) -> DataFrame:
    return train.groupBy(*by).agg(F.avg("human").alias("baseline_mean"), F.median("human").alias("baseline_median"))


def score_range_cube(train: DataFrame, test: DataFrame) -> DataFrame:
    """Errors per language and score bin with totals ('All', 'ALL'); the baseline is each document's own language's training median."""
    median = train.groupBy("language").agg(F.median("human").alias("median"))
    rows = test.join(median, "language").withColumn("bin", score_bin(F.col("human")).cast("string")).withColumn("p", clip(F.col("raw")))
    error = F.col("p") - F.col("human")
    out = rows.cube("language", "bin").agg(
        F.count("*").alias("n_test"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("bias"),
        F.avg(F.abs(F.col("median") - F.col("human"))).alias("median_mae"),
        F.min("p").alias("min_pred"),
        F.max("p").alias("max_pred"),
    )
    out = out.withColumn("language", F.coalesce("language", F.lit("All"))).withColumn("bin", F.coalesce("bin", F.lit("ALL")))
    bins = train.withColumn("bin", score_bin(F.col("human")).cast("string")).cube("language", "bin").agg(F.count("*").alias("n_train"))
    bins = bins.select(F.coalesce("language", F.lit("All")).alias("language"), F.coalesce("bin", F.lit("ALL")).alias("bin"), "n_train")
    return out.join(bins, ["language", "bin"], "left").withColumn("n_train", F.coalesce("n_train", F.lit(0)))


def pooled_errors(pairs: DataFrame, dims: list[str]) -> DataFrame:
    """MAE and RMSE over the cube of dims, from the rows and so weighted by them."""
    error = clip(F.col("raw")) - F.col("human")
    out = pairs.cube(*dims).agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))
    return reduce(lambda df, d: df.withColumn(d, F.coalesce(d, F.lit("all"))), dims, out)


def rater_comparison(pairs: DataFrame, rater: str = "rater", by: str = "language") -> DataFrame:
    error = clip(F.col("raw")) - F.col("human")
    base = pairs.groupBy(rater).agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias"))
    small = groups_are_small(pairs, [rater])  # then those of rater and language are, too
    own = spearman(pairs, "human", "raw", [rater, by], small=small or None).groupBy(rater).agg(F.avg("spearman").alias("mean_spearman"))
    return base.join(spearman(pairs, "human", "raw", [rater], "pooled_spearman", small), rater).join(own, rater)


def agreement(pairs: DataFrame) -> DataFrame:
    """human and llm, both present, overall and per language."""
    rows = pairs.filter("human is not null and llm is not null")
    out = []
    for by in (["language"], []):
        one = rows if by else rows.withColumn("language", F.lit("all"))
        cells = one.groupBy("language").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("llm") - F.col("human"))).alias("mae"), pearson("human", "llm").alias("pearson"))
        out.append(cells.join(spearman(one, "human", "llm", ["language"]), "language"))
    return out[0].unionByName(out[1])


def dimension_correlations(long: DataFrame, digits: int = 4) -> DataFrame:
    """long (dimension, key, value): Spearman of every unordered pair of dimensions."""
    ranked = with_mean_rank(long, "value", ["dimension"], "r")
    a = ranked.select("key", F.col("dimension").alias("a"), F.col("r").alias("ra"))
    b = ranked.select("key", F.col("dimension").alias("b"), F.col("r").alias("rb"))
    return a.join(b, "key").filter("a < b").groupBy("a", "b").agg(F.round(pearson("ra", "rb"), digits).alias("spearman"))


def losses(sums: DataFrame) -> DataFrame:
    """sums (language, nll, targets): loss and perplexity a language, macro over languages, and weighted by tokens."""
    per = sums.groupBy("language").agg(F.sum("nll").alias("nll"), F.sum("targets").alias("targets")).filter("targets > 0")
    per = per.withColumn("loss", F.col("nll") / F.col("targets")).select("language", "loss", "targets")
    macro = per.agg(F.lit("macro").alias("language"), F.avg("loss").alias("loss"), F.sum("targets").alias("targets"))
    whole = per.agg(F.lit("token_weighted").alias("language"), F.try_divide(F.sum(F.col("loss") * F.col("targets")), F.sum("targets")).alias("loss"), F.sum("targets").alias("targets"))
    return per.unionByName(macro).unionByName(whole).withColumn("perplexity", F.exp("loss"))


def group_loss(records: DataFrame, sets: list[list[str]], dims: list[str]) -> DataFrame:
    """records (nll, targets): sum over sum for each grouping set."""
    out = records.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims])
    return out.agg(F.try_divide(F.sum("nll"), F.sum("targets")).alias("loss"), F.sum("targets").alias("targets"))


def bits_per_byte(records: DataFrame) -> DataFrame:
    per = records.groupBy("language").agg(F.sum("nll").alias("nll"), F.sum("bytes").alias("bytes"))
    per = per.withColumn("bpb", F.try_divide(F.col("nll") / F.lit(LN2), F.col("bytes"))).select("language", "bpb", "bytes")
    macro = per.agg(F.lit("macro").alias("language"), F.avg("bpb").alias("bpb"), F.sum("bytes").alias("bytes"))
    whole = per.agg(F.lit("byte_weighted").alias("language"), F.try_divide(F.sum(F.col("bpb") * F.col("bytes")), F.sum("bytes")).alias("bpb"), F.sum("bytes").alias("bytes"))
    return per.unionByName(macro).unionByName(whole)


def weighted_loss(tokens: DataFrame, by: list[str]) -> DataFrame:
    """tokens (loss, weight): sum of weighted losses over sum of weights."""
    return tokens.groupBy(*by).agg(F.try_divide(F.sum(F.col("loss") * F.col("weight")), F.sum("weight")).alias("loss"))


def histogram(rows: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal bins over min..max of all rows; the maximum is in the last."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(0))).cast("int")
    return rows.join(F.broadcast(ends)).withColumn("bin", at).groupBy("bin").agg(F.count("*").alias("n"))


def totals_by(rows: DataFrame, key: str, aggregates: list[Column], name: str = "all") -> DataFrame:
    """Aggregates per key, and a row of totals."""
    return rows.rollup(key).agg(*aggregates).withColumn(key, F.coalesce(key, F.lit(name)))


def weighted_vector_mean(chunks: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    """Mean of vectors weighted by a column, element by element."""
    flat = chunks.select(key, F.col(weight).cast("double").alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    means = flat.groupBy(key, "_i").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"))
    pairs = F.array_sort(F.collect_list(F.struct("_i", "_m")))
    return means.groupBy(key).agg(F.transform(pairs, lambda p: p["_m"]).alias("mean"))


def run_deltas(results: DataFrame, baseline: str, keys: list[str], value: str) -> DataFrame:
    """results (run, keys, value) with the difference to the baseline run."""
    base = results.filter(F.col("run") == baseline).select(*keys, F.col(value).alias("_base"))
    return results.join(base, keys, "left").withColumn("delta", F.col(value) - F.col("_base")).drop("_base")


def early_stop(log: DataFrame, patience: int, min_delta: float) -> DataFrame:
    """log (epoch, loss) with `best` (an improvement by min_delta at least), `stale` epochs since, and whether training has stopped."""
    before = F.min("loss").over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("best", before.isNull() | (F.col("loss") < before - min_delta))
    last = F.max(F.when(F.col("best"), F.col("epoch"))).over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("stale", F.col("epoch") - last)
    return rows.withColumn("stopped", F.max((F.col("stale") >= patience).cast("int")).over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)) == 1)
