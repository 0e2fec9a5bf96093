"""Restrictions, lookups and report tables over corpus, manifests and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_splits(rows: DataFrame, manifest: DataFrame, splits: list[str], keys: list[str]) -> DataFrame:
    return rows.join(manifest.filter(F.col("split").isin(splits)).select(*keys).distinct(), keys, "left_semi")


def first_n(rows: DataFrame, n: int, by: str, order: str) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_rn") <= n).drop("_rn")


def join_counting_missing(rows: DataFrame, other: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their partner, one row with the number of rows that have none)."""
    return rows.join(other, keys), rows.join(other.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("missing"))


def exclude(rows: DataFrame, ids: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows whose id and whose text_hash are in neither list."""
    return rows.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").join(hashes.select("text_hash").distinct(), "text_hash", "left_anti")


def in_all(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that every table has."""
    out = frames[0].select(*keys)
    for f in frames[1:]:
        out = out.intersect(f.select(*keys))
    return out.distinct()


def aligned_pairs(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of parallel rows; an error if one side lacks a partner."""
    if n := target.join(source, keys, "left_anti").count() + source.join(target, keys, "left_anti").count():
        raise ValueError(f"{n} rows have no partner")
    return target.join(source, keys)


def complete_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.na.drop(subset=columns)


def corpus_summary(rows: DataFrame, by: str = "language") -> DataFrame:
    return rows.groupBy(by).agg(
        F.count("*").alias("docs"), F.min("char_len").alias("min_chars"), F.median("char_len").alias("median_chars"), F.avg("char_len").alias("mean_chars"), F.max("char_len").alias("max_chars"),
    )


def quality_report(long: DataFrame, by: list[str]) -> DataFrame:
    """long (by, reason, value, split): valid and excluded rows, rows of each split, mean and population deviation."""
    valid = F.col("reason").isNull()
    splits = [F.count_if(valid & (F.col("split") == s)).alias(f"n_{s}") for s in ("train", "validation", "test")]
    value = F.when(valid, F.col("value"))
    return long.groupBy(*by).agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("excluded"), *splits, F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def f1_scores(rows: DataFrame, by: str) -> DataFrame:
    """rows (gold, predicted): macro and support-weighted F1 over labels that occur as gold or prediction."""
    both = F.explode(F.array_distinct(F.array("gold", "predicted"))).alias("label")
    one = rows.select(by, "gold", "predicted", both)
    gold, predicted = F.col("gold") == F.col("label"), F.col("predicted") == F.col("label")
    per = one.groupBy(by, "label").agg(F.count_if(gold & predicted).alias("tp"), F.count_if(gold).alias("n"), F.count_if(predicted).alias("p"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("n") + F.col("p")), F.lit(0.0))
    return per.withColumn("f1", f1).groupBy(by).agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("n")) / F.sum("n")).alias("weighted_f1"))


def log_rows(results: DataFrame, values: list[str], fixed: dict[str, object]) -> DataFrame:
    """A result table (language, values) as long rows (fixed, language, metric, value)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]))
    return results.select(*[F.lit(x).alias(k) for k, x in fixed.items()], "language", pairs.alias("x")).select(*fixed, "language", "x.metric", "x.value")


def compare_runs(results: DataFrame, value: str) -> DataFrame:
    """results (run_no, run, tokenizer, language, value): the difference to the first run, and whether the tokenizer is its own."""
    over = Window.partitionBy("language").orderBy("run_no")
    first = lambda c: F.first(c).over(over.rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("same_tokenizer", F.col("tokenizer") == first("tokenizer")).withColumn("delta", F.col(value) - first(value))


def expand_suites(asked: DataFrame, suites: DataFrame) -> DataFrame:
    """asked (place, name) with suites (suite, position, benchmark) replaced by their members; each benchmark once, where it first comes."""
    rows = asked.join(suites, asked["name"] == suites["suite"], "left")
    rows = rows.select("place", F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("benchmark", "name").alias("benchmark"))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("benchmark").orderBy("place", "position"))).filter("_rn = 1")
    return rows.select("place", "position", "benchmark")


def text_measures(text: Column) -> list[Column]:
    """Code points, bytes and words."""
    return [F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("words")]


def truncated(rows: DataFrame, ids: str, most: int) -> DataFrame:
    """rows with ids cut to `most` and `at_limit`, whether they reached it."""
    return rows.withColumn("at_limit", F.size(ids) >= most).withColumn(ids, F.slice(ids, 1, most))
