"""Benchmark shaping and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def majority_baseline(rows: DataFrame, by: str, label: str) -> DataFrame:
    return rows.groupBy(by, label).agg(F.count("*").alias("_n")).groupBy(by).agg((F.max("_n") / F.sum("_n")).alias("majority"))


def benchmark_macro(rows: DataFrame, core: list[str]) -> DataFrame:
    """rows (benchmark, language, score): mean over languages of each benchmark, and overall over the core ones."""
    per = rows.groupBy("benchmark").agg(F.avg("score").alias("score"))
    return per.unionByName(per.filter(F.col("benchmark").isin(core)).agg(F.lit("overall").alias("benchmark"), F.avg("score").alias("score")))


def breakdown(rows: DataFrame, columns: list[str], metric: str) -> DataFrame:
    """metric per value of each column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(F.col(metric).cast("double").alias("_m"), pairs.alias("x")).groupBy("x.name", "x.value").agg(F.count("*").alias("n"), F.avg("_m").alias("mean"))


def rescored(rows: DataFrame, subset: DataFrame, key: str, by: list[str], metric: str) -> DataFrame:
    """Mean and standard error of a fixed subset."""
    kept = rows.join(subset.select(key).distinct(), key, "left_semi")
    return kept.groupBy(*by).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), (F.stddev_samp(metric) / F.sqrt(F.count("*"))).alias("stderr"))


def pooled(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (score, n) of sub-benchmarks: item-weighted score."""
    return rows.groupBy(*by).agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score"), F.sum("n").alias("n"))


def common_to_all(rows: DataFrame, run: str, benchmark: str) -> DataFrame:
    """benchmark and whether every run has it."""
    runs = rows.agg(F.count_distinct(run).alias("_r"))  # one row
    return rows.groupBy(benchmark).agg(F.count_distinct(run).alias("n_runs")).join(F.broadcast(runs)).withColumn("common", F.col("n_runs") == F.col("_r")).drop("_r")


def first_folder_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_rn = 1").drop("_rn")


def configured_task(tasks: DataFrame, configured: DataFrame) -> DataFrame:
    """tasks (task) with the first configured (name, place) it equals or begins with, followed by _. Names are cut at each _ and joined by equality."""
    parts = F.split("task", "_")
    stems = tasks.select("task", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))).alias("name"))
    found = stems.join(configured, "name").withColumn("_rn", F.row_number().over(Window.partitionBy("task").orderBy("place"))).filter("_rn = 1")
    return tasks.join(found.select("task", F.col("name").alias("configured")), "task", "left")


def leaf_tasks(spark, groups: DataFrame, root: str) -> DataFrame:
    """Leaves below root of groups (parent, child), in a recursive query; a null parent is nobody's."""
    return spark.sql(
        """WITH RECURSIVE walk(task, depth) AS (
             SELECT :root, 0 UNION ALL SELECT g.child, depth + 1 FROM walk JOIN {groups} g ON g.parent = walk.task)
           SELECT DISTINCT task FROM walk WHERE NOT EXISTS (SELECT 1 FROM {groups} g WHERE g.parent = walk.task)""",
        {"root": root},
        groups=groups,
    )


def unique_names(entries: DataFrame) -> DataFrame:
    """entries (parent, name): names that collide get their parent in front."""
    same = F.count("*").over(Window.partitionBy("name"))
    return entries.withColumn("unique_name", F.when(same > 1, F.concat_ws("/", "parent", "name")).otherwise(F.col("name")))


def flat_metrics(rows: DataFrame, raw: str = "results") -> DataFrame:
    """(task, metric, value) of nested JSON {task: {metric: number}}."""
    nested = F.from_json(F.col(raw), "map<string, map<string, double>>")
    tasks = rows.select(F.explode(nested).alias("task", "_m"))
    return tasks.select("task", F.explode("_m").alias("metric", "value"))


def chosen(choices: DataFrame, by: list[str]) -> DataFrame:
    """choices (by, choice, loglik, gold): the choice of largest likelihood, the first of equals, and whether it is the gold one."""
    best = F.max_by("choice", F.struct("loglik", -F.col("choice")))
    return choices.groupBy(*by).agg(best.alias("choice"), F.max("gold").alias("gold")).withColumn("correct", F.col("choice") == F.col("gold"))
