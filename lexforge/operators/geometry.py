"""Token geometry: packed blocks, sliding windows, chunks, steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import order_key


def pack_streams(rows: DataFrame, size: int, seed: int, tokens: str = "tokens", by: str = "language", key: str = "doc_id") -> DataFrame:
    """rows with where they start in their language's stream: `begin`, first and last block.

    Documents of a language follow each other in hash order. Offsets are sums over hash buckets first, then within a bucket, so that a large
    language isn't gathered in one task.
    """
    rows = rows.withColumn("_o", order_key(seed, F.col(by), F.col(key))).withColumn("_b", F.substring("_o", 1, 3))
    sums = rows.groupBy(by, "_b").agg(F.sum(tokens).alias("_t"))
    ahead = F.coalesce(F.sum("_t").over(Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_ahead", ahead).drop("_t")
    own = F.coalesce(F.sum(tokens).over(Window.partitionBy(by, "_b").orderBy("_o", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_own", own).join(sums, [by, "_b"]).withColumn("begin", (F.col("_own") + F.col("_ahead")).cast("long"))
    rows = rows.withColumn("first_block", F.floor(F.col("begin") / size)).withColumn("last_block", F.floor((F.col("begin") + F.greatest(F.lit(1), F.col(tokens)) - 1) / size))
    return rows.drop("_o", "_b", "_own", "_ahead")


def block_stats(rows: DataFrame, size: int, tokens: str = "tokens", by: str = "language") -> DataFrame:
    """Blocks, padding and scored targets (a block's first place is not scored) per language, with totals."""
    per = rows.groupBy(by).agg(F.count("*").alias("documents"), F.sum(tokens).alias("tokens")).withColumn("blocks", F.ceil(F.col("tokens") / size))
    out = per.rollup(by).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.sum("blocks").alias("blocks"))
    out = out.withColumn(by, F.coalesce(by, F.lit("all")))
    return out.withColumn("padding", F.col("blocks") * size - F.col("tokens")).withColumn("targets", F.col("tokens") - F.col("blocks"))


def weighted_block_stats(rows: DataFrame, size: int, weight: str, tokens: str = "tokens", by: str = "language") -> DataFrame:
    """block_stats per language with the mean weight over tokens; padding has weight 0."""
    mean = rows.groupBy(by).agg((F.sum(F.col(tokens) * F.col(weight)) / F.sum(tokens)).alias("mean_weight"))
    return block_stats(rows, size, tokens, by).join(mean, by)


def explode_blocks(rows: DataFrame, size: int, ids: str, by: str = "language") -> DataFrame:
    """(language, block, ids) from packed rows (pack_streams) that carry arrays of ids."""
    flat = rows.select(by, F.col("begin"), F.posexplode(ids).alias("_i", "_id")).withColumn("_p", F.col("begin") + F.col("_i"))
    blocks = flat.groupBy(by, F.floor(F.col("_p") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("_p", "_id"))).alias("_x"))
    return blocks.select(by, "block", F.transform("_x", lambda x: x["_id"]).alias("ids"))


def sliding_windows(rows: DataFrame, size: int, stride: int, tokens: str = "tokens") -> DataFrame:
    """Windows [begin, end) of each row at the stride, and the targets [target_begin, target_end) each scores: every one but the first token once."""
    total = F.col(tokens)
    n = 1 + F.ceil(F.greatest(F.lit(0), total - size) / stride)
    wins = rows.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))))
    begin, end = F.col("window") * stride, F.least(total, F.col("window") * stride + size)
    before = F.when(F.col("window") == 0, F.lit(0).cast("long")).otherwise(F.least(total, (F.col("window") - 1) * stride + size))
    wins = wins.withColumn("begin", begin).withColumn("end", end).withColumn("target_begin", F.greatest(F.col("begin") + 1, before))
    return wins.withColumn("target_end", F.col("end")).withColumn("n_targets", F.greatest(F.lit(0), F.col("target_end") - F.col("target_begin")).cast("long"))


def chunks(rows: DataFrame, size: int, special: int = 2, tokens: str = "tokens") -> DataFrame:
    """Chunks without overlap, with room for special tokens."""
    room = size - special
    last = F.greatest(F.lit(0), F.ceil(F.col(tokens) / room) - 1).cast("long")
    out = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return out.withColumn("begin", F.col("chunk") * room).withColumn("n_tokens", F.least(F.lit(room), F.col(tokens) - F.col("chunk") * room).cast("long"))


def evaluation_schedule(runs: DataFrame, epochs: int, evaluations: int) -> DataFrame:
    """runs (steps_per_epoch, ...) with a row for each evaluation: k of `evaluations` in an epoch, at `step`, rounded half to even."""
    rows = runs.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(evaluations))))
    step = F.col("epoch") * F.col("steps_per_epoch") + F.bround(F.col("k") * F.col("steps_per_epoch") / F.lit(float(evaluations)))
    return rows.withColumn("step", step.cast("long"))


def evaluation_steps(spark, epochs: int, steps_per_epoch: int, evaluations: int) -> DataFrame:
    return evaluation_schedule(spark.range(1).select(F.lit(steps_per_epoch).alias("steps_per_epoch")), epochs, evaluations).drop("steps_per_epoch")


def fit_prompt(shots: DataFrame, limit: int, by: str = "example_id") -> DataFrame:
    """shots (example_id, place, tokens, own): the last shots that fit limit - 1 tokens beside the example's own; whole ones drop from the front."""
    tail = F.sum("tokens").over(Window.partitionBy(by).orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return shots.withColumn("_tail", tail).filter(F.col("_tail") + F.col("own") <= limit - 1).drop("_tail")
