"""Joining labels and texts: two-key matches, relabelling, coverage, gaps, key-set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash


def match_records(table: DataFrame, records: DataFrame) -> DataFrame:
    """records (file, line, id, text) with the row (language, doc_id, content) of table they belong to.

    By id; where no row has the id, by content. Of several rows with the id one must have the record's content; a single one is taken
    even if its content differs (text_matches is false then). The first file and line wins per row.
    """
    rows = table.select("language", "doc_id", "content")
    by_id = Window.partitionBy("doc_id")
    rows = rows.withColumn("_n", F.count("*").over(by_id))
    recs = records.withColumn("_c", content_hash(F.col("text")))
    same_id = recs.join(rows.withColumnRenamed("doc_id", "id"), "id").withColumn("text_matches", F.col("content") == F.col("_c"))
    told = same_id.filter("text_matches or _n = 1").withColumnRenamed("id", "doc_id")
    unknown = recs.join(rows.select(F.col("doc_id").alias("id")).distinct(), "id", "left_anti").drop("id")
    same_text = unknown.join(rows.withColumnRenamed("content", "_c").withColumn("content", F.col("_c")), "_c").withColumn("text_matches", F.lit(True))
    both = told.select("file", "line", "language", "doc_id", "content", "text_matches").unionByName(same_text.select("file", "line", "language", "doc_id", "content", "text_matches"))
    place = F.row_number().over(Window.partitionBy("doc_id", "content").orderBy("file", "line", "language"))
    return both.withColumn("_rn", place).filter("_rn = 1").drop("_rn")


def unambiguous(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")


def relabel(manifest: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """manifest (keys, split, score): train and validation take the label's score, those without one are dropped with a reason; test stays."""
    rows = manifest.join(labels.select(*keys, F.col("score").alias("_label"), F.lit(True).alias("_has")), keys, "left")
    test = F.col("split") == "test"
    reason = F.when(test, None).when(F.col("_has").isNull(), "no_record").when(F.col("_label").isNull(), "no_score")
    return rows.select(*keys, "split", F.when(test, F.col("score")).otherwise(F.col("_label")).alias("score"), reason.alias("dropped"))


def coverage(table: DataFrame, records: DataFrame, keys: list[str], by: str) -> DataFrame:
    """table against records (keys, status, text_matches) per group."""
    one = records.groupBy(*keys).agg(F.first("status").alias("status"), F.first("text_matches").alias("text_matches"))
    rows = table.join(one, keys, "left")
    return rows.groupBy(by).agg(
        F.count("*").alias("annotated"),
        F.count_if(F.col("status").isNotNull()).alias("with_record"),
        F.count_if(F.col("status") == "failed").alias("parse_failed"),
        F.count_if(F.col("text_matches") == False).alias("mismatched"),  # noqa: E712
        F.count_if(F.col("status").isNull()).alias("missing"),
    )


def gap_table(long: DataFrame, dims: list[str], floor: int, dead: DataFrame | None = None) -> DataFrame:
    """long (dimension, value): how many each of the values 0 to 5 lacks to floor, without dead bins (dimension, value)."""
    spine = long.sparkSession.createDataFrame([(d, v) for d in dims for v in range(6)], "dimension string, value int")
    rows = spine.join(long.groupBy("dimension", "value").agg(F.count("*").alias("n")), ["dimension", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if dead is not None:
        rows = rows.join(dead, ["dimension", "value"], "left_anti")
    return rows.withColumn("gap", F.greatest(F.lit(0), F.lit(floor) - F.col("n")).cast("long"))


def composition(rows: DataFrame, columns: list[str], split: Column | None = None) -> DataFrame:
    """Counts per (column, value), and of them those where split is true."""
    long = rows.withColumn("_s", F.lit(False) if split is None else split)
    long = long.select("_s", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return long.groupBy("x.name", "x.value").agg(F.count("*").alias("n"), F.count_if("_s").alias("n_in_split"))


def in_every(rows: DataFrame, value: str, part: str) -> DataFrame:
    """Values that every part has."""
    n = rows.agg(F.count_distinct(part).alias("n")).first()["n"]
    return rows.groupBy(value).agg(F.count_distinct(part).alias("_n")).filter(F.col("_n") == n).select(value)


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys in only one of two tables, counted."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full").agg(F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def positional_join(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Line by line (order is the line number in both); an error if one is longer."""
    out = a.join(b, order, "full")
    first, second = a.columns[-1], b.columns[-1]
    if out.filter(F.col(first).isNull() | F.col(second).isNull()).limit(1).count():
        raise ValueError("the two sides differ in length")
    return out
