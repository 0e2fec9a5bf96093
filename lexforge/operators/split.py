"""Splits: allocation, stratified, website-disjoint, relabelling checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import order_key, score_bin, strip, text_hash
from .ranks import numbered

RATIOS = (("train", 0.7), ("validation", 0.1), ("test", 0.2))


def largest_remainder(counts: DataFrame, ratios: tuple[tuple[str, float], ...] = RATIOS, n: str = "n") -> DataFrame:
    """counts with one row a split: its whole share, plus one for the largest remainders, ties in declared order."""
    splits = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("split"), F.lit(r).cast("double").alias("r")) for i, (s, r) in enumerate(ratios)])
    rows = counts.withColumn("_s", F.explode(splits)).select(*counts.columns, "_s.i", "_s.split", (F.col(n) * F.col("_s.r")).alias("_raw"))
    rows = rows.withColumn("_f", F.floor("_raw"))
    over = Window.partitionBy(*counts.columns)
    place = F.row_number().over(over.orderBy((F.col("_raw") - F.col("_f")).desc(), "i"))
    return rows.withColumn("take", F.col("_f") + (place <= F.col(n) - F.sum("_f").over(over)).cast("int")).select(*counts.columns, "i", "split", "take")


def duplicate_groups(rows: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    group = F.when(F.coalesce(strip(F.col(text)), F.lit("")) == "", F.concat(F.lit("empty_"), F.col(key).cast("string")))
    return rows.withColumn("group_id", group.otherwise(F.concat(F.lit("dup_"), F.substring(text_hash(F.col(text)), 1, 16))))


def stratified_split(rows: DataFrame, seed: int, salt: str, ratios: tuple[tuple[str, float], ...] = RATIOS) -> DataFrame:
    """rows (language, group_id, score): groups keep together; per language and bin of their mean score they are dealt in hash order."""
    groups = rows.groupBy("language", "group_id").agg(score_bin(F.avg("score")).alias("bin"))
    groups = groups.withColumn("_o", order_key(seed, salt, F.col("group_id")))
    groups = numbered(groups, ["language", "bin"], ["_o", "group_id"], "_rn")
    shares = largest_remainder(groups.groupBy("language", "bin").agg(F.count("*").alias("n")), ratios)
    end = F.sum("take").over(Window.partitionBy("language", "bin").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    shares = shares.withColumn("_end", end).withColumn("_begin", F.col("_end") - F.col("take")).select("language", "bin", "split", "_begin", "_end")
    dealt = groups.join(shares, ["language", "bin"]).filter((F.col("_rn") > F.col("_begin")) & (F.col("_rn") <= F.col("_end")))
    return rows.join(dealt.select("language", "group_id", "bin", "split"), ["language", "group_id"])


def validation_split(rows: DataFrame, fraction: float, seed: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """rows with `split`: of each integer score round(n * fraction), half to even, at least one of two or more, to validation."""
    rows = rows.withColumn("_s", F.floor(score)).withColumn("_o", order_key(seed, F.floor(score), F.col(key)))
    rows = numbered(rows, ["_s"], ["_o", key], "_place", "_n")
    take = F.greatest(F.bround(F.col("_n") * F.lit(fraction)).cast("long"), F.when(F.col("_n") >= 2, 1).otherwise(0))
    return rows.withColumn("split", F.when(F.col("_place") <= take, "validation").otherwise("train")).drop("_s", "_n", "_o", "_place")


def website_split(docs: DataFrame, test: int, validation: int, seed: int, largest: int = 10, by: str = "language") -> DataFrame:
    """docs (language, domain, ...) with `split`: whole sites fill test, then validation, exactly; the rest is train.

    Sites up to `largest` documents are walked in hash order, one that is larger than what remains is skipped. The walk is sequential,
    but over one row a site; an exact fill that fails is an error.
    """
    sites = docs.groupBy(by, "domain").agg(F.count("*").cast("int").alias("n")).filter(F.col("n") <= largest)
    sites = sites.withColumn("o", order_key(seed, F.col(by), F.col("domain")))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["o", "domain"])
        held, out = {}, []
        for split, size in (("test", test), ("validation", validation)):
            left = size
            for r in group.itertuples(index=False):
                if left and r.domain not in held and r.n <= left:
                    held[r.domain] = split
                    left -= r.n
            if left:
                raise ValueError(f"{split} lacks {left} documents that whole sites can fill")
        for r in group.itertuples(index=False):
            if r.domain in held:
                out.append((getattr(r, by), r.domain, held[r.domain]))
        return pd.DataFrame(out, columns=[by, "domain", "split"])

    chosen = sites.groupBy(by).applyInPandas(fill, f"{by} string, domain string, split string")
    return docs.join(chosen, [by, "domain"], "left").withColumn("split", F.coalesce("split", F.lit("train")))


def keep_evaluation(docs: DataFrame, kept: DataFrame, by: str = "language") -> DataFrame:
    """docs with `split`: kept (language, doc_id, split) stays; other documents of its sites are excluded; the rest is train."""
    old = kept.select(by, "doc_id", F.col("split").alias("_old"))
    if missing := old.join(docs, [by, "doc_id"], "left_anti").count():
        raise ValueError(f"{missing} kept documents are gone")
    rows = docs.join(old, [by, "doc_id"], "left")
    sites = rows.filter("_old is not null").select(by, "domain", F.lit(True).alias("_site")).distinct()
    rows = rows.join(sites, [by, "domain"], "left")
    return rows.withColumn("split", F.coalesce("_old", F.when(F.col("_site"), "excluded"), F.lit("train"))).drop("_old", "_site")


def split_report(rows: DataFrame, by: str = "language") -> DataFrame:
    sites = rows.groupBy(by, "split", "domain").agg(F.count("*").alias("_n"))
    largest = sites.groupBy(by, "split").agg(F.count("*").alias("sites"), F.max("_n").alias("largest_site"))
    return rows.groupBy(by, "split").agg(F.count("*").alias("docs"), F.median("char_len").alias("median_chars")).join(largest, [by, "split"])


def crossing_sites(rows: DataFrame, by: str = "language") -> DataFrame:
    return rows.groupBy(by, "domain").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def consistency_errors(manifest: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows where a manifest (keys, score, split) and a document table disagree; empty if they are consistent."""
    other = table.select(*keys, F.col("score").alias("_score"), F.col("split").alias("_split"))
    rows = manifest.join(other, keys, "left")
    problem = (
        F.when(F.col("_split").isNull(), "missing")
        .when(F.col("_split") != F.col("split"), "split")
        .when(~F.col("_score").eqNullSafe(F.col("score")), "score")
        .when(~F.col("score").between(0.0, 5.0), "range")
    )
    return rows.withColumn("problem", problem).filter("problem is not null").select(*keys, "problem")
