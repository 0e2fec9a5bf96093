"""Corpus extraction: ordered filter with first-failing reason, exact sequential two-key dedup, leakage filter, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, has_any_word, strip, text_hash
from ..plans.written import written
from .matching import first_matching
from .ranks import placed


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter("_rn = 1").drop("_rn")


def in_window(text: Column, low: int = 500, high: int = 4000) -> Column:
    return F.length(text).between(low, high)


def sequential_dedup(rows: DataFrame) -> DataFrame:
    """(ordinal, reason): duplicate_id or duplicate_text if an accepted earlier row has the id or the text, else null. Null is a value like
    others. See `matching` for the rounds it takes."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c)
    rows = rows.select("ordinal", own("doc_id"), own("text_hash"))
    accepted = first_matching(rows, "doc_id", "text_hash")
    by_id = accepted.select("doc_id", F.col("ordinal").alias("id_first"))
    by_text = accepted.select("text_hash", F.col("ordinal").alias("text_first"))
    told = rows.join(by_id, "doc_id", "left").join(by_text, "text_hash", "left")
    reason = F.when(F.col("id_first") < F.col("ordinal"), "duplicate_id").when(F.col("text_first") < F.col("ordinal"), "duplicate_text")
    return told.select("ordinal", reason.alias("reason"))


def prepared(stream: DataFrame, banned: list[str], low: int = 500, high: int = 4000) -> DataFrame:
    """stream with its stripped text, its hash, and whether it `fits` the length window and is `adult`; texts are read here and not again."""
    whole = stream.withColumn("text", strip(F.col("text"))).withColumn("text_hash", text_hash(F.col("text")))
    adult = has_any_word(F.col("text"), banned) if banned else F.lit(False)
    return whole.withColumn("fits", F.coalesce(in_window(F.col("text"), low, high), F.lit(False))).withColumn("adult", F.coalesce(adult, F.lit(False)))


def reasons(rows: DataFrame, *, exclude_ids: DataFrame, exclude_hashes: DataFrame, seen_ids: DataFrame | None = None, seen_hashes: DataFrame | None = None) -> DataFrame:
    """(ordinal, reason) of rows (ordinal, doc_id, text_hash, fits, adult): the first of length, overlap_id, overlap_text, duplicate_id,
    duplicate_text, adult that holds, or kept. A row is a duplicate if an accepted earlier one, or one that was seen before these rows, has
    its id or text."""
    known = [
        (exclude_ids.select("doc_id"), "doc_id", "_id"), (exclude_hashes.select("text_hash"), "text_hash", "_hash"),
        (seen_ids, "doc_id", "_seen_id"), (seen_hashes, "text_hash", "_seen_hash"),
    ]
    for table, key, name in known:
        if table is None:
            rows = rows.withColumn(name, F.lit(None).cast("boolean"))
        else:
            rows = with_flag(rows, table, key, name)
    early = F.when(~F.col("fits"), "length").when(F.col("_id"), "overlap_id").when(F.col("_hash"), "overlap_text")
    rows = written(rows.select("ordinal", "doc_id", "text_hash", "adult", early.alias("early"), "_seen_id", "_seen_hash"))
    # An adult row is tested against accepted earlier rows first, and never blocks a later one; nor does one that was seen.
    new = rows.filter("early is null and not adult and _seen_id is null and _seen_hash is null")
    clean = rows.join(sequential_dedup(new).filter("reason is null"), "ordinal", "left_semi")
    by_id = clean.groupBy("doc_id").agg(F.min("ordinal").alias("_oi")).withColumnRenamed("doc_id", "_k")
    by_text = clean.groupBy("text_hash").agg(F.min("ordinal").alias("_ot"))
    told = rows.join(by_id, F.col("doc_id").eqNullSafe(F.col("_k")), "left").join(by_text, "text_hash", "left")
    reason = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("_seen_id") | (F.col("_oi") < F.col("ordinal")), "duplicate_id")
        .when(F.col("_seen_hash") | (F.col("_ot") < F.col("ordinal")), "duplicate_text")
        .when(F.col("adult"), "adult")
        .otherwise("kept")
    )
    return told.select("ordinal", reason.alias("reason"))


def with_flag(rows: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """rows with `name`: true where keys holds their key, else null."""
    marks = keys.select(F.col(key).alias("_mark"), F.lit(True).alias(name)).distinct()
    return rows.join(marks, F.col(key).eqNullSafe(F.col("_mark")), "left").drop("_mark")


def up_to_target(told: DataFrame, target: int) -> tuple[DataFrame, bool]:
    """(told up to the row that fills the target, whether the target wasn't reached)."""
    kept = told.filter("reason = 'kept'")
    # The target-th kept row: top-k by ordinal, no global window.
    if kept.count() < target:
        return told, True
    stop = kept.orderBy("ordinal").limit(target).agg(F.max("ordinal")).first()[0] if target > 0 else None
    return (told.filter("false") if stop is None else told.filter(F.col("ordinal") <= stop)), False


def collect_documents(
    stream: DataFrame, *, target: int, exclude_ids: DataFrame, exclude_hashes: DataFrame, banned: list[str], low: int = 500, high: int = 4000
) -> tuple[DataFrame, DataFrame]:
    """(kept rows, counters by reason) of a stream (ordinal, doc_id, text), with the reasons of `reasons`; the stream stops at the row that
    fills the target, and counters cover rows up to there."""
    whole = prepared(stream, banned, low, high)
    told = written(reasons(whole.select("ordinal", "doc_id", "text_hash", "fits", "adult"), exclude_ids=exclude_ids, exclude_hashes=exclude_hashes))
    read, exhausted = up_to_target(told, target)
    counters = read.groupBy("reason").agg(F.count("*").alias("n")).withColumn("stream_exhausted", F.lit(exhausted))
    return whole.join(read.filter("reason = 'kept'").select("ordinal"), "ordinal", "left_semi").select(*stream.columns, "text_hash"), counters


def hashed(docs: DataFrame) -> DataFrame:
    """(ordinal, doc_id, content, empty) of docs, written: texts are read for their hash once and then left."""
    empty = F.coalesce(strip(F.col("text")), F.lit("")) == ""
    return written(docs.select("ordinal", "doc_id", content_hash(F.col("text")).alias("content"), empty.alias("empty")))


def leakage_filter(docs: DataFrame, *, human: DataFrame, pilot: DataFrame) -> DataFrame:
    """docs (doc_id, text, ordinal) with `reason`, as leakage_reasons tells it. human: (doc_id, content); pilot: (content)."""
    return docs.join(leakage_reasons(hashed(docs), human=human, pilot=pilot), "ordinal").select(*docs.columns, "reason")


def leakage_reasons(rows: DataFrame, *, human: DataFrame, pilot: DataFrame) -> DataFrame:
    """(ordinal, reason) of rows (ordinal, doc_id, content, empty): empty, human, pilot, duplicate or null (kept)."""
    # Places are counted by a minimum, which is aggregated before it is exchanged, so a content that very many documents share is no large task.
    ids = human.select("doc_id", F.lit(True).alias("_h1")).distinct()
    contents = human.select("content", F.lit(True).alias("_h2")).distinct()
    pilots = pilot.select("content", F.lit(True).alias("_p")).distinct()
    rows = rows.join(ids, "doc_id", "left").join(contents, "content", "left").join(pilots, "content", "left")
    early = F.when(F.col("empty"), "empty").when(F.coalesce("_h1", "_h2"), "human").when(F.col("_p"), "pilot")
    rows = written(rows.select("ordinal", "content", early.alias("early")))
    first = rows.filter("early is null").groupBy("content").agg(F.min("ordinal").alias("_first"))
    return rows.join(first, "content", "left").select("ordinal", F.coalesce("early", F.when(F.col("ordinal") != F.col("_first"), "duplicate")).alias("reason"))


def union_keep_first(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """Sources in order of precedence, one row a key."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return keep_first(out, [key], ["_source", order]).drop("_source")


def quota_top_up(first: DataFrame, second: DataFrame, target: int, order: str) -> DataFrame:
    """Up to target rows of first by order; what is missing comes from second."""
    have = first.orderBy(order).limit(target)
    return have.unionByName(second.orderBy(order).limit(max(0, target - have.count())))


def overlap_report(rows: DataFrame, ids: DataFrame, hashes: DataFrame, low: int = 500, high: int = 4000) -> DataFrame:
    """One row of counts that must all be zero: repeated ids, repeated texts, overlap with ids and hashes, texts out of the window."""
    base = rows.agg(
        (F.count("*") - F.count_distinct("doc_id")).alias("repeated_ids"),
        (F.count("*") - F.count_distinct("text_hash")).alias("repeated_texts"),
        F.count_if(~in_window(F.col("text"), low, high)).alias("outside_window"),
    )
    a = rows.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count("*").alias("overlap_ids"))
    b = rows.join(hashes.select("text_hash").distinct(), "text_hash", "left_semi").agg(F.count("*").alias("overlap_texts"))
    one = [x.withColumn("_k", F.lit(1)) for x in (base, a, b)]  # one row each
    return one[0].join(one[1], "_k").join(one[2], "_k").drop("_k")


def numbered_rows(rows: DataFrame, order: str) -> DataFrame:
    """rows with `ordinal`, their place in the whole table, by a sample sort: no task takes all of it."""
    return placed(rows, [], [order], "ordinal")


def truncate(rows: DataFrame, n: int, order: str = "ordinal") -> DataFrame:
    return rows.filter(F.col(order) <= n)


def require_complete(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows of these ids, ordered by key; an error if any id has no row."""
    found = ids.select(key).distinct().join(rows, key, "left")
    missing = found.filter(F.col(rows.columns[1 if rows.columns[0] == key else 0]).isNull()).count()
    if missing:
        raise ValueError(f"{missing} ids have no row")
    return found.orderBy(key)
