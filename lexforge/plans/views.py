"""The engine's logical tables over the driver's: corpus, scores, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_hash, token_count

#: Dimensions of the synthetic scores: name, multiplier, offset.
DIMENSIONS = (("edu", 7919, 13), ("clean", 104729, 57), ("culture", 1299709, 101), ("style", 611953, 211), ("safety", 331777, 307))
NAMES = [d for d, _, _ in DIMENSIONS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("lang").alias("language"), F.col("source").alias("domain"), F.length(text).alias("char_len"),
        token_count(text).cast("long").alias("tokens"), text_hash(text).alias("text_hash"),
    )


def score_of(dimension: str):
    p, c = next((p, c) for d, p, c in DIMENSIONS if d == dimension)
    return ((F.col("doc_id") * p + c) % 6500) / F.lit(1000.0) - F.lit(0.5)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long: language, doc_id, dimension, score_raw."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), score_of(d).alias("score_raw")) for d in NAMES]))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"))
    return rows.select("language", "doc_id", each.alias("s")).select("language", "doc_id", "s.dimension", "s.score_raw")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels: human score (0 or 5 by quality, 1 less if toxic) and a raw prediction."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = corpus(spark, sf_dir).join(labels, "doc_id")
    human = F.greatest(F.lit(0.0), F.col("quality") * 3.0 + F.col("doc_id") % 3 - F.col("toxic"))
    return rows.withColumn("human", human).withColumn("raw", score_of("edu"))


def _case(d: str) -> str:
    p, c = next((p, c) for x, p, c in DIMENSIONS if x == d)
    return f"((doc_id * {p} + {c}) % 6500)::DOUBLE / 1000.0::DOUBLE - 0.5::DOUBLE"


SQL_CORPUS = r"""corpus AS (SELECT doc_id, text, lang AS language, source AS domain, length(text) AS char_len,
  len(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}]+')) AS tokens, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_hash FROM documents)"""
SQL_SCORES = "scores AS (" + " UNION ALL ".join(f"SELECT lang AS language, doc_id, '{d}' AS dimension, {_case(d)} AS score_raw FROM documents" for d in NAMES) + ")"
SQL_ANNOTATIONS = f"""annotations AS (SELECT c.*, l.quality, l.toxic, greatest(0.0::DOUBLE, l.quality * 3.0::DOUBLE + c.doc_id % 3 - l.toxic) AS human,
  {_case('edu').replace('doc_id', 'c.doc_id')} AS raw FROM corpus c JOIN labels l ON c.doc_id = l.doc_id)"""
WITH = f"WITH {SQL_CORPUS}, {SQL_SCORES}, {SQL_ANNOTATIONS}"
SQL_SCORE = {d: _case(d) for d in NAMES}
