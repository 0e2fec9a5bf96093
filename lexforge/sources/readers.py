"""Readers: typed, declared schemas, partition key from the file name; all by Spark's own sources, so any file system works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.written import written

ANNOTATIONS = "doc_id string, text string, " + ", ".join(f"score_{k} string" for k in range(5))
POOL = "doc_id string, language string, char_len int"
SCORES = "doc_id string, language string, score_raw double, score double, rater_tokens int"
LLM = "id string, parse_status string, error string, justification string, text string"


def stem(suffix: str = ""):
    """The file name without folder, suffix, and the number that `sinks.write_named` gives each of several files of a name."""
    return F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), r"(-\d{5})?" + (suffix or r"\.[^.]*") + "$", "")


def csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """Header, quoted multi-line fields, a leading byte-order mark is skipped."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)


#: What the bytes 0x80 to 0x9f stand for in code page 1252, which Spark's readers don't know; the rest is as in Latin-1.
LATIN = "".join(chr(b) for b in range(0x80, 0xA0))
CP1252 = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))


def csv_with_fallback(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """UTF-8, or code page 1252 if decoding leaves replacement characters."""
    rows = csv(spark, path, schema)
    broken = rows.filter(F.concat_ws("", *[F.col(c).cast("string") for c in rows.columns]).contains("\ufffd"))
    if not broken.limit(1).count():
        return rows
    latin = csv(spark, path, schema, "ISO-8859-1")
    return latin.select(*[F.translate(c, LATIN, CP1252).alias(c) if kind == "string" else F.col(c) for c, kind in latin.dtypes])


def language_files(spark: SparkSession, pattern: str, suffix: str, schema: str) -> DataFrame:
    """All files <language><suffix> with their language."""
    return csv(spark, pattern, schema).withColumn("language", stem(suffix.replace(".", r"\.")))


def language_of(name, prefixes: dict[str, str]):
    """The language whose prefix the file name begins with (longest first), else null."""
    out = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        out = F.when(F.startswith(name, F.lit(p)), prefixes[p]).otherwise(out)
    return out


def llm_documents(spark: SparkSession, pattern: str, prefixes: dict[str, str], schema: str = LLM) -> tuple[DataFrame, DataFrame]:
    """(documents, skipped files): JSON lines, blank ones ignored; files of no known prefix and checkpoints are skipped and reported."""
    rows = spark.read.text(pattern).withColumn("file", stem(r"\.jsonl?")).filter(F.trim("value") != "")
    rows = rows.withColumn("language", F.when(~F.contains("file", F.lit("checkpoint")), language_of(F.col("file"), prefixes)))
    skipped = rows.filter("language is null").select("file").distinct()
    return rows.filter("language is not null").select("file", "language", F.from_json("value", schema).alias("r")).select("file", "language", "r.*"), skipped


def parquet(spark: SparkSession, path: str, least_chars: int | None = None, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    if least_chars is not None:
        rows = rows.filter(F.length("text") >= least_chars)
    return rows.select(*columns) if columns else rows


def scored_stream(spark: SparkSession, path: str, score: str, least_chars: int = 500) -> DataFrame:
    """Texts of at least least_chars characters with a score, NaN where there is none; an error if there are no texts, or none has a score."""
    rows = parquet(spark, path, least_chars).withColumn(score, F.coalesce(F.col(score).cast("double"), F.lit(float("nan"))))
    found = rows.agg(F.count("*").alias("n"), F.count_if(~F.isnan(score)).alias("scored")).first()
    if not found["n"] or not found["scored"]:
        raise ValueError(f"{found['n']} texts, {found['scored']} with a score")
    return rows


def scores(spark: SparkSession, path: str, clipped: bool = False) -> DataFrame:
    return csv(spark, path, SCORES).select("language", "doc_id", "score" if clipped else "score_raw")


def scores_of(spark: SparkSession, path: str, languages: list[str]) -> DataFrame:
    """Clipped scores; an error if a language is absent."""
    rows = scores(spark, path, clipped=True)
    have = {r["language"] for r in rows.select("language").distinct().collect()}
    if missing := sorted(set(languages) - have):
        raise ValueError(f"no scores for {missing}")
    return rows.filter(F.col("language").isin(languages))


def embeddings(spark: SparkSession, path: str, keys: list[str], vector: str) -> DataFrame:
    """An error unless keys are unique and vectors equally long."""
    rows = spark.read.parquet(path)
    if rows.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError("repeated keys")
    ends = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if ends[0] != ends[1]:
        raise ValueError(f"vectors of {ends[0]} to {ends[1]} components")
    return rows


def benchmark_samples(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Nested samples; the task is in the file name samples_<task>_<date>."""
    return spark.read.schema(schema).json(pattern).withColumn("task", F.regexp_extract(F.input_file_name(), r"samples_(.+?)(?:_\d{4}[^/]*)?\.jsonl?$", 1))


def grouped_lines(lines: DataFrame, group: str, order: str, text: str = "line", drop: str = "<range>") -> DataFrame:
    """Documents from lines: those of a group in order, joined by a line break; a marker line is dropped."""
    kept = lines.filter(F.trim(text) != drop)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return kept.groupBy(group).agg(parts.alias("_p")).select(group, F.array_join(F.transform("_p", lambda p: p["t"]), "\n").alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, lines numbered from 0 on within their file. Files are split as Spark splits them: a line is counted within
    its block, whose lines are contiguous, and the blocks' counts, a row each, are summed in the order of their places in the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = written(lines.withColumn("_at", F.monotonically_increasing_id()))
    blocks = lines.groupBy("file", "_block").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "_block", (F.coalesce(ahead, F.lit(0)) - F.col("_from")).alias("_shift"))
    return lines.join(blocks, ["file", "_block"]).select("file", (F.col("_at") + F.col("_shift")).alias("line_no"), F.col("value").alias("line"))
