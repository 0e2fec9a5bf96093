"""Sinks: fixed field order, formatted scores, manifests, skip-if-complete, resumable logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clip


#: Fields are written and read as they are, blanks at their ends included.
EXACT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    rows.select(*fields).write.mode("overwrite").options(**EXACT).csv(path)


def write_named(rows: DataFrame, folder: str, by: str, suffix: str, form: str = "csv", **options) -> None:
    """Files <value of by>-<number><suffix> in a folder: a value of most rows may have many, written by as many tasks. Names only are handled here."""
    spark = rows.sparkSession
    stage = f"{folder.rstrip('/')}/_stage-{uuid.uuid4().hex}"
    rows.write.partitionBy(by).options(**((EXACT if form == "csv" else {}) | options)).format(form).save(stage)
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    root = jvm.org.apache.hadoop.fs.Path(stage)
    files = root.getFileSystem(conf)
    for value in files.listStatus(root):
        name = value.getPath().getName()
        if not name.startswith(f"{by}="):
            continue
        parts = sorted((x.getPath() for x in files.listStatus(value.getPath()) if x.getPath().getName().startswith("part-")), key=lambda x: x.getName())
        for i, part in enumerate(parts):
            if not files.rename(part, jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name[len(by) + 1 :]}-{i:05d}{suffix}")):
                raise OSError(f"{part} can't be renamed")
    files.delete(root, True)


def formatted_scores(rows: DataFrame) -> DataFrame:
    """Score rows as text with 6 decimals, raw and clipped."""
    six = lambda c: F.format_string("%.6f", c)
    return rows.select("doc_id", "language", six(F.col("score_raw")).alias("score_raw"), six(clip(F.col("score_raw"))).alias("score"))


def resumed_log(old: DataFrame, new: DataFrame, upto: int, step: str = "step") -> DataFrame:
    """The old log up to a step, then the new one."""
    return old.filter(F.col(step) <= upto).unionByName(new)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of files; hidden ones are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.filter(~F.col("path").rlike(r"/[._][^/]*$")).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def copy_artifacts(spark: SparkSession, source: str, target: str, suffixes: list[str]) -> list[str]:
    """Copies the files below source whose suffix is allowed, and returns their places there; hidden and cache files are left out, as
    are links, which the file listing doesn't follow."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path")
    allowed = "(" + "|".join(x.replace(".", r"\.") for x in suffixes) + ")$"
    kept = files.filter(F.col("path").rlike(allowed) & ~F.col("path").rlike(r"/([._][^/]*|__pycache__)(/|$)"))
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    root = jvm.org.apache.hadoop.fs.Path(source)
    base = root.getFileSystem(conf).makeQualified(root).toUri().getPath().rstrip("/")
    out = []
    for r in kept.orderBy("path").collect():  # names of the files of a release
        at = jvm.org.apache.hadoop.fs.Path(r["path"])
        name = at.toUri().getPath()[len(base) + 1 :]
        to = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/{name}")
        to.getFileSystem(conf).mkdirs(to.getParent())
        jvm.org.apache.hadoop.fs.FileUtil.copy(at.getFileSystem(conf), at, to.getFileSystem(conf), to, False, True, conf)
        out.append(name)
    return out


def is_complete(spark: SparkSession, path: str, expected: int) -> bool:
    """Whether a written table is there with the expected rows."""
    try:
        return spark.read.parquet(path).count() == expected
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def write_once(rows: DataFrame, path: str, expected: int) -> DataFrame:
    """Writes unless a complete table is there; returns the written one."""
    spark = rows.sparkSession
    if not is_complete(spark, path, expected):
        rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def to_markdown(rows: DataFrame, most: int = 200) -> str:
    """A report table of at most `most` rows."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(most).collect())])
