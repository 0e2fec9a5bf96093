"""Shared helpers: scratch tables in the cluster's shared folder, table loading, row keys."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The smallest long; stands for a null document id wherever an order of ids is needed.
NULL_ID = -(2**63)
#: Rows of one Arrow batch handed to Python, and bytes of one of texts: a batch of very long texts is cut by its bytes, so that neither the
#: executor's buffers nor a worker's memory grow with their length (but for one text that is longer by itself).
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Groups (languages, domains) that a sample may be drawn for; more are an error, never left out.
MOST_GROUPS = 1000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one on a local master (tests), on a cluster an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="lexforge-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    else:  # narrow rows, in blocks of this many
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


class Scratch:
    """Written tables that cut lineage: they survive lost executors, and what made them can be forgotten."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lexforge-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.tidy()  # a stage of many tables would else fill the driver's heap with what its plans and broadcasts left
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self) -> None:
        """Lets Spark drop the shuffle files of finished steps now, not whenever the driver happens to collect garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            remove_path(self.spark, f"{self.root}/{name}")

    def kept(self) -> str:
        """A new folder beside this one, which stays when the session ends: for files that are the result."""
        return f"{self.root}-{uuid.uuid4().hex}"

    def clear(self) -> None:
        try:
            remove_path(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session is gone
            pass


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def known_id(column: str = "doc_id") -> Column:
    """The id as a long that orders and joins; null sorts before all."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def thinned(rows: DataFrame, h: Column, k: int, by: list[str] | None = None) -> DataFrame:
    """About the 4 * k rows of smallest hash of each group (all, if there are no more), whatever the input's size: a bounded input for a
    top-k by hash, which then isn't fed k rows by every task. More than MOST_GROUPS groups are an error."""
    space = 2.0**52
    keep = F.pmod(h, F.lit(1 << 52)).cast("double") * F.col("_group_rows") < F.lit(4.0 * k * space)
    if by is None:
        n = rows.count()
        return rows.withColumn("_group_rows", F.lit(float(n))).filter(keep).drop("_group_rows")
    sizes = rows.groupBy(*by).agg(F.count("*").cast("double").alias("_group_rows")).limit(MOST_GROUPS + 1).collect()
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} distinct values of {', '.join(by)}")
    if not sizes:
        return rows.limit(0)
    sizes = rows.sparkSession.createDataFrame(sizes, rows.select(*by, F.lit(0.0).alias("_group_rows")).schema)
    return rows.join(F.broadcast(sizes), by).filter(keep).drop("_group_rows")


#: Buckets of a sample's ranking, so that a group of most rows isn't ranked by one task.
SALTS = 16


def few_each(rows: DataFrame, by: str, h: Column, k: int, *ties: str) -> DataFrame:
    """At most k rows a value of `by`, spread over SALTS buckets of its hash: in each the k / SALTS of smallest hash."""
    salted = thinned(rows, h, k, [by]).withColumn("_salt", F.pmod(F.xxhash64(h), F.lit(SALTS)))
    place = F.row_number().over(Window.partitionBy(by, "_salt").orderBy(h, *ties))
    return salted.withColumn("_n", place).filter(F.col("_n") <= max(1, k // SALTS)).drop("_n", "_salt")
