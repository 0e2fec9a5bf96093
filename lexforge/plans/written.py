"""Tables written to the cluster's shared folder: what several steps read is computed once, and survives lost executors."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths written since each `temporary` that is open, the innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is set, a temporary one on a local master, an error on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        from tempfile import mkdtemp

        known = "file://" + mkdtemp(prefix="lexforge-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that no other table has."""
    return f"{shared_dir(spark)}/lexforge-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session is gone
        pass


def keep_until_exit(spark: SparkSession, path: str) -> str:
    """The path, which is removed when the process ends, or the innermost `temporary`."""
    if _open:
        _open[-1].append(path)
    else:
        atexit.register(_remove_at_exit, spark, path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at its end: for steps whose results are written elsewhere, so that a driver that runs for long
    doesn't fill the shared folder."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def written(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    path = keep_until_exit(spark, new_folder(spark))
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
