"""Releases of a table as snapshots: content-addressed files, a manifest a snapshot, and a pointer that is swapped at once.

A snapshot's files are stored under their SHA-256, so files that an earlier snapshot had aren't stored again; its manifest lists (name, sha256,
bytes), and what changed between two is the difference of two manifests. `publish` stores what is new, writes the manifest and then renames the
pointer `current` into place: readers see the old snapshot or the new one, whole, whenever the writer stops. A gate looks at the files' rows
before: a column that isn't allowed, or a row that a check names, ends the release with nothing published.

Files are copied by tasks, by way of pyarrow's file systems; only names of columns and of one snapshot reach the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .answers import filesystem

MANIFEST = "name string, sha256 string, bytes long"
CHUNK = 4 << 20


def private_columns(rows: DataFrame, allowed: list[str], checks: dict[str, Column]) -> None:
    """An error if a column isn't allowed, or a check (name -> condition on a row) holds for any row."""
    if extra := sorted(set(rows.columns) - set(allowed)):
        raise ValueError(f"columns that may not be released: {', '.join(extra)}")
    if checks:
        found = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()]).first().asDict()
        if bad := {n: k for n, k in found.items() if k}:
            raise ValueError(f"rows that may not be released: {bad}")


def _store(folder: str):
    """Copies each file to objects/<sha256>, unless it is there, and tells its manifest line."""

    def digest(where, path: str) -> tuple[str, int]:
        told, n = hashlib.sha256(), 0
        with where.open_input_stream(path) as file:
            while chunk := file.read(CHUNK):
                told.update(chunk)
                n += len(chunk)
        return told.hexdigest(), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, root = filesystem(folder)
        for batch in batches:
            lines = []
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, inner = filesystem(path)
                sha, n = digest(where, inner)
                if to.get_file_info(f"{root}/objects/{sha}").size is None:
                    to.create_dir(f"{root}/objects", recursive=True)
                    own = f"{root}/objects/.{uuid.uuid4().hex}"
                    with where.open_input_stream(inner) as file, to.open_output_stream(own) as out:
                        while chunk := file.read(CHUNK):
                            out.write(chunk)
                    to.move(own, f"{root}/objects/{sha}")
                lines.append((name, sha, n))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["name", "sha256", "bytes"])

    return run


def publish(spark: SparkSession, source: str, folder: str, allowed: list[str], checks: dict[str, Column] | None = None) -> str:
    """Publishes the Parquet files below source as a new snapshot and returns its name, the digest of its manifest. The same files give the same name."""
    private_columns(spark.read.option("mergeSchema", True).parquet(source), allowed, checks or {})  # columns of any of its files
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(source).select("path")
    where = spark._jvm.org.apache.hadoop.fs.Path(source)
    base = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toString().rstrip("/")
    lines = files.select("path", F.substring("path", F.lit(len(base) + 2), F.length("path")).alias("name")).mapInArrow(_store(folder), MANIFEST)
    stage = f"{folder}/manifests/_stage-{uuid.uuid4().hex}"
    lines.write.parquet(stage)
    held = spark.read.schema(MANIFEST).parquet(stage)
    # Order-free digest of the lines: sums of halves of their hashes, so no task gathers them.
    half = lambda at: F.sum(F.conv(F.substring(F.sha2(F.concat_ws("|", "name", "sha256", F.col("bytes").cast("string")), 256), at, 12), 16, 10).cast("decimal(38,0)"))
    told = held.agg(F.count("*").alias("n"), half(1).alias("a"), half(13).alias("b"), half(25).alias("c")).first()
    snapshot = hashlib.sha256(str(tuple(told)).encode()).hexdigest()[:32]
    to, root = filesystem(folder)
    inner = filesystem(stage)[1]
    if _is_there(to, f"{root}/manifests/{snapshot}"):
        to.delete_dir(inner)
    else:
        to.move(inner, f"{root}/manifests/{snapshot}")
    point(folder, snapshot)
    return snapshot


def _is_there(where, path: str) -> bool:
    from pyarrow import fs

    return where.get_file_info(path).type != fs.FileType.NotFound


def point(folder: str, snapshot: str) -> None:
    """Makes a snapshot the current one: the pointer is written beside and renamed over the old one."""
    to, root = filesystem(folder)
    if not _is_there(to, f"{root}/manifests/{snapshot}"):
        raise ValueError(f"no snapshot {snapshot}")
    own = f"{root}/.current-{uuid.uuid4().hex}"
    with to.open_output_stream(own) as out:
        out.write(snapshot.encode())
    to.move(own, f"{root}/current")


def current(folder: str) -> str:
    to, root = filesystem(folder)
    with to.open_input_stream(f"{root}/current") as file:
        return file.read().decode()


def manifest(spark: SparkSession, folder: str, snapshot: str | None = None) -> DataFrame:
    """(name, sha256, bytes) of a snapshot, or of the current one."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifests/{snapshot or current(folder)}")


def difference(spark: SparkSession, folder: str, old: str, new: str) -> DataFrame:
    """(name, change): files added, removed, or changed from one snapshot to another."""
    a, b = (manifest(spark, folder, s).select("name", F.col("sha256").alias(c)) for s, c in ((old, "_a"), (new, "_b")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return a.join(b, "name", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("name", change.alias("change"))


def fetch(spark: SparkSession, folder: str, target: str, snapshot: str | None = None) -> DataFrame:
    """Downloads a snapshot's files to target, once: each is written beside its place, checked against its digest, and renamed; files that are
    there whole are left. Returns (name, fetched)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = filesystem(folder)
        to, into = filesystem(target)
        for batch in batches:
            fetched = []
            for name, sha, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                path = f"{into}/{name}"
                fetched.append(to.get_file_info(path).size != n)
                if not fetched[-1]:
                    continue
                to.create_dir(path.rsplit("/", 1)[0], recursive=True)
                told, own = hashlib.sha256(), f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                with where.open_input_stream(f"{root}/objects/{sha}") as file, to.open_output_stream(own) as out:
                    while chunk := file.read(CHUNK):
                        told.update(chunk)
                        out.write(chunk)
                if told.hexdigest() != sha:
                    to.delete_file(own)
                    raise OSError(f"{name} is not what its manifest says")
                to.move(own, path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fetched, pa.bool_())], ["name", "fetched"])

    return manifest(spark, folder, snapshot).mapInArrow(run, "name string, fetched boolean")
