"""A random sample of rows that reads only the Parquet row groups it needs.

Footers are read by tasks, one row of counts a row group comes back. Row groups are taken in hash order, of each a random share of its rows,
until the target is filled; a data source plans one partition for each row group taken, and that task reads it alone, its columns pruned. So
the bytes read grow with the target, not with the table. The draw depends on the seed, the salt, the files' names and their row groups only.

Files are opened by pyarrow's file systems (plain paths, file:, hdfs:, s3: and others that it knows).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GROUPS = "path string, file string, row_group int, n_rows long"


def open_parquet(path: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return pq.ParquetFile(where.open_input_file(inner))


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, row_group, n_rows) of every row group below a folder, from the footers, which tasks read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                told = open_parquet(file).metadata
                n = told.num_row_groups
                rows = [told.row_group(i).num_rows for i in range(n)]
                arrays = [pa.array([file] * n, pa.string()), pa.array([file.rsplit("/", 1)[-1]] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(rows, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "file", "row_group", "n_rows"])

    return files.mapInArrow(run, GROUPS)


def chosen(groups: DataFrame, target: int, seed: int, salt: str, least_fraction: float) -> tuple[DataFrame, dict]:
    """(path, file, row_group, n_rows, take, before): row groups in hash order until they hold the target; `take` rows are drawn of each, of
    which those from `before` to the target are wanted. And what was there. The window is over one row a row group."""
    there = groups.agg(F.count("*").alias("row_groups"), F.count_distinct("path").alias("files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows")).first()
    share = min(1.0, max(least_fraction, 2.0 * target / max(1, there["total_rows"])))
    take = F.when(F.lit(share) >= 1, F.col("n_rows")).otherwise(F.bround(F.col("n_rows") * F.lit(share))).cast("long")
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), "file", F.col("row_group").cast("string")), 256)
    before = F.sum("take").over(Window.orderBy("_h", "path").rowsBetween(Window.unboundedPreceding, -1))
    drawn = groups.withColumn("take", take).withColumn("_h", key).withColumn("before", F.coalesce(before, F.lit(0)))
    info = {"sampling": "random", "seed": seed, **there.asDict(), "row_fraction": round(share, 4)}
    return drawn.filter((F.col("before") < target) & (F.col("take") > 0)).drop("_h"), info


@dataclass
class RowGroup(InputPartition):
    path: str
    row_group: int
    rows: list[int]
    before: int


def drawn_rows(seed: int, salt: str, file: str, row_group: int, n_rows: int, take: int) -> list[int]:
    """Which rows of a row group are drawn, in order."""
    own = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{salt}:{file}:{row_group}:rows".encode()).digest()[:8], "big"))
    return np.sort(own.choice(n_rows, size=take, replace=False)).tolist()


class RowGroupSource(DataSource):
    """Reads given rows of given row groups; options: schema, columns (JSON) and groups (JSON of RowGroup's fields, rows as how to draw them)."""

    @classmethod
    def name(cls) -> str:
        return "lexforge_row_groups"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return RowGroupReader(json.loads(self.options["columns"]), json.loads(self.options["groups"]))


class RowGroupReader(DataSourceReader):
    def __init__(self, columns: list[str], groups: list[dict]):
        self.columns, self.groups = columns, groups

    def partitions(self) -> list[RowGroup]:
        return [RowGroup(g["path"], g["row_group"], [], g["before"]) for g in self.groups] or [RowGroup("", 0, [], 0)]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        for g in self.groups:
            if (g["path"], g["row_group"]) == (partition.path, partition.row_group):
                rows = drawn_rows(g["seed"], g["salt"], g["file"], g["row_group"], g["n_rows"], g["take"])[: g["wanted"]]
                table = open_parquet(g["path"]).read_row_group(g["row_group"], columns=self.columns).take(pa.array(rows, pa.int64()))
                table = table.select(self.columns).append_column("ordinal", pa.array(range(g["before"], g["before"] + len(rows)), pa.int64()))
                yield from table.combine_chunks().to_batches()


def random_rows(spark: SparkSession, path: str, target: int, seed: int, salt: str = "", columns: list[str] | None = None, least_fraction: float = 0.02) -> tuple[DataFrame, dict]:
    """(rows, info): `target` random rows (all, if there are fewer) of the Parquet files below a folder, with their place in the draw as `ordinal`;
    info tells what was there and how many row groups are read. A column `ordinal` of the files is an error."""
    kind = spark.read.parquet(path).schema
    columns = columns or kind.fieldNames()
    if "ordinal" in (c.lower() for c in columns):
        raise ValueError("ordinal names the place in the draw")
    picked, info = chosen(row_groups(spark, path), target, seed, salt, least_fraction)
    held = picked.orderBy("before").collect()  # as many as the target needs
    groups = [r.asDict() | {"seed": seed, "salt": salt, "wanted": min(r["take"], target - r["before"])} for r in held]
    schema = ", ".join(f"`{c}` {kind[c].dataType.simpleString()}" for c in columns) + ", ordinal long"
    spark.dataSource.register(RowGroupSource)
    rows = spark.read.format(RowGroupSource.name()).options(schema=schema, columns=json.dumps(columns), groups=json.dumps(groups)).load()
    return rows, info | {"row_groups_read": len(groups)}
