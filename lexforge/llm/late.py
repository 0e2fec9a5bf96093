"""A layout of rows by day in files of a fixed number of rows, and its overwrite by rows that arrive late.

`write_layout` keeps the latest row of each key, numbers each day's rows in the order of (time, key) and writes one Parquet file for every
`size` rows: root/day=D/file_no=N/. `overwrite` takes late rows in: days where a late row comes to stand, or where the row it replaces stood,
are dirty, and their files are made again; files of other days aren't touched.

Spark finds what comes in and what goes out, and writes both by day. An executor's DuckDB then makes each dirty day: it reads the day's old
files, takes away outgoing keys by an anti-join, adds the incoming rows, sorts by an external ORDER BY under a memory limit, numbers with
row_number and exports slice by slice. A day of more than RUN_FILES files is made in runs of so many files, cut at exact keys (a sample sort of
its keys), so no task handles more than RUN_FILES * size rows, however large a day is.

New files are made beside the layout, under names of this overwrite, and renamed into place only when all are whole; then the old files go.
Which files these are is written before. Making and swapping can both be repeated, by a task or whole (`swap`), with the same result.

The folder must be mounted by the executors under one path (a file: URI or a plain path), as DuckDB writes there; others are an error.

Defined cases: a null time is day -1; of rows of one key and arrival the greatest by the other columns, in their order, stays (null before
all); a null arrival is before all others; null is a key like others; a late row that arrived before the standing one changes nothing; an
empty table gives an empty layout; columns of any names are kept, but `day` and `file_no`, which name folders, are an error.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import placed
from .common import Scratch, parts, remove_path

DAY_MICROS = 86_400_000_000
NO_DAY = -1
#: Files that one run of DuckDB makes, and the memory it may use before it spills.
RUN_FILES, MEMORY = 8, "256MB"
DESCRIPTION = "day long, file_no long, n_rows long, cents long, rows_crc long, path string, columns string, ids_sha256 string"


@dataclass(frozen=True)
class Keys:
    """Names of the columns: key of a row, time that places it, and its arrival."""

    key: str
    time: str
    arrival: str


def micros(rows: DataFrame, column: str) -> Column:
    """Microseconds since 1970, of times without a zone as if in UTC."""
    if dict(rows.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(column)


def day_of(rows: DataFrame, column: str) -> Column:
    return F.coalesce(F.floor(micros(rows, column) / F.lit(DAY_MICROS)).cast("long"), F.lit(NO_DAY).cast("long"))


def local_path(path: str) -> str:
    """The mounted path of a folder."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: DuckDB writes the files of a layout, so its folder must be a mounted one")
    return path


def latest(rows: DataFrame, keys: Keys) -> DataFrame:
    """The latest row of each key. The greatest of structs is found by each task first, so a key of most rows is no large task."""
    rest = [c for c in rows.columns if c not in (keys.key, keys.arrival)]
    kept = rows.groupBy(keys.key).agg(F.max(F.struct(keys.arrival, *rest)).alias("_last"))
    return kept.select(*[F.col(c) if c == keys.key else F.col(f"_last.{c}").alias(c) for c in rows.columns])


def write_layout(rows: DataFrame, root: str, keys: Keys, size: int) -> None:
    if {"day", "file_no"} & {c.lower() for c in rows.columns}:
        raise ValueError("columns day and file_no name the folders of a layout")
    kept = latest(rows, keys)
    kept = kept.withColumn("day", day_of(kept, keys.time))
    kept = placed(kept, ["day"], [keys.time, keys.key], "_place")
    kept = kept.withColumn("file_no", F.floor((F.col("_place") - 1) / F.lit(size)).cast("long"))
    # One task writes a file, whole: its rows meet there and come sorted.
    kept = kept.repartition(parts(rows.sparkSession), "day", "file_no").sortWithinPartitions("day", "file_no", "_place").drop("_place")
    kept.select(*rows.columns, "day", "file_no").write.partitionBy("day", "file_no").option("maxRecordsPerFile", 0).parquet(root)


def standing(spark: SparkSession, root: str, like: DataFrame) -> DataFrame:
    """The rows of a layout with their day; `like` has its columns."""
    kind = like.select("*", F.lit(0).cast("long").alias("day"), F.lit(0).cast("long").alias("file_no")).schema
    return spark.read.schema(kind).parquet(root).drop("file_no")


def _by_day(rows: DataFrame, path: str, order: list[str]) -> None:
    """Written in folders by day. Splitters of (day, order) deal the rows, so a large day is written by several tasks."""
    rows.repartitionByRange(parts(rows.sparkSession), "day", *order).write.partitionBy("day").parquet(path)


def overwrite(scratch: Scratch, root: str, late: DataFrame, keys: Keys, size: int, run_files: int = RUN_FILES) -> DataFrame:
    """Takes late rows into the layout at root and returns its dirty days (day)."""
    spark, token = scratch.spark, uuid.uuid4().hex
    new = latest(late, keys)
    old = standing(spark, root, late)
    rest = [c for c in late.columns if c not in (keys.key, keys.arrival)]
    rank = lambda of: F.struct(*[F.col(f"{of}{c}").alias(c) for c in (keys.arrival, *rest)])
    was = old.select(*[F.col(c).alias(f"_old_{c}") for c in (*late.columns, "day")])
    met = new.join(was, new[keys.key].eqNullSafe(was[f"_old_{keys.key}"]), "left")
    met = scratch.save(met.filter(F.col("_old_day").isNull() | (rank("") > rank("_old_"))).withColumn("day", day_of(met, keys.time)), f"met-{token}")
    incoming, outgoing = met.select(*late.columns, "day"), met.filter("_old_day is not null").select(F.col("_old_day").alias("day"), keys.key)
    where = {"incoming": f"{scratch.root}/incoming-{token}", "outgoing": f"{scratch.root}/outgoing-{token}", "old": root}
    _by_day(incoming, where["incoming"], [keys.time, keys.key])
    _by_day(outgoing, where["outgoing"], [keys.key])
    dirty = scratch.save(incoming.select("day").unionByName(outgoing.select("day")).distinct(), f"dirty-{token}")
    runs = scratch.save(_runs(old.join(dirty, "day", "left_semi"), incoming, outgoing, keys, size * run_files), f"runs-{token}")
    plan = f"{root}/_new-{token}"
    dirty.repartition(parts(spark)).mapInArrow(_list_old(root), "day long, path string").write.parquet(f"{plan}/_plan")
    _made(runs, {k: local_path(v) for k, v in where.items()}, local_path(plan), f"{local_path(scratch.root)}/spill", late.columns, keys, size, run_files).write.parquet(f"{plan}/_made")
    swap(spark, root, token)
    return dirty


def _runs(old: DataFrame, incoming: DataFrame, outgoing: DataFrame, keys: Keys, most: int) -> DataFrame:
    """(day, run, t, k, to_t, to_k, last): runs of at most `most` rows of each dirty day, from key (t, k) on, up to before (to_t, to_k).
    Days of one run need no keys; only larger ones have theirs sorted."""
    one = lambda rows, n: rows.groupBy("day").agg(F.lit(n) * F.count("*")).toDF("day", "n")
    sizes = one(old, 1).unionByName(one(incoming, 1)).unionByName(one(outgoing, -1)).groupBy("day").agg(F.sum("n").alias("n"))
    large = sizes.filter(F.col("n") > most).select("day")
    mine = lambda rows: rows.join(large, "day", "left_semi")
    left = mine(old).alias("o").join(outgoing.alias("g"), (F.col("o.day") == F.col("g.day")) & F.col(f"o.{keys.key}").eqNullSafe(F.col(f"g.{keys.key}")), "left_anti")
    both = left.select("day", keys.time, keys.key).unionByName(mine(incoming).select("day", keys.time, keys.key))
    cut = placed(both, ["day"], [keys.time, keys.key], "_place").filter((F.col("_place") - 1) % most == 0)
    cut = cut.select("day", F.floor((F.col("_place") - 1) / F.lit(most)).cast("long").alias("run"), F.col(keys.time).alias("t"), F.col(keys.key).alias("k"))
    whole = sizes.filter(F.col("n") <= most).select("day", F.lit(0).cast("long").alias("run"), F.lit(None).cast(cut.schema["t"].dataType).alias("t"), F.lit(None).cast(cut.schema["k"].dataType).alias("k"))
    after = Window.partitionBy("day").orderBy("run")  # one row a run
    cuts = cut.unionByName(whole).select("*", F.lead("t").over(after).alias("to_t"), F.lead("k").over(after).alias("to_k"), F.lead("run").over(after).isNull().alias("last"))
    return cuts.select("day", "run", "t", "k", "to_t", "to_k", "last")


def _list_old(root: str):
    """Per dirty day its files, from its own folder."""
    top = local_path(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(day, path) for day in batch.column(0).to_pylist() for _, path in day_files(top, day)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string())], ["day", "path"])

    return run


def day_files(top: str, day: int) -> list[tuple[int, str]]:
    """(file_no, path) of a day's files, in order."""
    folder, out = f"{top}/day={day}", []
    for name in os.listdir(folder) if os.path.isdir(folder) else []:
        if name.startswith("file_no="):
            out += [(int(name[8:]), f"{folder}/{name}/{x}") for x in sorted(os.listdir(f"{folder}/{name}")) if x.endswith(".parquet") and x[0] not in "._"]
    return sorted(out)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def make_run(con, where: dict[str, str], plan: str, columns: list[str], keys: Keys, size: int, run_files: int, row: dict) -> Iterator[tuple[int, int, int, str]]:
    """Makes one run of a dirty day; gives (day, file_no, rows, path) of each file."""
    day, cols, key, time = row["day"], ", ".join(map(quoted, columns)), quoted(keys.key), quoted(keys.time)

    def source(name: str, cols: str) -> str | None:
        folder = f"{where[name]}/day={day}"
        files = [p for _, p in day_files(where[name], day)] if name == "old" else [f"{folder}/{x}" for x in sorted(os.listdir(folder)) if x.endswith(".parquet")] if os.path.isdir(folder) else []
        listed = ", ".join("'" + f.replace("'", "''") + "'" for f in files)
        return f"SELECT {cols} FROM read_parquet([{listed}], hive_partitioning = false)" if files else None

    held = source("old", cols)
    if held and (gone := source("outgoing", key)):
        held += f" AS o WHERE NOT EXISTS (FROM ({gone}) g WHERE g.{key} IS NOT DISTINCT FROM o.{key})"
    rows = " UNION ALL ".join(x for x in (held, source("incoming", cols)) if x)
    # All times of a day are null or none is, and a null key comes before all others.
    inside, given = [], []
    for first, t, k, word in ((row["run"] == 0, row["t"], row["k"], ">="), (row["last"], row["to_t"], row["to_k"], "<")):
        if first:
            continue
        same = "TRUE" if t is None else f"{time} = ?"
        less = "FALSE" if t is None else f"{time} {word[0]} ?"
        at_key = ("TRUE" if word == ">=" else "FALSE") if k is None else f"{key} {word} ?" if word == ">=" else f"({key} {word} ? OR {key} IS NULL)"
        inside.append(f"({less} OR ({same} AND {at_key}))")
        given += [t] * (2 * (t is not None)) + [k] * (k is not None)
    con.execute(f"CREATE OR REPLACE TEMP TABLE made AS SELECT *, row_number() OVER () - 1 AS _place FROM (SELECT * FROM ({rows}) WHERE {' AND '.join(inside) or 'TRUE'} ORDER BY {time} NULLS FIRST, {key} NULLS FIRST)", given)
    n = con.execute("SELECT count(*) FROM made").fetchone()[0]
    for i in range(-(-n // size)):
        number = row["run"] * run_files + i
        folder = f"{plan}/day={day}/file_no={number}"
        own, path = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/made.parquet"
        os.makedirs(folder, exist_ok=True)
        con.execute(f"COPY (SELECT {cols} FROM made WHERE _place >= {i * size} AND _place < {(i + 1) * size} ORDER BY _place) TO '{own}' (FORMAT parquet, COMPRESSION zstd)")
        os.replace(own, path)
        yield day, number, min(size, n - i * size), path


def _made(runs: DataFrame, where: dict[str, str], plan: str, spill: str, columns: list[str], keys: Keys, size: int, run_files: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        own = f"{spill}/{uuid.uuid4().hex}"
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": own})
        con.execute("SET TimeZone = 'UTC'")
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    made = list(make_run(con, where, plan, columns, keys, size, run_files, row))
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*made, strict=True) if made else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["day", "file_no", "n_rows", "path"])
        finally:
            con.close()

    dealt = runs.repartition(max(parts(runs.sparkSession), 2), "day", "run")
    return dealt.mapInArrow(run, "day long, file_no long, n_rows long, path string")


def swap(spark: SparkSession, root: str, token: str) -> None:
    """Moves made files into place, day by day, and then removes the day's old ones. What was done before is left as it is, so a swap that
    broke off is ended by calling it again."""
    plan, top = f"{root}/_new-{token}", local_path(root)
    old = spark.read.schema("day long, path string").parquet(f"{plan}/_plan").select("day", F.lit(None).cast("long").alias("file_no"), "path")
    made = spark.read.schema("day long, file_no long, n_rows long, path string").parquet(f"{plan}/_made").select("day", "file_no", "path")
    # A day's old files go once all new ones are in place: the first job moves, the second removes.

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                folder = f"{top}/day={row['day']}/file_no={row['file_no']}"
                os.makedirs(folder, exist_ok=True)
                if os.path.exists(row["path"]):
                    os.replace(row["path"], f"{folder}/late-{token}.parquet")
            yield batch.select(["day"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                folder, name = os.path.split(path)
                for x in (path, f"{folder}/.{name}.crc"):
                    if os.path.exists(x):
                        os.remove(x)
                for x in (folder, os.path.dirname(folder)):
                    with contextlib.suppress(OSError):  # it holds new files, or another task has just removed it
                        os.rmdir(x)
            yield batch.select(["day"])

    for rows, what in ((made, move), (old, remove)):
        rows.repartition(parts(spark), "path").mapInArrow(what, "day long").write.format("noop").mode("overwrite").save()
    remove_path(spark, plan)


def describe(scratch: Scratch, root: str, days: DataFrame, keys: Keys, amount: str) -> DataFrame:
    """One row a file of these days (day), read back from the files; each is streamed by one task."""
    top, spark = local_path(root), scratch.spark

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(day, no, path) for day in batch.column(0).to_pylist() for no, path in day_files(top, day)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["day", "file_no", "path"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["day"], r["file_no"], *digest(r["path"], keys, amount)) for r in batch.to_pylist()]
            kinds = [pa.int64()] * 5 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [x.split()[0] for x in DESCRIPTION.split(", ")])

    listed = days.select("day").distinct().mapInArrow(files, "day long, file_no long, path string")
    return listed.repartition(parts(spark), "path").mapInArrow(read, DESCRIPTION)


def digest(path: str, keys: Keys, amount: str) -> tuple[int, int, int, str, str, str]:
    """(rows, cents, sum of the rows' CRC-32, path, columns, SHA-256 of the keys) of a file, batch by batch. An amount that is no finite number counts 0."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    file, n, cents, crc, ids = pq.ParquetFile(path), 0, 0, 0, hashlib.sha256()
    text = lambda x: pc.fill_null(pc.cast(x, pa.string()), "")
    for batch in file.iter_batches(65_536, columns=[keys.key, keys.time, keys.arrival, amount]):
        by = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        total = pc.cast(by[amount], pa.float64())
        total = pc.fill_null(pc.if_else(pc.is_finite(total), total, 0.0), 0.0)
        cents += pc.sum(pc.cast(pc.floor(pc.add(pc.multiply(total, 100.0), 0.5)), pa.int64())).as_py() or 0
        times = [text(pc.cast(pc.cast(by[c], pa.timestamp("us", tz=by[c].type.tz)), pa.int64())) for c in (keys.time, keys.arrival)]
        key = text(by[keys.key])
        crc += sum(map(zlib.crc32, pc.cast(pc.binary_join_element_wise(key, *times, ":"), pa.binary()).to_pylist()))
        ids.update(((b"," if n else b"") + ",".join(key.to_pylist()).encode()) if len(key) else b"")
        n += batch.num_rows
    return n, cents, crc, path, ",".join(file.schema_arrow.names), ids.hexdigest()
