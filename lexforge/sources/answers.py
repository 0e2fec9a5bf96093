"""A record of answers that are paid for: each is on disk as soon as it comes, and each key is asked for once.

Rows (id, prompt) go to a data source's writer, which asks and appends a JSON line at once to a file of its own task and attempt, in the record's
folder `_open`. A task that is made again first reads what earlier attempts of it have recorded, and asks only for the rest. The commit
renames the files of the attempts that count to part-*.jsonl and drops the others; an abort leaves all as they are, and the next call takes
their whole lines into the record before it asks for anything. So a lost task, job or driver costs no call twice, but one under way.

Files are opened by pyarrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

LINES = "id string, raw string, error string"


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """Files of a folder, in order; none if it isn't there."""
    from pyarrow import fs

    where, inner = filesystem(path)
    found = where.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File)


def whole_lines(where, path: str) -> Iterator[dict]:
    """Lines of a file that was perhaps cut off."""
    with where.open_input_file(path) as file:
        for line in file.read().split(b"\n")[:-1]:
            yield json.loads(line)


@dataclass
class Told(WriterCommitMessage):
    task: int
    file: str


class AnswerWriter(DataSourceWriter):
    def __init__(self, path: str, job: str, load: Callable[[], Callable[[str], tuple[str | None, str | None]]]):
        self.path, self.job, self.load = path.rstrip("/"), job, load

    def _attempts(self, task: int) -> list[str]:
        return [f for f in listed(f"{self.path}/_open") if f.rsplit("/", 1)[-1].startswith(f"{self.job}-{task:06d}-")]

    def write(self, iterator) -> Told:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        where, inner = filesystem(self.path)
        where.create_dir(f"{inner}/_open", recursive=True)
        known = {row["id"]: row for file in self._attempts(task) for row in whole_lines(where, file)}
        own, ask = f"{inner}/_open/{self.job}-{task:06d}-{uuid.uuid4().hex}.jsonl", None
        with where.open_output_stream(own) as out:
            for row in iterator:
                line = known.get(row["id"])
                if line is None:
                    ask = ask or self.load()
                    raw, error = ask(row["prompt"])
                    line = {"id": row["id"], "raw": raw, "error": error}
                out.write(json.dumps(line, ensure_ascii=False).encode() + b"\n")
                out.flush()
        return Told(task, own)

    def commit(self, messages) -> None:
        where, inner = filesystem(self.path)
        for told in (m for m in messages if m is not None):
            where.move(told.file, f"{inner}/part-{told.file.rsplit('/', 1)[-1]}")
            for other in self._attempts(told.task):
                where.delete_file(other)

    def abort(self, messages) -> None:
        """What was answered stays in _open, for the next call."""


def _recover(spark: SparkSession, path: str) -> None:
    """Takes answers of jobs that were lost into the record, each id once."""
    where, inner = filesystem(path)
    left = listed(f"{path}/_open")
    if not left:
        return
    lines = spark.read.schema(LINES).option("mode", "DROPMALFORMED").json(f"{path}/_open").filter("id is not null").dropDuplicates(["id"])
    new = lines.join(record(spark, path).select("id"), "id", "left_anti").select("id", "raw", "error")
    stage = f"_recovered-{uuid.uuid4().hex}"
    new.write.json(f"{path}/{stage}")
    for i, file in enumerate(f for f in listed(f"{path}/{stage}") if f.rsplit("/", 1)[-1].startswith("part-")):
        where.move(file, f"{inner}/part-{stage[1:]}-{i:06d}.jsonl")
    where.delete_dir(f"{inner}/{stage}")
    for file in left:
        where.delete_file(file)


def record(spark: SparkSession, path: str) -> DataFrame:
    """(id, raw, error) of all answers in the record."""
    if not any(f.rsplit("/", 1)[-1].startswith("part-") for f in listed(path)):
        return spark.createDataFrame([], LINES)
    return spark.read.schema(LINES).json(f"{path.rstrip('/')}/part-*")


def ask_all(items: DataFrame, load: Callable[[], Callable[[str], tuple[str | None, str | None]]], path: str) -> DataFrame:
    """Asks for items (id, prompt) that the record at path doesn't have, and returns the record. load runs once a task and gives a function
    from a prompt to (answer, error). Of items of one id one is asked for; a null id is none."""
    spark = items.sparkSession
    _recover(spark, path)
    left = items.select(F.col("id").cast("string").alias("id"), F.col("prompt").cast("string").alias("prompt")).filter("id is not null").dropDuplicates(["id"])
    left = left.join(record(spark, path).select("id"), "id", "left_anti")
    job = uuid.uuid4().hex

    class Answers(DataSource):
        @classmethod
        def name(cls) -> str:
            return "lexforge_answers"

        def writer(self, schema, overwrite) -> DataSourceWriter:
            return AnswerWriter(path, job, load)

    spark.dataSource.register(Answers)
    left.write.format("lexforge_answers").mode("append").save()
    return record(spark, path)
