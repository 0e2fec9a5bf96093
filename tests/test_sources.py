"""Sources and sinks that plan or commit by themselves: row groups, answers."""

import json
import os
from glob import glob

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexforge.sources import answers, readers, row_groups, snapshots


@pytest.fixture
def table(tmp_path):
    """Two files, 6 row groups of 100 and one of 30."""
    folder = tmp_path / "table"
    folder.mkdir()
    at = 0
    for name, n in (("a.parquet", 400), ("b.parquet", 230)):
        rows = pa.table({"id": pa.array(range(at, at + n)), "text": [f"t{k}" for k in range(at, at + n)], "wide": ["x" * 50] * n})
        pq.write_table(rows, folder / name, row_group_size=100)
        at += n
    return str(folder)


def brute(folder, target, seed, salt, least):
    """The same draw, row group by row group, over the whole table."""
    import hashlib

    groups = []
    for path in sorted(glob(f"{folder}/*.parquet")):
        file = pq.ParquetFile(path)
        for g in range(file.metadata.num_row_groups):
            key = hashlib.sha256(f"{seed}:{salt}:{os.path.basename(path)}:{g}".encode()).hexdigest()
            groups.append((key, os.path.basename(path), g, file.read_row_group(g).column("id").to_pylist()))
    share = min(1.0, max(least, 2 * target / sum(len(x) for *_, x in groups)))
    out, read = [], 0
    for _, name, g, ids in sorted(groups):
        if len(out) >= target:
            break
        read += 1
        out += [ids[i] for i in row_groups.drawn_rows(seed, salt, name, g, len(ids), len(ids) if share >= 1 else round(share * len(ids)))]
    return out[:target], read


@pytest.mark.parametrize(("target", "least"), [(10, 0.02), (10, 0.5), (200, 0.02), (630, 0.02), (9999, 0.02), (0, 0.02)])
def test_random_rows(spark, table, target, least):
    rows, info = row_groups.random_rows(spark, table, target, 7, "en", ["text", "id"], least)
    want, read = brute(table, target, 7, "en", least)
    got = rows.orderBy("ordinal").collect()
    assert [r.id for r in got] == want and [r.ordinal for r in got] == list(range(len(want))) and rows.columns == ["text", "id", "ordinal"]
    assert all(r.text == f"t{r.id}" for r in got)
    assert (info["row_groups"], info["files"], info["total_rows"], info["row_groups_read"]) == (7, 2, 630, read)
    assert rows.rdd.getNumPartitions() == max(1, read)  # a row group that isn't needed isn't opened


def test_draws_differ_by_seed_and_salt(spark, table):
    draw = lambda *a: [r.id for r in row_groups.random_rows(spark, table, 50, *a)[0].orderBy("ordinal").collect()]
    assert draw(1, "en") == draw(1, "en") != draw(2, "en") != draw(1, "km")
    with pytest.raises(ValueError):
        row_groups.random_rows(spark, table, 5, 1, columns=["ordinal"])


def asker(calls, broken=()):
    def load():
        def ask(prompt):
            with open(calls, "a") as file:
                file.write(prompt + "\n")
            if prompt in broken and not os.path.exists(f"{calls}.mended"):
                raise RuntimeError("the machine is gone")
            return (None, "refused") if prompt == "p3" else (json.dumps({"edu": int(prompt[1:]) % 6}), None)

        return ask

    return load


def test_no_answer_is_paid_twice(spark, tmp_path):
    path, calls = str(tmp_path / "record"), str(tmp_path / "calls")
    items = spark.createDataFrame([(str(k), f"p{k}") for k in range(40)] + [("5", "p5"), (None, "p99")], "id string, prompt string").repartition(3)
    with pytest.raises(Exception, match="gone"):
        answers.ask_all(items, asker(calls, broken={"p17"}), path)
    paid = open(calls).read().split()
    assert "p17" in paid and not glob(f"{path}/part-*")
    open(f"{glob(f'{path}/_open/*')[0]}", "ab").write(b'{"id": "cut o')  # a line that was under way
    open(f"{calls}.mended", "w").close()
    got = {r.id: (r.raw, r.error) for r in answers.ask_all(items, asker(calls, broken={"p17"}), path).collect()}
    assert sorted(got, key=int) == [str(k) for k in range(40)] and got["3"] == (None, "refused") and got["8"] == ('{"edu": 2}', None)
    asked = open(calls).read().split()
    assert asked.count("p17") >= 2 and all(asked.count(f"p{k}") == 1 for k in range(40) if k != 17)
    more = items.unionByName(spark.createDataFrame([("100", "p100")], "id string, prompt string"))
    n = len(asked)
    assert answers.ask_all(more, asker(calls), path).count() == 41 and open(calls).read().split()[n:] == ["p100"]
    assert not os.listdir(f"{path}/_open")


def test_an_attempt_reads_what_the_one_before_recorded(tmp_path, monkeypatch):
    from types import SimpleNamespace

    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 4)))
    path, calls = str(tmp_path / "record"), str(tmp_path / "calls")
    rows = [{"id": str(k), "prompt": f"p{k}"} for k in range(6)]
    writer = answers.AnswerWriter(path, "job", asker(calls, broken={"p4"}))
    with pytest.raises(RuntimeError):
        writer.write(iter(rows))
    open(f"{calls}.mended", "w").close()
    writer.commit([writer.write(iter(rows)), None])
    assert open(calls).read().split() == ["p0", "p1", "p2", "p3", "p4", "p4", "p5"]
    assert len(glob(f"{path}/part-*")) == 1 and not os.listdir(f"{path}/_open")


def test_snapshots(spark, tmp_path):
    from pyspark.sql import functions as F

    source, folder = tmp_path / "table" / "table", f"file://{tmp_path}/releases"
    source.mkdir(parents=True)
    put = lambda name, n, **more: pq.write_table(pa.table({"id": list(range(n)), "text": ["t"] * n, **more}), source / name)
    put("a.parquet", 3)
    put("b.parquet", 4)
    publish = lambda **checks: snapshots.publish(spark, str(source), folder, ["id", "text"], checks)
    first = publish()
    assert publish() == first == snapshots.current(folder)
    put("a.parquet", 5)
    (source / "b.parquet").rename(source / "c.parquet")
    second = publish()
    assert {(r.name, r.change) for r in snapshots.difference(spark, folder, first, second).collect()} == {("a.parquet", "changed"), ("b.parquet", "removed"), ("c.parquet", "added")}
    objects = [x for x in os.listdir(tmp_path / "releases/objects") if not x.startswith(".")]
    assert len(objects) == 3  # the file that only changed its name is stored once
    put("d.parquet", 2, owner=["x", "y"])
    with pytest.raises(ValueError, match="may not be released"):
        snapshots.publish(spark, str(source), folder, ["id", "text"])
    (source / "d.parquet").unlink()
    with pytest.raises(ValueError, match="many"):
        publish(many=F.col("id") > 3)
    assert snapshots.current(folder) == second
    fetch = lambda: sorted((r.name, r.fetched) for r in snapshots.fetch(spark, folder, f"file://{tmp_path}/got", first).collect())
    assert fetch() == [("a.parquet", True), ("b.parquet", True)] and spark.read.parquet(str(tmp_path / "got")).count() == 7
    (tmp_path / "got/b.parquet").write_bytes(b"cut")
    assert fetch() == [("a.parquet", False), ("b.parquet", True)]
    snapshots.point(folder, first)
    assert snapshots.current(folder) == first and snapshots.manifest(spark, folder).count() == 2
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.point(folder, "nothing")


def test_lines_are_numbered_over_splits(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines = {"a.txt": [f"line {k} {'x' * (k % 50)}" for k in range(3000)], "b.txt": ["only"], "c.txt": []}
    for name, held in lines.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in held))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        rows = readers.numbered_lines(spark, f"{tmp_path}/*.txt")
        got = sorted((r.file.rsplit("/", 1)[-1], r.line_no, r.line) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((name, k, x) for name, held in lines.items() for k, x in enumerate(held))
