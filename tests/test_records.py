"""The extraction as a stream: equal to the batch version in any split, and after a run that broke off."""

import random

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import corpus
from lexforge.streaming import records

SCHEMA = "ordinal long, doc_id string, text string"
KNOBS = {"banned": ["bad"], "low": 10, "high": 60}


def documents(n=160):
    rng = random.Random(8)
    texts = [f"text number {k} of some length" for k in range(45)] + ["short", "y" * 99, "a bad text of some length", "known text of some length", None]
    rows = [(k, rng.choice([None, "x", *map(str, range(60))]), rng.choice(texts)) for k in range(n)]
    return rows + [(n + k, "hot", rng.choice(texts)) for k in range(30)]


def excluded(spark):
    known = spark.createDataFrame([("known text of some length",)], "text string").select(T.text_hash(F.col("text")).alias("text_hash"))
    return {"exclude_ids": spark.createDataFrame([("7",), ("11",)], "doc_id string"), "exclude_hashes": known}


def as_batch(spark, rows, target):
    kept, counters = corpus.collect_documents(spark.createDataFrame(rows, SCHEMA), target=target, **excluded(spark), **KNOBS)
    return sorted(r.ordinal for r in kept.collect()), sorted(tuple(r) for r in counters.collect())


def feed(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def found(spark, root, target):
    return sorted(r.ordinal for r in records.kept(spark, root).collect()), sorted(tuple(r) for r in records.counters(spark, root, target).collect())


@pytest.mark.parametrize(("cuts", "target", "a_time"), [([70, 71, 190], 1000, 1), ([50, 190], 23, None)])
def test_stream_equals_batch(spark, tmp_path, cuts, target, a_time):
    """Runs at the cuts; with a_time, a file a batch, so that a run has several."""
    rows, root = documents(), str(tmp_path / "out")
    at = 0
    for cut in cuts:
        for i in range(at, cut, 65):
            feed(spark, rows[i : min(cut, i + 65)], str(tmp_path / "in"))
        at, reader = cut, spark.readStream.schema(SCHEMA)
        stream = (reader.option("maxFilesPerTrigger", a_time) if a_time else reader).parquet(str(tmp_path / "in"))
        records.collect_stream(stream, root, target=target, **excluded(spark), **KNOBS)
    want = as_batch(spark, rows, target)
    assert found(spark, root, target) == want
    if target == 1000:
        assert sum(n for _, n, _ in want[1]) == len(rows) == records.told(spark, root).count() and {r for r, _, _ in want[1]} == {"length", "overlap_id", "overlap_text", "duplicate_id", "duplicate_text", "adult", "kept"}
    with pytest.raises(ValueError, match="other settings"):
        records.collect_stream(stream, root, target=target + 1, **excluded(spark), **KNOBS)


def test_a_run_that_breaks_is_taken_up(spark, tmp_path, monkeypatch):
    rows, root, source = documents(), str(tmp_path / "out"), str(tmp_path / "in")
    for i in range(0, len(rows), 50):
        feed(spark, rows[i : i + 50], source)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    whole = records._take
    for stop in (2, 3):  # in the third batch, and in the fourth after it has written

        def broken(rows, number, *more, stop=stop):
            if number == stop == 2:
                raise RuntimeError("stopped")
            whole(rows, number, *more)
            if number == stop:
                raise RuntimeError("stopped")

        monkeypatch.setattr(records, "_take", broken)
        with pytest.raises(Exception, match="stopped"):
            records.collect_stream(stream(), root, target=1000, **excluded(spark), **KNOBS)
        monkeypatch.undo()
    records.collect_stream(stream(), root, target=1000, **excluded(spark), **KNOBS)
    assert found(spark, root, 1000) == as_batch(spark, rows, 1000)


def test_keys_are_forgotten_after_their_time(spark, tmp_path):
    root, source = str(tmp_path / "out"), str(tmp_path / "in")
    none = {"exclude_ids": spark.createDataFrame([], "doc_id string"), "exclude_hashes": spark.createDataFrame([], "text_hash string")}
    run = lambda: records.collect_stream(spark.readStream.schema(SCHEMA).parquet(source), root, target=1000, ttl_ms=1, **none, **KNOBS)
    for k in range(3):  # the state learns of the first in the second run, and has forgotten it in the third
        feed(spark, [(k, "same", "the same text of some length")], source)
        run()
    assert [r.reason for r in records.told(spark, root).orderBy("ordinal").collect()] == ["kept", "duplicate_id", "kept"]
