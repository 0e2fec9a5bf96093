"""The corpus extraction as a stream: the same reasons as `corpus.collect_documents`, in whatever batches rows arrive.

Two rows may clash by id or by text, so what a row becomes depends on two keys. Each row asks for both in one stateful operator
(`transformWithState` over RocksDB), keyed by "i:<id>" or "t:<text hash>", which remembers the keys of accepted rows and answers whether a key
was accepted in an earlier batch. The batch's rows and answers meet in `foreachBatch`, where the sequential rule is applied to what is left,
and everything is written to folders that carry the batch's number, so a batch that is repeated overwrites its own results. The keys of
accepted rows are among them, and that folder is a second source of the same stream: so the state learns what was decided.

A run may hold several batches, and those before it may not have been fed back; their keys are joined from the folder (`runs` tells since when).

What arrives is asked for once per key and Arrow batch of a task, so a key that very many rows have reaches its state as a few rows. Texts
don't pass through the state. With `ttl_ms` a key is forgotten that long after it was accepted, which bounds the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.corpus import prepared, reasons, up_to_target
from ..plans.written import remove, temporary, written
from .incremental import require_same_settings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the run's own session: they are read when a stream starts.
CONF = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
NO_ID = "\0"


class AcceptedKeys(StatefulProcessor):
    """Per key whether a row that has it was accepted; answers (key) if one was before this batch."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.accepted = handle.getValueState("accepted", "at int", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        told, asked = False, False
        for row in rows:
            told, asked = told or row.accepted, asked or not row.accepted
        known = told or self.accepted.exists()
        if told:
            self.accepted.update((1,))
        if asked and known:
            yield Row(key=key[0])

    def close(self) -> None:
        pass


def once_a_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of each Arrow batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([])
        yield from table.select(batch.schema.names).to_batches()


def keys_of(rows: DataFrame) -> DataFrame:
    """(key) of rows (doc_id, text_hash): both of their keys."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(NO_ID))
    return rows.select(F.explode(F.array(F.concat(F.lit("i:"), own), F.concat(F.lit("t:"), "text_hash"))).alias("key"))


def collect_stream(
    stream: DataFrame,
    root: str,
    *,
    target: int,
    exclude_ids: DataFrame,
    exclude_hashes: DataFrame,
    banned: list[str],
    low: int = 500,
    high: int = 4000,
    ttl_ms: int | None = None,
) -> None:
    """Takes what has arrived of a stream (ordinal, doc_id, text), and ends; called again, it goes on where it ended. Rows that arrive later
    have larger ordinals. Below root: `kept` rows, `reasons` of every row read, `counters`, `keys`, and the stream's checkpoint. Once the
    target is reached, nothing more is read."""
    spark, folder = stream.sparkSession, root.rstrip("/")
    require_same_settings(spark, f"{folder}/checkpoint", {"target": target, "banned": sorted(banned), "low": low, "high": high, "ttl_ms": ttl_ms})
    if total(spark, folder) >= target:
        return
    at = _next_batch(spark, folder)
    spark.createDataFrame([(at,)], "first long").coalesce(1).write.mode("append").parquet(f"{folder}/runs")
    made = prepared(stream, banned, low, high).withColumn("doc_id", F.col("doc_id").cast("string"))
    made = made.withColumn("key", F.lit(None).cast("string"))
    _make_folder(spark, f"{folder}/keys")
    fed = spark.readStream.schema("key string, batch long").parquet(f"{folder}/keys").select("key", F.lit(True).alias("accepted"))
    asked = keys_of(made.filter("fits")).select("key", F.lit(False).alias("accepted"))
    known = fed.unionByName(asked).mapInArrow(once_a_batch, "key string, accepted boolean").groupBy("key")
    known = known.transformWithState(AcceptedKeys(ttl_ms), "key string", "Append", "None" if ttl_ms is None else "ProcessingTime")
    both = made.unionByName(known, allowMissingColumns=True)

    def take(batch: DataFrame, number: int) -> None:
        with temporary(batch.sparkSession):
            _take(written(batch), number, folder, stream.columns, target, exclude_ids, exclude_hashes)

    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    try:
        query = both.writeStream.outputMode("append").foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def _take(rows: DataFrame, number: int, folder: str, columns: list[str], target: int, exclude_ids: DataFrame, exclude_hashes: DataFrame) -> None:
    """Decides a batch (rows, and with a key the answers of the state) and writes its results."""
    spark = rows.sparkSession
    docs = rows.filter("key is null")
    known = rows.filter("key is not null").select("key")
    recent = _table(spark, folder, "keys", "key string, batch long")
    if recent is not None:  # batches that the state may not have been told of when this one was planned
        known = known.unionByName(recent.filter((F.col("batch") >= _fed_from(spark, folder, number)) & (F.col("batch") < number)).select("key"))
    kind, value = F.substring("key", 1, 2), F.expr("substring(key, 3)")
    ids = known.filter(kind == "i:").select(F.when(value != NO_ID, value).alias("doc_id"))
    hashes = known.filter(kind == "t:").select(value.alias("text_hash"))
    narrow = docs.select("ordinal", "doc_id", "text_hash", "fits", "adult")
    excluded = exclude_ids.select(F.col("doc_id").cast("string").alias("doc_id"))
    told = written(reasons(narrow, exclude_ids=excluded, exclude_hashes=exclude_hashes, seen_ids=ids, seen_hashes=hashes))
    left = target - total(spark, folder, number)
    read = written(up_to_target(told, left)[0])
    kept = docs.join(read.filter("reason = 'kept'").select("ordinal"), "ordinal", "left_semi")
    out = {
        "kept": kept.select(*columns, "text_hash"),
        "reasons": read,
        "keys": keys_of(kept),
        "counters": read.groupBy("reason").agg(F.count("*").alias("n")),  # the last: a batch counts once all of it is there
    }
    for name, table in out.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")


def _make_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(where)


def _batches(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the batches that wrote a table; names of folders, one a batch."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = files.listStatus(where) if files.exists(where) else []
    return sorted(int(n[6:]) for n in (x.getPath().getName() for x in found) if n.startswith("batch="))


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame | None:
    return spark.read.schema(schema).parquet(f"{folder}/{name}") if _batches(spark, folder, name) else None


def _next_batch(spark: SparkSession, folder: str) -> int:
    done = _batches(spark, folder, "counters")
    return done[-1] + 1 if done else 0


def _fed_from(spark: SparkSession, folder: str, number: int) -> int:
    """A batch from which on keys may not have been fed when batch `number` was planned: the first of the run before its own, since a
    batch that a broken run planned may be taken by the next one."""
    firsts = sorted({r["first"] for r in spark.read.schema("first long").parquet(f"{folder}/runs").collect() if r["first"] <= number})  # a number a run
    return firsts[-2] if len(firsts) > 1 else 0


def total(spark: SparkSession, folder: str, before: int | None = None) -> int:
    """Rows kept so far, or by batches before a number."""
    table = _table(spark, folder, "counters", "reason string, n long, batch long")
    if table is None:
        return 0
    rows = table.filter("reason = 'kept'")
    return (rows if before is None else rows.filter(F.col("batch") < before)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def counters(spark: SparkSession, folder: str, target: int) -> DataFrame:
    """(reason, n, stream_exhausted) over all batches."""
    table = spark.read.schema("reason string, n long, batch long").parquet(f"{folder}/counters")
    exhausted = total(spark, folder) < target
    return table.groupBy("reason").agg(F.sum("n").alias("n")).withColumn("stream_exhausted", F.lit(exhausted))


def kept(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/kept").drop("batch")


def told(spark: SparkSession, folder: str) -> DataFrame:
    """(ordinal, reason) of every row that was read."""
    return spark.read.schema("ordinal long, reason string, batch long").parquet(f"{folder}/reasons").drop("batch")


def forget(spark: SparkSession, folder: str) -> None:
    """Removes an extraction whole: results, state and checkpoint."""
    remove(spark, folder)
    remove(spark, f"{folder}/checkpoint-settings")
