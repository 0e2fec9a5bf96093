"""Sharding by extendible hashing, in DataFrame operations only.

Every row gets a 60-bit hash. A directory indexed by hash-prefix bits starts as one bucket; only a bucket that is over its byte
limit splits on another bit, until every bucket fits. Buckets are never built one split at a time: bytes are summed per prefix at
one depth, the sums are rolled up to every shorter prefix, and a row's bucket is its shortest prefix that fits. Prefixes that are
still over the limit at that depth go on, alone, for another round of bits.

Defined cases: a null text weighs `row_bytes` only; a null id hashes as the empty string; repeated rows share one hash, so rows that
agree in all 60 bits stay in one shard even over its limit (nothing can split them). An empty table gives no rows. Columns beyond id and
text are not read and may bear any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bits of the hash; 15 hex digits of an MD5.
HASH_BITS = 60
#: Bits past the expected depth that one round of sums covers.
SPARE_BITS = 6
#: Bytes counted for a row beside its text.
ROW_BYTES = 16


def hashed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))
    return docs.select(
        F.col(id_col).alias("id"),
        F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + row_bytes).cast("long").alias("bytes"),
    )


def _prefix(depth, h="h"):
    return F.expr(f"shiftright({h}, {HASH_BITS} - {depth})")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Buckets (depth, prefix, shard_bytes) of hashed rows (h, bytes): disjoint, covering, each within limit unless one hash alone exceeds it."""
    total = rows.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    low, found, rest = 0, None, rows
    while True:
        high = min(HASH_BITS, low + max(1, (-(-total // limit)).bit_length()) + SPARE_BITS)
        fine = rest.groupBy(_prefix(high).alias("p")).agg(F.sum("bytes").alias("b"))
        sums = (
            fine.select("b", "p", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
            .groupBy("depth", F.expr(f"shiftright(p, {high} - depth)").alias("prefix"))
            .agg(F.sum("b").alias("shard_bytes"))
        )
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == HASH_BITS)
        # A bucket is a fitting prefix whose parent did not fit: the parents over the limit are few, at most two children each.
        over = sums.filter(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        leaves = sums.filter(fits)
        leaf = leaves.filter(F.col("depth") == low).unionByName(
            leaves.join(over, (leaves["depth"] == over["depth"]) & (_shift(leaves["prefix"]) == over["parent"]), "left_semi").filter(F.col("depth") > low)
        )
        found = leaf if found is None else found.unionByName(leaf)
        if high == HASH_BITS:
            return found
        stuck = sums.filter((F.col("depth") == high) & ~fits)
        worst = stuck.agg(F.max("shard_bytes").alias("b")).first()["b"]
        if worst is None:
            return found
        rest = rest.withColumn("q", _prefix(high)).join(stuck.select(F.col("prefix").alias("q")), "q", "left_semi").drop("q")
        low, total = high, worst


def _shift(column):
    return F.shiftright(column, 1)


def extendible_shards(scratch: Scratch, docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """(id, h, bytes, depth, prefix, shard, shard_bytes) of every row; shard is the bucket's bits as a string of depth digits."""
    rows = scratch.save(hashed_rows(docs, id_col, text_col, row_bytes), "hashed")
    leaves = scratch.save(directory(rows, limit), "directory")
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect()) or [0]  # at most HASH_BITS + 1 of them
    # A row looks itself up at each depth that has buckets and finds itself exactly once.
    probes = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths])))
    probes = probes.withColumn("prefix", F.expr(f"shiftright(h, {HASH_BITS} - depth)"))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return probes.join(leaves, ["depth", "prefix"]).withColumn("shard", bits)
