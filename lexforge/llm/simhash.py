"""SimHash near-dedup: fingerprints, then tiled exact comparison.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of `words` words joined by one space (fewer words: the whole
sequence as one shingle; none: fingerprint zero), each hashed by XXH64 with seed 42; a bit is 1 if it is set in over half the hashes.

Links: distinct fingerprints are sorted by population count (then by the counts of their four 16-bit quarters) and cut into tiles. Two
fingerprints within the radius differ by at most the radius in population count, and the differences of their quarters' counts add up to
no more than it; tile pairs, and inside a pair blocks of rows, that can't meet this are skipped. The rest is compared exactly, by
exclusive-or and bit counts. Each pair of tiles reports a spanning forest of its links, so a group of copies never yields all its pairs.

Defined cases: null and empty texts and texts without words have fingerprint zero and are linked like any other; a null id gets its
component but never names one; repeated rows get the same result; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, parts, small_batches
from .components import components, forest

#: Fingerprints of a tile: more, if there are many, so that a tile travels with fewer others; and of a block.
TILE, MOST_TILE, BLOCK = 4096, 32768, 128
SEED = 42


def shingle_hashes(text: str | None, words: int) -> bytes:
    """The hashes of a text's shingles, 8 bytes each."""
    found = (text or "").encode().lower().split()
    if not found:
        return b""
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    if len(found) <= words:
        return digest(joined, SEED)
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)])


def print_of(hashes: bytes) -> int:
    """The fingerprint of these hashes as a signed long; repeats count."""
    if not hashes:
        return 0
    n = len(hashes) // 8
    count = np.zeros(64, np.int64)
    for at in range(0, n, 8192):  # bounds the unpacked bits of very long texts
        bits = np.unpackbits(np.frombuffer(hashes[8 * at : 8 * (at + 8192)], np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(count * 2 > n).view(">u8")[0].astype(np.int64))


def fingerprint(text: str | None, words: int = 3) -> int:
    """A text's fingerprint as a signed long."""
    return print_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fps).view("<u2").reshape(-1, 4)).astype(np.int16)


def _tiles(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, in order, to tiles of up to `tile` of them."""
    held = np.zeros(0, np.uint64)

    def out(fps: np.ndarray) -> pa.RecordBatch:
        counts = np.bitwise_count(fps)
        return pa.RecordBatch.from_pydict({"lo": pa.array([int(counts.min())], pa.int32()), "hi": pa.array([int(counts.max())], pa.int32()), "fps": pa.array([fps.tobytes()], pa.binary())})

    for batch in batches:
        held = np.concatenate([held, batch.column(0).to_numpy().astype(np.int64).view(np.uint64)])
        while len(held) >= tile:
            yield out(held[:tile])
            held = held[tile:]
    if len(held):
        yield out(held)


def tile_links(one: np.ndarray, two: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between (or, for the same tile, within) two tiles of distinct fingerprints."""
    same = one is two

    def blocks(fps):
        quarters = _quarters(fps)
        cuts = range(0, len(fps), BLOCK)
        return [fps[c : c + BLOCK] for c in cuts], np.array([quarters[c : c + BLOCK].min(0) for c in cuts]), np.array([quarters[c : c + BLOCK].max(0) for c in cuts])

    (a, a_lo, a_hi), (b, b_lo, b_hi) = blocks(one), blocks(two)
    gap = np.maximum(0, np.maximum(b_lo[None] - a_hi[:, None], a_lo[:, None] - b_hi[None])).sum(2)
    found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for i, row in enumerate(gap <= radius):
        near = np.flatnonzero(row)
        if same:
            near = near[near >= i]
        if not len(near):
            continue
        against = np.concatenate([b[j] for j in near])
        x, y = np.nonzero(np.bitwise_count(a[i][:, None] ^ against[None]) <= radius)
        u, v = a[i][x], against[y]
        if same:
            u, v = u[u != v], v[u != v]
        keep = forest(u, v)
        found_a.append(u[keep])
        found_b.append(v[keep])
    u, v = np.concatenate(found_a), np.concatenate(found_b)
    keep = forest(u, v)
    return u[keep].view(np.int64), v[keep].view(np.int64)


def links(scratch: Scratch, fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp, distinct) within the radius, directly or over others."""
    spark = fps.sparkSession
    quarter = [F.bit_count(F.shiftright("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(3)]
    order = [F.bit_count("fp"), *quarter, F.col("fp")]
    n = fps.count()
    small_batches(spark, TILE)
    # Enough tiles that their pairs keep all tasks busy; beyond that larger ones, as each tile travels once for every tile it meets.
    tile = min(MOST_TILE, max(TILE, int(n / (8 * parts(spark)) ** 0.5)))
    deal = min(parts(spark), max(1, n // (4 * tile)))
    tiles = fps.select("fp").repartitionByRange(deal, *order).sortWithinPartitions(*order).mapInArrow(lambda batches: _tiles(batches, tile), "lo int, hi int, fps binary")
    tiles = scratch.save(tiles.withColumn("tile", F.monotonically_increasing_id()), "tiles")
    # Tiles are in order of population count, so the later tile of a pair begins between the earlier one's ends, or up to the radius above
    # them. There are at most 65 counts: salts deal the tiles that begin at one of them over as many tasks.
    salts = parts(spark)
    first = tiles.select(F.col("tile").alias("a"), F.explode(F.expr(f"sequence(lo, hi + {radius})")).alias("p"), F.pmod(F.xxhash64("tile"), F.lit(salts)).alias("salt"))
    second = tiles.select(F.col("tile").alias("b"), F.col("lo").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    pairs = first.join(second, ["p", "salt"]).filter("a <= b").select("a", "b")
    pairs = pairs.join(tiles.select(F.col("tile").alias("a"), F.col("fps").alias("fa")), "a").join(tiles.select(F.col("tile").alias("b"), F.col("fps").alias("fb")), "b")
    spread = max(parts(spark), -(-n // tile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, fa, fb in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                one = np.frombuffer(fa, np.uint64)
                u, v = tile_links(one, one if a == b else np.frombuffer(fb, np.uint64), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    small_batches(spark, 16)
    # Dealt by the pair itself: a tile row of pairs doesn't stay in one task.
    return pairs.select("a", "b", "fa", "fb").repartition(spread, "a", "b").mapInArrow(run, "a long, b long")


def rooted(scratch: Scratch, prints: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, root, least) of every distinct fingerprint: its component's smallest fingerprint, and its own smallest doc_id."""
    classes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = scratch.save(links(scratch, classes, radius), "links")
    stars = components(scratch, found)
    return scratch.save(classes.join(stars, classes["fp"] == stars["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")


def near_duplicates(scratch: Scratch, docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component): component is the smallest id reachable over links, null where only null ids are."""
    prints = scratch.save(fingerprints(docs, words), "prints")
    named = rooted(scratch, prints, radius)
    roots = named.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(named.select("fp", "root").join(roots, "root").select("fp", "component"), "fp").select("doc_id", "fp", "component")


def one_of_each(scratch: Scratch, docs: DataFrame, words: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of docs with the longest text (then the smallest id) of each component; of repeated rows one."""
    keys = [F.xxhash64(id_col, text_col).alias("_k1"), F.xxhash64(text_col, id_col, F.lit(1)).alias("_k2")]
    rows = docs.select(*keys, F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(3)]
            values = [pa.array([fingerprint(t, words) for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *values], ["k1", "k2", "doc_id", "fp", "size"])

    narrow = rows.select("_k1", "_k2", "doc_id", "text").mapInArrow(run, "k1 long, k2 long, doc_id long, fp long, size long")
    prints = scratch.save(narrow, "prints")
    named = rooted(scratch, prints.select("doc_id", "fp"), radius)
    order = F.struct((-F.col("size")).alias("a"), F.col("doc_id").alias("b"), F.col("k1"), F.col("k2"))
    # The best of each fingerprint first, so that a fingerprint that many documents share meets its root as one row.
    best = prints.groupBy("fp").agg(F.min(order).alias("best")).join(named, "fp").groupBy("root").agg(F.min("best").alias("best"))
    stay = best.select(F.col("best.k1").alias("_k1"), F.col("best.k2").alias("_k2"))
    return rows.select("_k1", "_k2", "row").join(stay, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("row.*")
