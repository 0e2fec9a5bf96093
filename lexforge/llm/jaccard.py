"""Near copies by Jaccard similarity of word shingles: fingerprints and MinHash bands propose pairs, whole texts confirm them exactly.

The tiled comparison of `simhash` proposes pairs within its radius; at the least similarity fingerprints of two texts may differ in many
more bits, so bands propose the others.

Shingles are those of `simhash` (of `words` words; fewer words: the whole sequence as one; none: none), as a set of XXH64 values. Texts of
one set form a class. Classes that agree in all ROWS minima of one of BANDS bands meet in a bucket, which a pair at similarity s does with
probability 1 - (1 - s^ROWS)^BANDS: all but 3 pairs in a million at 0.8, fewer above. A bucket's members are compared with its hub first;
where members of a bucket are in different components after that, they are compared with each other, so each pair that meets is either
compared or connected. A link is a pair whose exact similarity is LEAST or more. Work grows with the input, but for buckets of many
classes that are alike and yet under LEAST: those are compared tile by tile, each pair of tiles by matrix products.

Defined cases: texts without words form one class; a null id orders before all; repeated rows are one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .components import components, forest
from .simhash import SEED, print_of, shingle_hashes
from .simhash import links as simhash_links

BANDS, ROWS = 24, 4
#: Least similarity of a link, as a fraction.
LEAST = (4, 5)
#: Shingles hashed at once; classes of a bucket that are compared at once, and columns of their table.
CHUNK, TILE, COLUMNS = 1024, 512, 8192


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.frombuffer(shingle_hashes(text, words), np.uint64))


def bands(held: np.ndarray) -> list[int]:
    """One signed long a band, from the minima of BANDS * ROWS hash functions over a shingle set."""
    rng = np.random.default_rng(7)
    factor, add = (rng.integers(0, 2**64, BANDS * ROWS, np.uint64) for _ in range(2))
    factor |= np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), CHUNK):  # bounds the table of very long texts
        np.minimum(least, (held[at : at + CHUNK, None] * factor + add).min(0), out=least)
    data, size = least.tobytes(), 8 * ROWS
    return [xxhash.xxh64_intdigest(data[k * size : (k + 1) * size], k) - 2**63 for k in range(BANDS)]


def alike(sizes_a, sizes_b, both):
    """Whether exact similarity is LEAST or more, from the sizes of two sets and of their intersection."""
    return both * LEAST[1] >= (sizes_a + sizes_b - both) * LEAST[0]


def shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a (places in the list) with sets b."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    at = np.cumsum(often) - 1
    kept = often[column]
    owner, column, width = owner[kept], at[column[kept]], int(often.sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, width, COLUMNS):  # bounds the table of large sets
        part = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        have = np.zeros((len(sets), min(COLUMNS, width - lo)), np.float32)
        have[owner[part], column[part] - lo] = 1
        out += have[a] @ have[b].T
    return out.astype(np.int64)


def _hub_links(scratch: Scratch, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are links."""
    read = pairs.join(sets.select(F.col("c").alias("b"), F.col("held").alias("sb")), "b").join(sets.select(F.col("c").alias("a"), F.col("held").alias("sa")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(bool(alike(len(one), len(two), len(np.intersect1d(one, two, assume_unique=True)))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    small_batches(pairs.sparkSession, 64)
    return scratch.save(read.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "hub_links")


def _open_links(scratch: Scratch, open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that connect what can be connected of the open buckets, (band, tiles, c, root), compared tile by tile."""
    tile = F.pmod(F.xxhash64("c"), F.col("tiles")).alias("tile")
    tiles = scratch.save(open_.groupBy("band", tile).agg(F.sort_array(F.collect_list(F.struct("c", "root"))).alias("held")), "tiles")
    one, two = (tiles.select("band", F.col("tile").alias(f"t{i}"), F.col("held").alias(f"h{i}")) for i in (1, 2))
    met = one.join(two, "band").filter("t1 <= t2").select(F.when(F.col("t1") < F.col("t2"), F.col("h1")).alias("h1"), "h2")
    # The same classes often meet in several bands.
    met = scratch.save(met.withColumn("id", F.xxhash64("h1", "h2")).dropDuplicates(["id"]), "tile_pairs")
    flat = met.select("id", F.lit(True).alias("first"), F.explode("h1").alias("m")).unionByName(met.select("id", F.lit(False).alias("first"), F.explode("h2").alias("m")))
    flat = flat.select("id", "first", "m.c", "m.root").join(sets, "c")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        held, first = [np.frombuffer(x, np.uint64) for x in group["held"]], group["first"].to_numpy(bool)
        c, root, n = group["c"].to_numpy(), group["root"].to_numpy(), np.array([len(x) for x in held])
        b = np.flatnonzero(~first)
        a = np.flatnonzero(first) if first.any() else b
        x, y = np.nonzero(alike(n[a][:, None], n[b][None], shared(held, a, b)) & (root[a][:, None] != root[b][None]))
        keep = forest(root[a[x]], root[b[y]])
        return pd.DataFrame({"a": c[a[x]][keep], "b": c[b[y]][keep]})

    return scratch.save(flat.groupBy("id").applyInPandas(compare, "a long, b long"), "open_links")


def _print_pairs(scratch: Scratch, classes: DataFrame, radius: int) -> DataFrame:
    """(a, b): pairs of classes whose fingerprints the tiled comparison links, or are the same: a class of each fingerprint stands for it."""
    first = scratch.save(classes.filter("n > 0").groupBy("fp").agg(F.min("c").alias("c")), "first")
    same = classes.filter("n > 0").select("fp", F.col("c").alias("b")).join(first, "fp").filter("b != c").select(F.col("c").alias("a"), "b")
    near = simhash_links(scratch, first.select("fp"), radius)
    one, two = (first.select(F.col("fp").alias(k), F.col("c").alias(f"c{k}")) for k in "ab")
    return near.join(one, "a").join(two, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).unionByName(same)


def linked(scratch: Scratch, classes: DataFrame, rows: DataFrame, words: int, radius: int) -> DataFrame:
    """(node, root) of the classes (c, n, fp, bands, k1, k2) that have a link; rows: (_k1, _k2, text)."""
    close = scratch.save(_print_pairs(scratch, classes, radius), "close")
    posted = classes.filter("n > 0").select("c", "n", "k1", "k2", F.explode("bands").alias("band"))
    hubs = posted.groupBy("band").agg(F.min(F.struct("c", "n")).alias("hub"), F.count("*").alias("m")).filter("m > 1")
    met = scratch.save(posted.join(hubs, "band"), "met")
    wanted = met.select("c").unionByName(close.select(F.col("a").alias("c"))).unionByName(close.select(F.col("b").alias("c"))).distinct()
    # Written, so that its size is known before texts are joined to it: where it is small, they need not travel.
    keys = scratch.save(classes.join(wanted, "c", "left_semi").select("c", F.col("k1").alias("_k1"), F.col("k2").alias("_k2")), "wanted")
    texts = rows.select("_k1", "_k2", "text").join(keys, ["_k1", "_k2"]).select("c", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py(), words).tobytes() for x in batch.column(1)], pa.binary())], ["c", "held"])

    small_batches(classes.sparkSession)
    sets = scratch.save(texts.dropDuplicates(["c"]).mapInArrow(run, "c long, held binary"), "sets")
    sizes = F.least("n", "hub.n") * LEAST[1] >= F.greatest("n", "hub.n") * LEAST[0]  # others can't be alike
    hubbed = met.filter((F.col("c") != F.col("hub.c")) & sizes).select(F.col("hub.c").alias("a"), F.col("c").alias("b"))
    links = _hub_links(scratch, hubbed.unionByName(close).distinct(), sets)
    stars = components(scratch, links)
    placed = met.join(stars, met["c"] == stars["node"], "left").select("band", F.ceil(F.col("m") / TILE).alias("tiles"), "c", F.coalesce("root", "c").alias("root"))
    placed = scratch.save(placed, "placed")
    apart = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("band")
    more = _open_links(scratch, placed.join(apart, "band", "left_semi"), sets)
    return components(scratch, links.unionByName(more), "all_stars")


def one_of_each(scratch: Scratch, docs: DataFrame, words: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of docs with the longest text (then the smallest id) of each component; of repeated rows one."""
    keys = [F.xxhash64(id_col, text_col).alias("_k1"), F.xxhash64(text_col, id_col, F.lit(1)).alias("_k2")]
    rows = docs.select(*keys, F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(3)]
            hashes = [shingle_hashes(t, words) for t in texts]
            sets = [np.unique(np.frombuffer(h, np.uint64)) for h in hashes]
            values = [
                pa.array([len(t or "") for t in texts], pa.int64()),
                pa.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) - 2**63 for x in sets], pa.int64()),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([print_of(h) for h in hashes], pa.int64()),
                pa.array([bands(x) if len(x) else [] for x in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *values], ["k1", "k2", "doc_id", "size", "c", "n", "fp", "bands"])

    narrow = rows.select("_k1", "_k2", "doc_id", "text").mapInArrow(run, "k1 long, k2 long, doc_id long, size long, c long, n long, fp long, bands array<long>")
    prints = scratch.save(narrow, "prints")
    order = F.struct((-F.col("size")).alias("size"), "doc_id", "k1", "k2", "n", "fp", "bands")
    # The best of each class first, so that a text that many documents share meets its root as one row.
    classes = scratch.save(prints.groupBy("c").agg(F.min(order).alias("best")).select("c", "best.*"), "classes")
    stars = linked(scratch, classes, rows, words, radius)
    first = F.struct("size", "doc_id", "k1", "k2")
    best = classes.join(stars, classes["c"] == stars["node"], "left").groupBy(F.coalesce("root", "c").alias("root")).agg(F.min(first).alias("best"))
    stay = best.select(F.col("best.k1").alias("_k1"), F.col("best.k2").alias("_k2"))
    return rows.select("_k1", "_k2", "row").join(stay, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("row.*")
