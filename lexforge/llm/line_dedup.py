"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

State (`LineIndex`): `refs`, one row per (line key, document); `counts`, per key its number of documents and the largest document id;
`filters`, per shard a cuckoo filter over the keys that are shared by at least `min_docs` documents. Documents can be inserted and
deleted: only the touched keys are counted again, and only keys that cross the threshold enter or leave the filters, which is what a
cuckoo filter, unlike a Bloom filter, can undo. Applying the index probes the filters first; only probable hits meet the exact table,
so a false positive of a filter costs a lookup and never a line.

Tables are kept in layers: an insert or delete writes a layer of its own rows, which covers what older layers say of the same (key,
document) or key, and the whole is written anew only once MOST_LAYERS have come together. A filter that would get fuller than it may is built
anew from the exact table, at twice the size; so are all, in more shards, when the shared keys have doubled.

A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends and with A-Z lower-cased, kept as its 16-byte MD5. Keys shorter
than `min_chars` code points never count. A shared key loses all its lines except those in its largest document id.

Defined cases: a null or empty text is one empty line; a null id counts as one document that is smaller than all others; repeated rows
of an id are one document, and each of its rows loses the same lines; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, known_id, small_batches

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of one shard's filter, and probes of one task.
SHARD_KEYS, PROBE_ROWS = 200_000, 200_000
SLOTS, KICKS = 4, 500
#: Share of a filter's slots that may be taken, and layers of the exact tables.
FULL, MOST_LAYERS = 0.8, 8


class CuckooFilter:
    """Partial-key cuckoo hashing: 16-bit fingerprints, 4 slots a bucket, two buckets a key. Keys are rows of an (n, 16) uint8 array."""

    def __init__(self, capacity: int):
        self.buckets = 1 << max(2, int(capacity / (SLOTS * FULL))).bit_length()
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)
        self.stash = np.zeros((0, 2), np.int64)  # what found no slot: exact (bucket, fingerprint) pairs

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
        mark = (words[:, 1] & np.uint64(0xFFFF)).astype(np.int64)
        mark[mark == 0] = 1
        first = (words[:, 0] % np.uint64(self.buckets)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        return bucket ^ (mark * 0x5BD1E995 % self.buckets)

    def add(self, keys: np.ndarray) -> None:
        rng = np.random.default_rng(7)
        stash = []
        for mark, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for at in (a, b):
                row = self.table[at]
                free = np.flatnonzero(row == 0)
                if free.size:
                    row[free[0]] = mark
                    break
            else:
                at = a
                for _ in range(KICKS):
                    slot = int(rng.integers(SLOTS))
                    mark, self.table[at, slot] = int(self.table[at, slot]), mark
                    at = int(self._other(at, mark))
                    free = np.flatnonzero(self.table[at] == 0)
                    if free.size:
                        self.table[at, free[0]] = mark
                        break
                else:
                    stash.append((at, mark))
        if stash:
            self.stash = np.concatenate([self.stash, np.array(stash, np.int64)])

    def remove(self, keys: np.ndarray) -> None:
        """Only keys that were added may be removed."""
        for mark, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == mark)
                if held.size:
                    self.table[at, held[0]] = 0
                    break
            else:
                held = np.flatnonzero(np.isin(self.stash[:, 0], (a, b)) & (self.stash[:, 1] == mark))
                self.stash = np.delete(self.stash, held[:1], axis=0)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(keys)
        hit = (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)
        for at, held in self.stash.tolist():
            hit |= ((a == at) | (b == at)) & (mark == held)
        return hit

    def dump(self) -> bytes:
        return np.array([self.buckets, len(self.stash)], np.int64).tobytes() + self.stash.tobytes() + self.table.tobytes()

    @staticmethod
    def read(blob: bytes) -> CuckooFilter:
        out = CuckooFilter(0)
        out.buckets, n = (int(x) for x in np.frombuffer(blob, np.int64, 2))
        out.stash = np.frombuffer(blob, np.int64, 2 * n, 16).reshape(-1, 2).copy()
        out.table = np.frombuffer(blob, np.uint16, offset=16 + 16 * n).reshape(-1, SLOTS).copy()
        return out


def _array(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    out = CuckooFilter(len(rows))
    out.add(_array(rows["key"]))
    return pd.DataFrame({"shard": rows["shard"].iloc[:1], "n": [len(rows)], "room": [int(out.buckets * SLOTS * FULL)], "filter": [out.dump()]})


FILTER = "shard int, n long, room long, filter binary"


def _change(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """A filter with the keys that leave and enter; its room holds them."""
    if not len(rows):
        return old
    enter, leave = (rows[rows["enters"] == x] for x in (True, False))
    out = CuckooFilter.read(old["filter"].iloc[0])
    out.remove(_array(leave["key"]))
    out.add(_array(enter["key"]))
    return old.assign(n=old["n"] + len(enter) - len(leave), filter=[out.dump()])


def _probe(filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    if not len(filters) or not len(rows):
        return rows[["did", "key"]].iloc[:0]
    return rows[["did", "key"]][CuckooFilter.read(filters["filter"].iloc[0]).probe(_array(rows["key"]))]


def line_key(line):
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text_col: str = "text"):
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


@dataclass(frozen=True)
class LineIndex:
    """Layers, oldest first: refs (did, key, held), counts (key, n_docs, keep)."""

    ref_layers: tuple[DataFrame, ...]
    count_layers: tuple[DataFrame, ...]
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int
    version: int = 0

    @property
    def refs(self) -> DataFrame:
        return _latest(self.ref_layers, ["did", "key"]).filter("held").select("did", "key")

    @property
    def counts(self) -> DataFrame:
        return _latest(self.count_layers, ["key"]).filter("n_docs > 0")


def _latest(layers: tuple[DataFrame, ...], key: list[str]) -> DataFrame:
    """Rows that no later layer covers. The large old layers are read, not exchanged, where the later ones are small enough to be sent."""
    out = layers[-1]
    later = layers[-1].select(*key)
    for layer in layers[-2::-1]:
        out = out.unionByName(layer.join(later, key, "left_anti"))
        later = later.unionByName(layer.select(*key))
    return out


def line_refs(docs: DataFrame, min_chars: int, text_col: str = "text") -> DataFrame:
    """The distinct (key, did) of lines that are long enough."""
    key = F.transform(lines_of(text_col), line_key)
    keys = F.array_distinct(F.transform(F.filter(key, lambda k: F.char_length(k) >= min_chars), lambda k: F.unhex(F.md5(k))))
    return docs.select(known_id().alias("did"), F.explode(keys).alias("key")).distinct()


def _counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("did").alias("keep"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _filters(scratch: Scratch, shared: DataFrame, shards: int, name: str) -> DataFrame:
    return scratch.save(shared.select("key", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(_build, FILTER), name)


def build(scratch: Scratch, docs: DataFrame, min_docs: int, min_chars: int) -> LineIndex:
    refs = scratch.save(line_refs(docs, min_chars), "refs0")
    counts = scratch.save(_counts(refs), "counts0")
    shared = counts.filter(F.col("n_docs") >= min_docs)
    shards = max(1, -(-shared.count() // SHARD_KEYS))
    return LineIndex((refs.withColumn("held", F.lit(True)),), (counts,), _filters(scratch, shared, shards, "filters0"), shards, min_docs, min_chars)


def _moved(scratch: Scratch, index: LineIndex, changed: DataFrame, fresh: DataFrame) -> LineIndex:
    """The index after a layer of refs (did, key, held) and one of counts, for the keys whose documents changed."""
    v = index.version + 1
    was = fresh.select("key").join(index.counts.filter(F.col("n_docs") >= index.min_docs).select("key", F.lit(True).alias("was")), "key", "left")
    now = F.col("n_docs") >= index.min_docs
    crossed = was.join(fresh, "key").filter(F.col("was").isNotNull() != now).select("key", now.alias("enters"), _shard(index.shards).alias("shard"))
    crossed = scratch.save(crossed, f"crossed{v}")
    ref_layers, count_layers = (*index.ref_layers, changed), (*index.count_layers, fresh)
    if len(ref_layers) > MOST_LAYERS:
        ref_layers = (scratch.save(_latest(ref_layers, ["did", "key"]).filter("held"), f"refs{v}"),)
        count_layers = (scratch.save(_latest(count_layers, ["key"]).filter("n_docs > 0"), f"counts{v}"),)
    index = replace(index, ref_layers=ref_layers, count_layers=count_layers, version=v)
    shared = index.counts.filter(F.col("n_docs") >= index.min_docs)
    more = crossed.groupBy("shard").agg(F.sum(F.when(F.col("enters"), 1).otherwise(-1)).alias("more"))
    sizes = index.filters.select("shard", "n", "room").join(more, "shard", "full").select("shard", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("room", F.lit(0)).alias("room"), F.coalesce("more", F.lit(0)).alias("more"))
    sizes = scratch.save(sizes.withColumn("full", F.col("n") + F.col("more") > F.col("room")), f"sizes{v}")  # a row a shard
    keys = sizes.agg(F.sum(F.col("n") + F.col("more"))).first()[0] or 0
    if keys > 2 * SHARD_KEYS * index.shards:
        shards = -(-keys // SHARD_KEYS)
        return replace(index, shards=shards, filters=_filters(scratch, shared, shards, f"filters{v}"))
    full = sizes.filter("full").select("shard")
    grown = shared.select("key", _shard(index.shards).alias("shard")).join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_build, FILTER)
    kept = index.filters.join(full, "shard", "left_anti").groupBy("shard").cogroup(crossed.join(full, "shard", "left_anti").groupBy("shard")).applyInPandas(_change, FILTER)
    return replace(index, filters=scratch.save(kept.unionByName(grown), f"filters{v}"))


def insert(scratch: Scratch, index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with more documents. An id that is there already gets the union of its lines."""
    v = index.version + 1
    new = line_refs(docs, index.min_chars).join(index.refs, ["did", "key"], "left_anti")
    new = scratch.save(new.select("did", "key", F.lit(True).alias("held")), f"new{v}")
    old = index.counts.select("key", F.col("n_docs").alias("n_old"), F.col("keep").alias("k_old"))
    fresh = _counts(new).join(old, "key", "left").select("key", (F.col("n_docs") + F.coalesce("n_old", F.lit(0))).alias("n_docs"), F.greatest("keep", "k_old").alias("keep"))
    return _moved(scratch, index, new, scratch.save(fresh, f"fresh{v}"))


def delete(scratch: Scratch, index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents of these ids (column doc_id)."""
    v = index.version + 1
    ids = ids.select(known_id().alias("did")).distinct()
    gone = scratch.save(index.refs.join(ids, "did", "left_semi").select("did", "key", F.lit(False).alias("held")), f"gone{v}")
    touched = gone.select("key").distinct()
    left = _counts(index.refs.join(touched, "key", "left_semi").join(ids, "did", "left_anti"))
    fresh = touched.join(left, "key", "left").select("key", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "keep")
    return _moved(scratch, index, gone, scratch.save(fresh, f"fresh{v}"))


def dropped_keys(scratch: Scratch, index: LineIndex, refs: DataFrame) -> DataFrame:
    """(did, gone): the keys whose lines each document loses."""
    sharded = refs.select("did", "key", _shard(index.shards).alias("shard"))
    load = sharded.groupBy("shard").agg((F.floor(F.count("*") / PROBE_ROWS) + 1).cast("int").alias("salts"))  # a row a shard
    probes = sharded.join(load, "shard").withColumn("salt", F.pmod(F.xxhash64("did"), F.col("salts")).cast("int"))
    filters = index.filters.join(load, "shard").select("shard", "filter", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hits = filters.groupBy("shard", "salt").cogroup(probes.groupBy("shard", "salt")).applyInPandas(_probe, "did long, key binary")
    shared = index.counts.filter(F.col("n_docs") >= index.min_docs).select("key", "keep")
    lost = hits.join(shared, "key").filter(F.col("did") != F.col("keep"))
    return lost.groupBy("did").agg(F.collect_list("key").alias("gone"))


def stays(text: str, gone: set[bytes], min_chars: int) -> list[str]:
    """The lines of a text whose keys aren't gone: one pass over them."""
    out = []
    for line in text.split("\n"):
        if len(line) >= min_chars:
            key = line.strip(BLANKS)
            if len(key) >= min_chars and hashlib.md5(key.encode().lower(), usedforsecurity=False).digest() in gone:
                continue
        out.append(line)
    return out


def apply(scratch: Scratch, index: LineIndex, docs: DataFrame, refs: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """(row, kept, n_lines, n_dropped): each row of docs as a struct, and the text of the lines that stay."""
    # Keys that documents lose grow with the corpus: the join is by id at every size, never a broadcast.
    gone = scratch.save(dropped_keys(scratch, index, index.refs if refs is None else refs), "gone").hint("merge")
    out = docs.select(known_id().alias("did"), F.struct(*docs.columns).alias("row")).join(gone, "did", "left")
    kind, min_chars, at = out.schema["row"].dataType.simpleString(), index.min_chars, docs.columns.index(text_col)  # texts are sent once, within their rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, lost = [], [], []
            for text, keys in zip(batch.column(0).flatten()[at].cast(pa.string()), batch.column(1), strict=True):
                text = text.as_py() or ""
                n.append(text.count("\n") + 1)
                if keys.is_valid:
                    lines = stays(text, set(keys.as_py()), min_chars)
                    lost.append(n[-1] - len(lines))
                    text = "\n".join(lines)
                else:
                    lost.append(0)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(lost, pa.int64())], ["row", "kept", "n_lines", "n_dropped"])

    small_batches(docs.sparkSession, 256)
    return out.select("row", "gone").mapInArrow(run, f"row {kind}, kept string, n_lines long, n_dropped long")
