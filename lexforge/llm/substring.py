"""Substring dedup: compressed FM-indexes over wavelet matrices, one a shard, give matching statistics of the documents.

A window is `length` consecutive words; it is repeated if its words also start anywhere else, in the same document or another. To
keep equal windows together without comparing every document with every shard, a window is routed by its minimizer (least hash of its
runs of ANCHOR words, the leftmost of equals): consecutive windows with the same minimizer at the same place travel as one segment.
Minimizers that occur once can't be part of a repeated window and go no further. These hashes only route: what they confuse meets in a
shard and is told apart there. Equal segments, by a cryptographic digest of their words, are indexed once, with their number as weight, so
copies weigh nothing.

In a shard, segments become a text of word numbers, its suffixes sorted by their first `length` words, and their Burrows-Wheeler
transform a wavelet matrix: bit-packed levels with rank counts. Documents' segments are streamed from their last word to their
first, all in lockstep: a backward step extends each match by a word; a match longer than `length` - 1 is first shortened to that,
by the bounds of its suffix group. The statistic of a position is so the length of its match up to `length`, and the weight of its suffix
interval says whether it occurs elsewhere. Intervals above the threshold are reported.

A minimizer with more than WIDE distinct segments (the edge of a passage that very many documents quote) would outgrow its shard. Its
segments are routed a second time, with a whole window as the anchor: each window is a segment then, those whose digest occurs once go no
further, and the others, however many documents hold them, are indexed once and searched in FM-indexes of their own.

Defined cases: a null text has no words; texts shorter than a window lose nothing; repeated rows are documents that repeat each other; a null id is
an id like others; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

LENGTH, ANCHOR = 35, 8
#: Distinct segments that one minimizer may bring to a shard; words of a shard.
WIDE, SHARD_WORDS = 512, 600_000
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(max(n, 1), b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        held = _powers[base] = (out[0], out[1])
    return held[0][:n], held[1][:n]


class Rolling:
    """Hashes of any spans of a sequence of numbers, from prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        ahead, self.back = _power(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * ahead[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def normal(text: bytes) -> bytes:
    """The words of a text, joined by one space."""
    return b" ".join(text.split())


def word_hashes(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that end at `ends` in data: (hash, start and end of every word, first word of each text and the end)."""
    data = np.frombuffer(data, np.uint8)
    word = ~BLANK[data]
    edge = np.diff(word.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = Rolling(data.astype(np.uint64) + np.uint64(1), BASES[0]).spans(start, end)
    hashes = _scramble(hashes + (end - start).astype(np.uint64) * np.uint64(BASES[1]))
    return hashes, start, end, np.concatenate([[0], np.searchsorted(start, ends)])


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of the spans of data, two longs each."""
    made = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


def segments(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, start word in it, windows, minimizer, two longs of digest) of every segment."""
    texts = [normal(t) for t in texts]
    data = b"\n".join([*texts, b""])
    hashes, from_, to, first = word_hashes(data, np.cumsum([len(t) + 1 for t in texts]))
    n = len(hashes) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    rolling = Rolling(hashes, BASES[1])
    at = np.arange(len(hashes) - anchor + 1)
    least = _scramble(rolling.spans(at, at + anchor))
    need, width, place = length - anchor + 1, 1, at

    def lesser(least, place, shift, count):
        """The lesser of two minima, and the leftmost place that has it."""
        later = least[shift : shift + count] < least[:count]
        return np.where(later, least[shift : shift + count], least[:count]), np.where(later, place[shift : shift + count], place[:count])

    while 2 * width <= need:
        least, place = lesser(least, place, width, len(least) - width)
        width *= 2
    if width < need:
        least, place = lesser(least, place, need - width, n)
    least, place = least[:n], place[:n]
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    whole = owner[:n] == owner[length - 1 :]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:n] != owner[: n - 1]) | ~whole[:-1]
    begin = np.flatnonzero(new & whole)
    close = np.flatnonzero(np.append(new[1:], True) & whole | whole & ~np.append(whole[1:], False)) + 1
    count = close - begin
    marks = digests(data, from_[begin], to[close + length - 2])
    return owner[begin], begin - first[owner[begin]], count, least[begin].view(np.int64), marks[:, 0], marks[:, 1]


def window_digests(words: bytes, length: int = LENGTH) -> np.ndarray:
    """Digests of every window of words joined by one space."""
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.append(gaps, len(words))
    return digests(words, start[: len(start) - length + 1], end[length - 1 :])


# --- the index of a shard ------------------------------------------------------------------------------------------------------------


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit-packed level a bit of the symbols, with counts before each 64-bit word."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        row = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
            self.bits.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(int(len(row) - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where `at` comes to by following the symbol's bits; differences of these are ranks."""
        for k in range(self.levels):
            part = at >> 6
            under = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            one = self.ones[k][part] + np.bitwise_count(self.bits[k][part] & under).astype(np.int64)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + one, at - one)
        return at


class FMIndex:
    """Backward search, for patterns up to `depth` symbols, over sequences of numbers from 1 on that are parted by 0."""

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int):
        top = int(text.max(initial=0))
        ranks = {1: text.astype(np.int64)}

        def joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
            moved = np.zeros_like(b)
            moved[: len(b) - shift] = b[shift:] + 1
            return np.unique(a * (int(moved.max(initial=0)) + 1) + moved, return_inverse=True)[1]

        def deep(d: int) -> np.ndarray:
            if d not in ranks:
                half = 1 << (d - 1).bit_length() - 1
                ranks[d] = joined(deep(half), deep(half) if d == 2 * half else deep(1 << (d - half - 1).bit_length()), half if d == 2 * half else d - (1 << (d - half - 1).bit_length()))
            return ranks[d]

        order = np.argsort(deep(depth), kind="stable")
        group = deep(depth - 1)[order]
        change = np.flatnonzero(np.diff(group)) + 1
        starts = np.concatenate([[0], change])
        sizes = np.diff(np.append(starts, len(text)))
        self.low, self.high = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        self.matrix = WaveletMatrix(text[order - 1].astype(np.int64), top)
        symbols = np.arange(top + 1)
        before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))[:-1]])
        self.base = before - self.matrix.descend(symbols, np.zeros(top + 1, np.int64))
        self.weights = np.concatenate([[0], np.cumsum(weight[order])])
        self.size, self.depth = len(text), depth

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.base[symbol] + self.matrix.descend(symbol, low), self.base[symbol] + self.matrix.descend(symbol, high)

    def occurrences(self, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each place of text from which a sequence (start, length; longest first) goes on for `depth` symbols: the weight of
        all places with the same `depth` symbols. Elsewhere 0."""
        out = np.zeros(len(text), np.int64)
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.size)
        for done in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -done))  # those longer than done
            at = start[:n] + length[:n] - 1 - done
            low, high = low[:n], high[:n]
            if done >= self.depth:
                low, high = self.low[low], self.high[low]
            low, high = self.step(text[at], low, high)
            if done >= self.depth - 1:
                out[at] = self.weights[high] - self.weights[low]
        return out


def _runs(flags: np.ndarray) -> np.ndarray:
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], 1)


def shard_runs(texts: list[str], weights: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(segment, first window, last window) of the runs of repeated windows among the segments of a shard."""
    split = [t.split(" ") for t in texts]
    order = sorted(range(len(split)), key=lambda i: -len(split[i]))
    numbers = pa.array([w for i in order for w in [*split[i], ""]], pa.string()).dictionary_encode()
    codes = numbers.indices.to_numpy().astype(np.int64)
    gap = numbers.dictionary.index("").as_py()
    text = np.where(codes == gap, 0, np.where(codes < gap, codes + 1, codes))
    sizes = np.array([len(split[i]) for i in order])
    start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    found = FMIndex(text, np.repeat(weights[order], sizes + 1), length).occurrences(text, start, sizes)
    for k, i in enumerate(order):
        for a, b in _runs(found[start[k] : start[k] + sizes[k] - length + 1] >= 2).tolist():
            yield i, a, b


# --- the corpus ----------------------------------------------------------------------------------------------------------------------


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, id, text): rows under 128 bits of their id and text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.select(F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", "id", F.lit(1)).alias("k2"), "id", "text")


def _bytes(column) -> list[bytes]:
    return [(x or "").encode() for x in column.to_pylist()]


def _spans(scratch: Scratch, rows: DataFrame, length: int) -> DataFrame:
    """(k1, k2, spans array<struct<a, b>>): first and last word of the covered runs of each row."""
    spark = rows.sparkSession
    small_batches(spark, 256)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, start, count, *marks = segments(_bytes(batch.column(2)), length)
            keys = [batch.column(k).take(pa.array(owner)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(start, pa.int32()), pa.array(count, pa.int32()), *(pa.array(m, pa.int64()) for m in marks)], ["k1", "k2", "start", "n", *SEGMENT])

    all_segments = scratch.save(rows.select("k1", "k2", "text").mapInArrow(cut, "k1 long, k2 long, start int, n int, anchor long, s1 long, s2 long"), "segments")
    scratch.tidy()
    # Counts are written before they are joined: a join whose sides are plain exchanges can split a hot key, one that still has to
    # aggregate a side by that key can't.
    twice = scratch.save(all_segments.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"), "twice")
    members = scratch.save(all_segments.join(twice, "anchor", "left_semi"), "members")
    scratch.drop("segments", "twice")
    scratch.tidy()
    # Distinct segments, each with one row that holds it.
    kinds = members.groupBy(*SEGMENT).agg(F.count("*").alias("weight"), F.max("n").alias("n"), F.min(F.struct("k1", "k2", "start")).alias("at"))
    kinds = scratch.save(kinds.select(*SEGMENT, "weight", "n", "at.*"), "kinds")
    scratch.tidy()
    many = scratch.save(kinds.groupBy("anchor").agg(F.count("*").alias("c")).filter(F.col("c") > WIDE).select("anchor", F.lit(True).alias("wide")), "many")
    wanted = kinds.join(many, "anchor", "left").withColumn("wide", F.col("wide").isNotNull())
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct(*SEGMENT, "weight", "n", "start", "wide")).alias("wanted"))
    asked = rows.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("text", "wanted")
    fetched = scratch.save(_fetch(asked, [*SEGMENT, "weight", "wide"], length), "fetched")
    scratch.drop("kinds")
    scratch.tidy()
    held, windows = fetched.filter(F.col("words").isNotNull()).drop(*PLACED), fetched.filter(F.col("words").isNull()).drop("words")
    found = _search(held.filter(~F.col("wide")), SEGMENT, "anchor", length)
    if not many.isEmpty():
        found = found.unionByName(_wide(scratch, held.filter("wide"), windows, length))
    runs = scratch.save(found, "runs")
    scratch.drop("fetched", "again")
    scratch.tidy()
    covered = members.join(runs, SEGMENT).select("k1", "k2", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + (length - 1)).alias("b"))
    return covered.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


#: What tells segments apart.
SEGMENT = ["anchor", "s1", "s2"]


#: A window of a wide segment: its place in it, and its digest.
PLACED = ["place", "d1", "d2"]


def _fetch(asked: DataFrame, keep: list[str], length: int) -> DataFrame:
    """(keep, words, PLACED): the words of each of the segments (start, n and the columns to keep) that are wanted of a text; and a row
    without words for each window of those that are `wide`."""
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema["wanted"].dataType.elementType}
    types = [*(pa.bool_() if kinds[c] == "boolean" else pa.int64() for c in keep), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, asked in zip(_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = text.split()
                for s in asked:
                    part, own = b" ".join(words[s["start"] : s["start"] + s["n"] + length - 1]), tuple(s[c] for c in keep)
                    out.append((*own, part.decode(), None, None, None))
                    if s.get("wide"):
                        out += [(*own, None, i, *d) for i, d in enumerate(window_digests(part, length).tolist())]
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*keep, "words", *PLACED])

    small_batches(asked.sparkSession, 64)
    fields = [*(f"{c} {'boolean' if kinds[c] == 'boolean' else 'long'}" for c in keep), "words string, place int, d1 long, d2 long"]
    return asked.mapInArrow(fetch, ", ".join(fields))


def _search(held: DataFrame, key: list[str], route: str, length: int) -> DataFrame:
    """(key, a, b): the runs of repeated windows of segments (key, weight, words), which meet by `route` in the FM-index of a shard."""
    n_words = held.agg(F.sum(F.length("words") - F.length(F.replace("words", F.lit(" "))) + 1)).first()[0] or 0
    shards = max(1, -(-n_words // SHARD_WORDS))

    def shard(group: pd.DataFrame) -> pd.DataFrame:
        found = list(shard_runs(group["words"].tolist(), group["weight"].to_numpy(), length))
        i = [x[0] for x in found]
        return pd.DataFrame({k: group[k].to_numpy()[i] for k in key} | {"a": [x[1] for x in found], "b": [x[2] for x in found]}).astype({"a": "int32", "b": "int32"})

    return held.groupBy(F.pmod(F.xxhash64(route), F.lit(shards)).alias("shard")).applyInPandas(shard, ", ".join([*(f"{k} long" for k in key), "a int, b int"]))


def _wide(scratch: Scratch, held: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """(anchor, s1, s2, a, b): the repeated windows of segments (and words) of wide minimizers; windows: (segment, weight, PLACED)."""
    again = windows.groupBy("d1", "d2").agg(F.sum("weight").alias("weight"), F.min(F.struct(*SEGMENT, "place")).alias("at")).filter("weight > 1")
    one = F.struct(F.col("d1").alias("r1"), F.col("d2").alias("r2"), "weight", F.col("at.place").alias("start"), F.lit(1).alias("n"))
    wanted = again.groupBy("at.anchor", "at.s1", "at.s2").agg(F.collect_list(one).alias("wanted"))
    asked = held.select(*SEGMENT, F.col("words").alias("text")).join(wanted, SEGMENT).select("text", "wanted")
    single = scratch.save(_fetch(asked, ["r1", "r2", "weight"], length).drop(*PLACED), "again")
    same = _search(single, ["r1", "r2"], "r1", length).select(F.col("r1").alias("d1"), F.col("r2").alias("d2"))
    return windows.join(same, ["d1", "d2"], "left_semi").select(*SEGMENT, F.col("place").alias("a"), F.col("place").alias("b"))


def dedup(scratch: Scratch, docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): each row's words that no repeated window covers, joined by one space."""
    rows = keyed(docs, id_col, text_col)
    spans = scratch.save(_spans(scratch, rows, length), "spans")
    scratch.drop("members", "runs")
    scratch.tidy()
    small_batches(docs.sparkSession, 256)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, covered in zip(_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                stays = np.ones(len(words), bool)
                for s in covered or ():
                    stays[s["a"] : s["b"] + 1] = False
                n.append(len(words))
                gone.append(len(words) - int(stays.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stays).tolist()]).decode() if gone[-1] else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    joined = rows.join(spans, ["k1", "k2"], "left").select("id", "text", "spans")
    kind = joined.schema["id"].dataType.simpleString()
    return joined.mapInArrow(keep, f"id {kind}, n_words long, n_removed long, kept string")


def brute(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, SHA-256 of the kept words) by direct comparison, for tests."""
    split = [(t or "").encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for words in split:
        for i in range(len(words) - length + 1):
            seen[tuple(words[i : i + length])] = seen.get(tuple(words[i : i + length]), 0) + 1
    out = []
    for words in split:
        stays = [True] * len(words)
        for i in range(len(words) - length + 1):
            if seen[tuple(words[i : i + length])] > 1:
                stays[i : i + length] = [False] * length
        kept = b" ".join(w for w, s in zip(words, stays, strict=True) if s)
        out.append((len(words), stays.count(False), hashlib.sha256(kept).hexdigest()))
    return out
