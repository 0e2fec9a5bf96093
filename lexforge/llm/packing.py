"""Packing by cutting-stock column generation.

Each document's ids (end id included) are cut into full sequences, at most one half sequence, and a rest below half. The histogram of the
lengths below `size`, at most size / 2 numbers whatever the corpus, is all that reaches the driver. There a linear program over patterns (multisets of lengths that fit one
sequence) is solved by column generation: the duals price lengths, an unbounded-knapsack dynamic programme finds the best new pattern, and
a revised simplex takes it in, until Farley's bound shows that little is left to gain. Patterns are used their rounded-down number of times;
what remains of the histogram (fewer remainders than patterns hold) is packed first-fit-decreasing. Remainders are ranked within their
length, and a rank names its sequence and offset by arithmetic, so assignment needs no search and no exchange of texts or ids.

Defined cases: a null text is an empty one and is just its end id; repeated rows are packed as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

SIZE, END = 1024, 0
#: The linear program stops once it is within this share of the bound.
GAP = 0.003
#: Remainders of one length that one ranking task may hold.
RANK_ROWS = 1000
SPECIAL = "<|endoftext|>"

_known: dict = {}


#: Runs of white space from which the rank file's library may run out of stack; texts that hold one go to the JSON tokenizer.
LONG_RUN = 50_000


def has_long_run(text: str) -> bool:
    return len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in re.finditer(r"\s{64,}", text))


def _slow(ranks_path: str):
    """The JSON tokenizer that lies beside the rank file: the same ids, at a seventh of the speed."""
    from tokenizers import Tokenizer

    path = ranks_path.rsplit(".", 1)[0] + ".json"
    if path not in _known:
        _known[path] = Tokenizer.from_file(path)
    return lambda text: _known[path].encode(text, add_special_tokens=False).ids


def encoder(ranks_path: str, pattern: str):
    """Ids of a text. The rank file holds the vocabulary of the JSON file; the only special token is its last id."""
    import base64

    import tiktoken

    if ranks_path not in _known:
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _known[ranks_path] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    coder = _known[ranks_path]

    def run(text: str):
        if has_long_run(text):
            return _slow(ranks_path)(text)
        try:
            return coder.encode(text, allowed_special="all") if SPECIAL in text else coder.encode_ordinary(text)
        except BaseException as e:
            if type(e).__name__ != "PanicException":
                raise
            return _slow(ranks_path)(text)

    return run


def cuts(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """Full sequences; what remains is cut once more at half a sequence: two halves fill a sequence, and shorter rests leave little padding."""
    at = [*range(0, n, size), n]
    if n - at[-2] > size // 2 and n - at[-2] < size:
        at.insert(-1, at[-2] + size // 2)
    return list(zip(at[:-1], at[1:], strict=True))


def pieces(docs: DataFrame, ranks_path: str, pattern: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece of every row."""
    small_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern)
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                for start, end in cuts(len(ids), size):
                    cut = ids[start:end]
                    for to, x in zip(out, (doc, start, len(cut), zlib.crc32(cut.tobytes()), len(ids)), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(value: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: value[i] of an item of length i + 1; the best total and how often each length is in it."""
    gain = np.maximum(value, 0.0)
    best, took = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    top = len(gain)
    for room in range(1, size + 1):
        n = min(room, top)
        total = best[room - n : room][::-1] + gain[:n]
        pick = int(total.argmax())
        best[room], took[room] = total[pick], pick + 1
    count, room = np.zeros(top, np.int64), size
    while room > 0:
        if gain[took[room] - 1] > 0:
            count[took[room] - 1] += 1
        room -= int(took[room])
    return float(best[size]), count


def start(demand: dict[int, int], size: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """A first basis: patterns filled with the largest lengths that are left, each used until one of its lengths runs out. In the order in
    which lengths run out the patterns form a triangular matrix, so they are a basis."""
    left = {x: float(n) for x, n in demand.items()}
    basis: dict[int, tuple[dict[int, int], float]] = {}
    while left:
        room, pattern = size, {}
        for x in sorted(left, reverse=True):
            if n := min(room // x, max(1, int(left[x]))):
                pattern[x] = n
                room -= n * x
        times = min(left[x] / n for x, n in pattern.items())
        for x, n in pattern.items():
            left[x] -= n * times
        for x in [x for x in pattern if left[x] <= 1e-9]:
            del left[x]
            basis[x] = ({x: size // x}, 0.0) if times is None else (pattern, times)
            times = None  # the others that ran out at once stand in the basis alone, unused
    order = sorted(basis)
    return [basis[x][0] for x in order], np.array([basis[x][1] for x in order])


def solve(demand: dict[int, int], size: int, gap: float = GAP, turns: int = 4000) -> list[tuple[dict[int, int], float]]:
    """Patterns with the (fractional) numbers of sequences that use them, of the linear program over all patterns; feasible whenever it stops."""
    lengths = sorted(demand)
    if not lengths:
        return []
    m, need = len(lengths), np.array([demand[x] for x in lengths], float)
    patterns, amount = start(demand, size)
    inverse = np.linalg.inv(np.array([[p.get(x, 0) for p in patterns] for x in lengths], float))
    at = np.array(lengths) - 1
    for _ in range(turns):
        price = inverse.sum(0)
        value = np.zeros(lengths[-1])
        value[at] = price
        worth, count = best_pattern(value, size)
        # Zeroed where negative and divided by worth, the prices are feasible for the dual; so are 1 / size an id. Both bound the optimum from below.
        least = max(float(np.maximum(price, 0) @ need) / worth, float(np.array(lengths) @ need) / size)
        if worth <= 1 + 1e-9 or amount.sum() * (1 - gap) <= least:
            break
        step = inverse @ count[at]
        rows = np.flatnonzero(step > 1e-9)
        if not len(rows):
            break
        out = rows[np.argmin(amount[rows] / step[rows])]
        far = amount[out] / step[out]
        amount -= far * step
        amount[out] = far
        np.maximum(amount, 0, out=amount)
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        patterns[out] = {x: int(n) for x, n in zip(lengths, count[at], strict=True) if n}
    return list(zip(patterns, amount.tolist(), strict=True))


def plan(demand: dict[int, int], size: int = SIZE, gap: float = GAP) -> list[tuple[list[int], int]]:
    """Rounded patterns: (lengths in order, number of sequences); together they hold exactly the demand."""
    left, out = dict(demand), []
    for pattern, amount in sorted(solve(demand, size, gap), key=lambda x: sorted(x[0].items())):
        times = min([int(amount + 1e-6), *(left[x] // n for x, n in pattern.items())])
        if times:
            out.append(([x for x, n in sorted(pattern.items(), reverse=True) for _ in range(n)], times))
            for x, n in pattern.items():
                left[x] -= n * times
    # First fit over the rest, largest first; room[r] holds the open sequences with r ids of room.
    room: dict[int, list[list[int]]] = {}
    bins: list[list[int]] = []
    for x in sorted(left, reverse=True):
        for _ in range(left[x]):
            fits = [r for r, held in room.items() if r >= x and held]
            if fits:
                r = min(fits)
                held = room[r].pop()
            else:
                r, held = size, []
                bins.append(held)
            held.append(x)
            room.setdefault(r - x, []).append(held)
    return out + [(held, 1) for held in bins]


def slots(planned: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Per length its slots in order: rows (first rank, sequences, first sequence, places a sequence, first offset)."""
    out: dict[int, list[list[int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, times in planned:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            n = lengths.count(x)
            out.setdefault(x, []).append([ranks.get(x, 0), times, sequence, n, offset])
            ranks[x] = ranks.get(x, 0) + n * times
            offset += n * x
        sequence += times
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def pack(scratch: Scratch, cut: DataFrame, size: int = SIZE, gap: float = GAP) -> DataFrame:
    """cut (pieces()) with sequence_id and offset. Sequences of remainders come first, then each full piece has its own."""
    cut = scratch.save(cut, "pieces")
    rest = cut.filter(F.col("length") < size)
    demand = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # fewer than size rows
    planned = plan(demand, size, gap)
    table, full_from = slots(planned), sum(times for _, times in planned)

    ordered, columns = ["doc_id", "start", "ids_crc32", "doc_tokens"], cut.columns

    def dealt(rows: DataFrame, buckets: int) -> DataFrame:
        """rows with their bucket and their place in it: buckets keep a very frequent length out of a single task."""
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*ordered), F.lit(buckets)).cast("int"))
        return rows.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*ordered)) - 1)

    def ranked(rows: DataFrame, buckets: int) -> DataFrame:
        """rank from 0 among rows of a length, by (bucket, id)."""
        rows = dealt(rows, buckets)
        sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        sizes = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
        return rows.join(sizes, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "bucket")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                mine = length == x
                rows = table[int(x)]
                slot = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                into = rank[mine] - slot[:, 0]
                sequence[mine] = slot[:, 2] + into // slot[:, 3]
                offset[mine] = slot[:, 4] + into % slot[:, 3] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    fields = ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"])
    most = max(demand.values(), default=0)
    small_batches(cut.sparkSession, 8192)
    placed = ranked(rest, max(1, -(-most // RANK_ROWS))).mapInArrow(place, fields)
    full = cut.filter(F.col("length") == size)
    buckets = max(1, -(-full.count() // RANK_ROWS))
    # A full piece is its own sequence: any number that no other has will do, so buckets need not know of each other.
    number = F.col("own").cast("long") * buckets + F.col("bucket") + full_from
    return placed.unionByName(dealt(full, buckets).select(*columns, number.alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
