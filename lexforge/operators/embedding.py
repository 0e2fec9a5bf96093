"""Document embeddings by latent semantic analysis: hashed term weights, and their main directions by randomised subspace iteration.

Each text's terms are hashed, with a sign, to `dims` columns and weighted by the logarithm of their count and by inverse document frequency; rows have
length 1. Of this matrix A, which stays spread over the executors, a few products A'(A M) with a matrix M of dims x k numbers give its main
right singular vectors: each task multiplies its rows, block by block, and hands on one dims x k sum, and the tasks' sums are added up in two
levels. What the driver holds is dims x k, whatever the corpus. An embedding is a row's product with the directions, of length 1.

A null or empty text, and one without a term, has a null embedding.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.written import written

DIMS, RANK = 2048, 64
#: Random directions beyond the rank, and products that the iteration takes.
OVER, ROUNDS = 16, 5
#: Rows of a block of A, rows of M that are added up together, and parts of the first level of sums.
BLOCK, CHUNK, SALTS = 256, 256, 16


@dataclass
class Directions:
    """weights: of the columns by document frequency; axes: dims x rank, orthonormal; values: their squared singular values."""

    weights: np.ndarray
    axes: np.ndarray
    values: np.ndarray


def hashed_counts(text: str, dims: int) -> dict[int, int]:
    out: Counter = Counter()
    for term, n in Counter(re.findall(r"\w+", text.lower())).items():
        h = zlib.crc32(term.encode())
        out[h % dims] += n if h >> 31 else -n
    return {i: n for i, n in out.items() if n}


def hashed_terms(docs: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """(key, at, n): each row's columns of A that aren't zero, with their signed counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [hashed_counts(t.as_py() or "", dims) for t in batch.column(1)]
            arrays = [batch.column(0), pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, [key, "at", "n"])

    rows = docs.select(key, F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, at array<int>, n array<int>")


def blocks(batch: pa.RecordBatch, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, block of A) of a batch whose last columns are at and n."""
    at, n = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    for start in range(0, batch.num_rows, BLOCK):
        some = at.slice(start, BLOCK)
        out = np.zeros((len(some), len(weights)))
        rows = np.repeat(np.arange(len(some)), some.value_lengths().to_numpy())
        columns, counts = some.flatten().to_numpy(), n.slice(start, BLOCK).flatten().to_numpy()
        out[rows, columns] = np.sign(counts) * np.log1p(np.abs(counts)) * weights[columns]
        size = np.sqrt((out * out).sum(1, keepdims=True))
        yield start, np.divide(out, size, out=out, where=size > 0)


def _added(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the parts (float64 as bytes) of each group, one after the other."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column("part"):
                one = np.frombuffer(part.as_py())
                total = one.copy() if total is None else total + one
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([total.tobytes()], pa.binary())], [*by, "part"])

    return rows.groupBy(*by).applyInArrow(run, ", ".join(f"{k} int" for k in by) + ", part binary")


def product(rows: DataFrame, weights: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A'(A M)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros_like(m)
        for batch in batches:
            for _, a in blocks(batch, weights):
                total += a.T @ (a @ m)
        chunks = range(0, len(m), CHUNK)
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([salt] * len(chunks), pa.int32()), pa.array([total[i : i + CHUNK].tobytes() for i in chunks], pa.binary())], ["chunk", "salt", "part"])

    parts = rows.select("at", "n").mapInArrow(run, "chunk int, salt int, part binary")
    sums = _added(_added(parts, ["chunk", "salt"]).select("chunk", "part"), ["chunk"]).collect()  # dims x k numbers
    return np.concatenate([np.frombuffer(r["part"]).reshape(-1, m.shape[1]) for r in sorted(sums, key=lambda r: r["chunk"])])


def directions(rows: DataFrame, dims: int = DIMS, rank: int = RANK, rounds: int = ROUNDS, seed: int = 0) -> Directions:
    """The main directions of rows (at, n)."""
    n = rows.filter(F.size("at") > 0).count()
    having = np.zeros(dims)
    for r in rows.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # a row a column
        having[r["at"]] = r["count"]
    weights = np.log((1 + n) / (1 + having)) + 1
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, min(dims, rank + OVER))))[0]
    for _ in range(rounds if n else 0):
        q = np.linalg.qr(product(rows, weights, q))[0]
    values, turn = np.linalg.eigh(q.T @ product(rows, weights, q) if n else np.eye(q.shape[1]))
    order = np.argsort(-values)[:rank]
    axes = q @ turn[:, order]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])  # a direction's largest part is positive
    return Directions(weights, axes, values[order])


def embed(docs: DataFrame, key: str = "doc_id", text: str = "text", dims: int = DIMS, rank: int = RANK, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """(key, embedding) of docs."""
    rows = written(hashed_terms(docs, key, text, dims))
    found = directions(rows, dims, rank, rounds, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = []
            for _, a in blocks(batch, found.weights):
                p = a @ found.axes
                size = np.sqrt((p * p).sum(1))
                out += [(x / s).astype(np.float32) if s > 0 else None for x, s in zip(p, size, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], [key, "embedding"])

    return rows.select(key, "at", "n").mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, embedding array<float>")
