"""Vector search in blocks: a permutation index for nearest neighbours, and exact top-k by segment statistics.

Both deal candidates into shards. A shard is one task: it reads its candidates, builds its index once, and lets all queries stream past in
batches, so that memory is bounded by a shard and a batch, and what is shuffled is the candidates once and the queries once a shard.
Of rows with the same vector no more than 2k can be among the k answers of a query (k of its own id may not count), so further copies are
left out of the shards: that loses nothing, and a vector that a third of all rows hold weighs no more than any other.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither as query nor as candidate (nor do zero
vectors in `nearest`); shorter vectors count as padded with zeros; rows with a null id take no part. Each row whose id is divisible by
`every` is a query of its own with its own ranks, also where an id is repeated; rows of a query's id are no candidates of it, and
repeated rows of another id are separate candidates. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts, small_batches, thinned

#: Candidates of a shard: at least the first, if there are fewer shards than partitions, and at most the second.
SHARD_ROWS, MOST_ROWS = 8192, 65536
#: Queries of a batch.
BLOCK_ROWS = 1024


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", zero: bool = True) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.forall("v", finite))
    return rows if zero else rows.filter(F.exists("v", lambda x: x != 0))


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        n = min(len(v), width)
        out[i, :n] = v[:n]
    return out


def _search(scratch: Scratch, rows: DataFrame, every: int, k: int, score: str, smallest: bool, index: Callable) -> DataFrame:
    """index(candidates, ids) makes find(queries, query ids), which yields (place of the query, candidate ids, scores) with the k best of
    the shard or more."""
    spark = scratch.spark
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    # Spark limits each partition's groups before the exchange, so a hot vector isn't gathered.
    own = F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("row"))
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))
    kept = rows.withColumn("n", own).filter(F.col("n") <= k).withColumn("n", copy).filter(F.col("n") <= 2 * k)
    kept = scratch.save(kept.select("row", "vec_id", "v"), "kept")
    count, width = kept.agg(F.count("*"), F.max(F.size("v"))).first()
    shards, width = max(1, -(-count // MOST_ROWS), min(parts(spark), -(-count // SHARD_ROWS))), width or 0
    held = kept.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("s"), F.lit(False).alias("query"), "row", "vec_id", "v")
    asked = rows.filter(F.col("vec_id") % every == 0)
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), F.lit(True).alias("query"), "row", "vec_id", "v")
    dealt = held.unionByName(asked).repartitionById(shards, "s").sortWithinPartitions("s", "query", "row")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, find, before = None, None, []
        for batch in batches:
            for s, part in batch.groupby("s", sort=True):
                if s != shard:
                    shard, find, before = s, None, []
                candidates, queries = part[~part["query"]], part[part["query"]]
                if len(candidates):
                    before.append((_matrix(candidates["v"].tolist(), width), candidates["vec_id"].to_numpy()))
                if not len(queries) or not before:
                    continue
                if find is None:
                    x, ids = np.concatenate([x for x, _ in before]), np.concatenate([i for _, i in before])
                    order = np.argsort(ids, kind="stable")
                    find = index(x[order], ids[order])
                numbers, names, out = queries["row"].to_numpy(), queries["vec_id"].to_numpy(), []
                for i, ids, scores in find(_matrix(queries["v"].tolist(), width), names):
                    if len(scores) > 4 * k:  # ties at the k-th place all stay
                        rest = scores <= np.partition(scores, k - 1)[k - 1] if smallest else scores >= np.partition(scores, -k)[-k]
                        ids, scores = ids[rest], scores[rest]
                    best = np.lexsort((ids, scores if smallest else -scores))[:k]
                    out.append(pd.DataFrame({"row": numbers[i], "query_id": names[i], "vec_id": ids[best], "score": scores[best]}))
                if out:
                    yield pd.concat(out)

    small_batches(spark, BLOCK_ROWS)
    found = dealt.mapInPandas(task, f"row long, query_id long, vec_id long, score {score}")
    order = [F.col("score").asc() if smallest else F.col("score").desc(), F.col("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# --- permutation index ---------------------------------------------------------------------------------------------------------------

#: Pivots, those a vector is posted under, and the share of a shard that is reranked, and the least number of them.
PIVOTS, PREFIX, RERANK, LEAST = 256, 64, 0.15, 512
#: Rows of the sample from which pivots are drawn.
PIVOT_SAMPLE = 2048


def draw_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Pivots from the rows of smallest hash, at most `sample`: a seeded choice among their distinct vectors."""
    got = thinned(rows.select("vec_id", "v"), F.xxhash64("vec_id"), sample).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not got:
        return np.zeros((0, 0))
    x = np.unique(_matrix([r["v"] for r in got], max(len(r["v"]) for r in got)), axis=0)
    rng = np.random.default_rng(11)
    return x[rng.permutation(len(x))[:pivots]]


def prefixes(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Row by row the nearest pivots, nearest first."""
    far = (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    length = min(length, len(pivots))
    near = np.argpartition(far, length - 1, axis=1)[:, :length]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)


class PermutationIndex:
    """Inverted files: per pivot the vectors posted under it and the place of the pivot in their order."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, length: int = PREFIX):
        self.x, self.pivots = x, pivots
        order = prefixes(x, pivots, length)
        self.length = order.shape[1]
        rows, places = np.divmod(np.arange(order.size), self.length)
        by = np.argsort(order.ravel(), kind="stable")
        ends = np.searchsorted(order.ravel()[by], np.arange(len(pivots) + 1))
        self.rows = [rows[by[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.places = [places[by[a:b]].astype(np.float32) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of a query's order to each vector's, a pivot outside a prefix standing right after it.

        Sum over pivots of |place in query - place in vector|. Without any shared pivot it is the same for all; each posting found
        takes off what sharing saves.
        """
        n = self.length
        out = np.full(len(self.x), n * (n + 1), np.float32)
        for place, pivot in enumerate(order.tolist()):
            held = self.places[pivot]
            out[self.rows[pivot]] += np.abs(held - place) - (n - place) - (n - held)
        return out


def nearest(scratch: Scratch, vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", share: float = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): approximate k nearest by Euclidean distance, for queries whose id is divisible by `every`.

    Each shard reranks its own share of candidates by footrule (ties to smaller ids), so the reranked share, and recall with it, stays
    the same at every size.
    """
    rows = clean(vectors, id_col, vector_col, zero=False)
    pivots = draw_pivots(rows)

    def index(x: np.ndarray, ids: np.ndarray) -> Callable:
        p = _matrix(list(pivots), x.shape[1])
        held = PermutationIndex(x, p)
        room = min(len(x), max(LEAST, k + 1, int(share * len(x))))

        def find(queries: np.ndarray, query_ids: np.ndarray) -> Iterator[tuple]:
            for i, (query, order) in enumerate(zip(queries, prefixes(queries, p, PREFIX), strict=True)):
                foot = held.footrule(order)
                foot[ids == query_ids[i]] = np.inf
                cut = np.partition(foot, room - 1)[room - 1]
                near = np.flatnonzero((foot <= cut) & (foot < np.inf))  # ties at the cut all stay
                yield i, ids[near], np.sqrt(((x[near] - query) ** 2).sum(1))

        return find

    return _search(scratch, rows, every, k, "double", True, index)


# --- exact top-k by inner product ----------------------------------------------------------------------------------------------------

#: Numbers of segments, coarse to fine.
LEVELS, SEEDS = (8, 32), 16
#: Queries whose bounds are computed at once.
TOGETHER = 64
#: Beyond this every product or sum of doubles may be inexact.
EXACT = 2.0**53


def cuts_of(x: np.ndarray, segments: int) -> np.ndarray:
    """Ends of segments that hold about the same sum of the components' sizes each, so that segments are short where much is to tell."""
    size = np.sqrt((x * x).mean(0)) if len(x) else np.ones(x.shape[1])
    share = np.cumsum(size) / max(float(size.sum()), 1e-300)
    inner = np.searchsorted(share, np.arange(1, segments) / segments - 1e-12) + 1
    return np.unique(np.concatenate([[0], np.minimum(inner, x.shape[1]), [x.shape[1]]]))


def segment_statistics(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Means and deviations of the segments of each row, scaled by the root of the segment's length: (n, 2 * segments).

    For two rows, the distance of these points is a lower bound of the distance of the rows, and so their product an upper bound of
    the rows' inner product: sum over segments of length * (mean * mean + deviation * deviation).
    """
    root = np.sqrt(np.diff(cuts))
    means = [x[:, a:b].mean(1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    spreads = [x[:, a:b].std(1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.concatenate([np.stack(means, 1) * root, np.stack(spreads, 1) * root], 1)


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of x and the vector q; outside the longs they stay at the nearest long."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) < EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(b) for b in q]
    big = [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x]
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in big], np.int64)


#: Wider vectors aren't turned: that takes the cube of the width.
TURNED = 1024


class SegmentIndex:
    """Statistics of the segments of a shard's rows at every level. Rows are turned first, to the directions in which the shard spreads
    most, widest first: products stay the same, and neighbouring components of a segment are alike in size, so that bounds are tighter."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, levels: tuple[int, ...] = LEVELS):
        self.x, self.ids = x, ids
        width = x.shape[1]
        self.turn = np.linalg.eigh(x.T @ x)[1][:, ::-1] if 0 < width <= TURNED and np.abs(x).max(initial=0) < 1e100 else np.eye(width)
        turned = x @ self.turn
        self.cuts = [cuts_of(turned, n) for n in levels] if width else []
        self.held = [segment_statistics(turned, c).T.copy() for c in self.cuts]
        self.far = float(np.sqrt((x * x).sum(1)).max(initial=0.0))

    def top(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple]:
        """Per query (place, ids, scores) of the candidates that may be among its k largest inner products, with exact scores.

        Level by level: exact scores of the best by bound raise the floor (the k-th largest score so far); candidates whose bound is
        below it are out. The bounds of some queries are one matrix product a level; each query's survivors alone are scored.
        """
        x, ids = self.x, self.ids
        # Candidates scored for the floor: few by the coarse bounds, a SEEDS part of all by the finest, which come near the true k-th score.
        seeds = [min(len(x), max(2 * k + 1, len(x) // SEEDS if c is self.cuts[-1] else 0)) for c in self.cuts]
        for at in range(0, len(queries), TOGETHER):
            part = queries[at : at + TOGETHER]
            slack = 1e-9 * (1 + self.far * np.sqrt((part * part).sum(1)))[:, None]  # rounding of the bounds
            left = ids[None] != query_ids[at : at + TOGETHER, None]
            floor = np.full((len(part), 1), -np.inf)
            for cuts, h, seed in zip(self.cuts, self.held, seeds, strict=True):
                bound = np.where(left, segment_statistics(part @ self.turn, cuts) @ h, -np.inf)
                best = np.argpartition(bound, len(x) - seed, axis=1)[:, len(x) - seed :]
                for i, rows in enumerate(best):
                    rows = rows[left[i, rows]]
                    if len(rows) >= k:
                        floor[i] = max(float(floor[i, 0]), float(np.partition(_products(x[rows], part[i]), -k)[-k]))
                left &= bound + slack >= floor
            for i in range(len(part)):
                some = np.flatnonzero(left[i])
                yield at + i, ids[some], _products(x[some], part[i])


def exact_top(scratch: Scratch, vectors: DataFrame, every: int, k: int, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of floor(scale * x), for queries whose id is divisible by `every`."""
    rows = clean(vectors, id_col, vector_col).withColumn("v", F.transform("v", lambda x: _floor(x * scale)))

    def index(x: np.ndarray, ids: np.ndarray) -> Callable:
        held = SegmentIndex(x, ids)
        return lambda queries, query_ids: held.top(queries, query_ids, k)

    return _search(scratch, rows, every, k, "long", False, index)


def _floor(x):
    # floor() gives a long; beyond its range a double has no fraction and stays as it is.
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)
