"""Ranked lexical search as a blocked sparse matrix product: item-term multiplicities times term-document impacts, in 64-bit integers.

Documents are read once: of each, its number of terms and the counts of the terms that the block of items asks for are written to a table.
The totals and the terms' document frequencies are counted there. Then tasks stream the table in blocks of BLOCK_DOCS documents, turn each
into a sparse matrix of impacts with terms as its rows, and multiply it by the items row by row (Gustavson): the rows that an item names are
scaled and merged into one accumulator a block. Each task keeps the k best of each item over its blocks and hands on these; they are ranked
by salted parts first, so no item's candidates of all tasks meet in one sort.

Items come in blocks of about ITEM_BYTES of text, dealt by a hash, so what is sent to the tasks is bounded whatever their number.

Defined cases: a null text has no term; a document or item without terms is in no result; a null doc_id is kept and comes before all others
among equals; rows of one doc_id are documents of their own; items equal in id and text are one, those of one id and different texts are
ranked each for itself; an empty table on either side gives no rows; further columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, small_batches

BLOCK_DOCS, ITEM_BYTES = 8192, 16 << 20
#: Parts that an item's candidates are ranked in first.
SALTS = 32
#: Bytes to bytes: letters in lower case, digits, and all bytes beyond ASCII stay; all others separate terms.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def weight(docs: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * having + 1)))


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's count adds to a document's score for each unit of the term's weight."""
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents of n terms. Products beyond 64 bits are taken in Python's integers."""
    if len(n) and 25 * int(n.max()) * docs >= 2**63:
        return np.array([75 + 25 * int(x) * docs // total for x in n], np.int64)
    return 75 + (25 * n * docs) // total


class TermRows:
    """Documents' counts as a sparse matrix by term: row t holds the documents (by place) that have term t, and its impacts there."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, docs: int, total: int):
        column = np.repeat(np.arange(len(n)), sizes)
        values = weights[terms] * impacts(counts, lengths(n, docs, total)[column])
        order = np.argsort(terms, kind="stable")
        self.columns, self.values = column[order], values[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.n_docs = len(n)

    def times(self, named: np.ndarray, often: np.ndarray) -> np.ndarray:
        """One item's row of the product: the rows it names, scaled by its multiplicities and merged."""
        out = np.zeros(self.n_docs, np.int64)
        for t, q in zip(named.tolist(), often.tolist(), strict=True):
            a, b = self.starts[t], self.starts[t + 1]
            out[self.columns[a:b]] += q * self.values[a:b]
        return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by ascending id."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, terms, often) of each item that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, Counter(terms(t or b""))) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = [(i, c) for i, c in rows if c]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.int64()), pa.array([list(c) for _, c in rows], pa.list_(pa.binary())), pa.array([list(c.values()) for _, c in rows], pa.list_(pa.int64()))],
                ["item", "terms", "often"],
            )

    return items.mapInArrow(run, "item long, terms array<binary>, often array<long>")


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, counts) of every row (doc, text): its number of terms, and those of the vocabulary with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            n, named, often = [], [], []
            for text in batch.column(1):
                found = terms(text.as_py() or b"")
                counts = Counter(map(number, found))
                counts.pop(None, None)
                n.append(len(found))
                named.append(list(counts))
                often.append(list(counts.values()))
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(named, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "n", "terms", "counts"])

    return docs.mapInArrow(run, "doc long, n long, terms array<int>, counts array<long>")


def _scored(table: DataFrame, items: list[tuple[int | None, np.ndarray, np.ndarray]], weights: np.ndarray, docs: int, total: int, k: int) -> DataFrame:
    """(no, item, doc, score): of each task, the k best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held = [(none, none)] * len(items)

        def take(block: pa.Table) -> None:
            ids = block.column("doc").to_numpy()
            each = block.column("terms").combine_chunks()
            matrix = TermRows(block.column("n").to_numpy(), np.diff(each.offsets.to_numpy()), each.flatten().to_numpy(), block.column("counts").combine_chunks().flatten().to_numpy(), weights, docs, total)
            for i, (_, named, often) in enumerate(items):
                scores = matrix.times(named, often)
                at = best(scores, ids, k)
                if len(at):
                    score, doc = np.append(held[i][0], scores[at]), np.append(held[i][1], ids[at])
                    at = best(score, doc, k)
                    held[i] = score[at], doc[at]

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= BLOCK_DOCS:
                take(pa.Table.from_batches(waiting))
                waiting = []
        if waiting:
            take(pa.Table.from_batches(waiting))
        for i, (score, doc) in enumerate(held):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(score), pa.int64()), pa.array([items[i][0]] * len(score), pa.int64()), pa.array(doc), pa.array(score)], ["no", "item", "doc", "score"])

    return table.select("doc", "n", "terms", "counts").mapInArrow(run, "no long, item long, doc long, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc")]
    first = F.row_number().over(Window.partitionBy("no", "_salt").orderBy(*order))
    few = rows.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS))).withColumn("_first", first).filter(F.col("_first") <= k)
    rank = F.row_number().over(Window.partitionBy("no").orderBy(*order))
    return few.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(scratch: Scratch, docs: DataFrame, items: DataFrame, k: int, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item; docs has doc_id and text, items item_id and text."""
    spark = scratch.spark
    small_batches(spark, 256)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.col("text").cast("string").cast("binary").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").cast("binary").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = max(1, math.ceil(size / item_bytes)), []
    for block in range(blocks):
        mine = _item_terms(items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)).collect()
        vocabulary: dict[bytes, int] = {}
        for row in mine:
            for term in row.terms:
                vocabulary.setdefault(bytes(term), len(vocabulary))
        asked = [(row.item, np.array([vocabulary[bytes(t)] for t in row.terms]), np.array(row.often, np.int64)) for row in mine]
        table = scratch.save(counted(docs, vocabulary), f"counted-{block}")
        total = table.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        having = table.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = np.zeros(len(vocabulary), np.int64)
        for row in having:
            weights[row.term] = weight(total.docs, row["count"])
        out.append(_ranked(_scored(table, asked, weights, total.docs, total.terms or 1, k), k))
    found = reduce(DataFrame.unionByName, out)
    doc = F.when(F.col("doc") != NULL_ID, F.col("doc"))
    return found.select(F.col("item").alias("item_id"), F.col("rank"), doc.alias("doc_id"), "score")
