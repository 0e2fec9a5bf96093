"""Embeddings against the singular value decomposition of the whole matrix."""

import random

import numpy as np
import pytest

from lexforge.operators import embedding


def texts():
    rng = random.Random(4)
    topics = [[f"{t}word{k}" for k in range(30)] for t in "abcde"]
    rows = [(i, " ".join(rng.choice(topics[i % 5] if rng.random() < 0.9 else topics[rng.randrange(5)]) for _ in range(rng.randint(5, 60)))) for i in range(400)]
    return rows + [(400, None), (401, ""), (402, "!!!"), (403, rows[0][1]), (404, "aword1 " * 50_000)]


def test_embeddings_span_the_main_directions(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(7)
    dims, rank = 256, 4
    held = embedding.hashed_terms(docs, "doc_id", "text", dims).collect()
    n, having = sum(bool(r["at"]) for r in held), np.zeros(dims)
    for r in held:
        having[list(r["at"])] += 1
    weights = np.log((1 + n) / (1 + having)) + 1
    a = np.zeros((len(held), dims))
    for i, r in enumerate(held):
        assert dict(zip(r["at"], r["n"], strict=True)) == embedding.hashed_counts(dict(rows)[r["doc_id"]] or "", dims)
        for c, k in zip(r["at"], r["n"], strict=True):
            a[i, c] = np.sign(k) * np.log1p(abs(k)) * weights[c]
        a[i] /= max(np.linalg.norm(a[i]), 1e-300)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    table = embedding.hashed_terms(docs, "doc_id", "text", dims)
    found = embedding.directions(table, dims, rank, rounds=8)
    assert found.values == pytest.approx(s[:rank] ** 2, rel=1e-6)
    assert np.abs(np.linalg.svd(vt[:rank] @ found.axes)[1] - 1).max() < 1e-6  # the same subspace
    got = {r["doc_id"]: r["embedding"] for r in embedding.embed(docs, dims=dims, rank=rank, rounds=8).collect()}
    assert len(got) == len(rows) and all(got[i] is None for i in (400, 401, 402)) and got[0] == got[403]
    for i, r in enumerate(held):
        if r["at"]:
            want = a[i] @ found.axes
            assert got[r["doc_id"]] == pytest.approx((want / np.linalg.norm(want)).tolist(), abs=1e-5)
    same = [np.dot(got[i], got[i + 5]) for i in range(0, 395)]
    other = [np.dot(got[i], got[i + 1]) for i in range(0, 395)]
    assert np.mean(same) > np.mean(other) + 0.5


def test_no_documents(spark):
    assert embedding.embed(spark.createDataFrame([], "doc_id int, text string"), dims=32, rank=2).collect() == []
    none = embedding.embed(spark.createDataFrame([(1, None)], "doc_id int, text string"), dims=32, rank=2).collect()
    assert [tuple(r) for r in none] == [(1, None)]
