"""Model-shaped operators: token counts, a regression head on embeddings, and the seam for outside models."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_reply
from ..sources.answers import ask_all


def encode(rows: DataFrame, tokenizer_path: str, text: str = "text", end_id: int | None = None, start_id: int | None = None) -> DataFrame:
    """rows with `ids`, by a tokenizer file that every executor can open; texts go in Arrow batches."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(tokenizer_path)
        head, tail = [] if start_id is None else [start_id], [] if end_id is None else [end_id]
        for texts in batches:
            yield pd.Series([head + e.ids + tail for e in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)])

    return rows.withColumn("ids", run(text))


def count_tokens(rows: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """rows with `tokens`, the end marker included."""
    return encode(rows, tokenizer_path, text).withColumn("tokens", F.size("ids") + 1).drop("ids")


@dataclass
class Head:
    weights: list[np.ndarray]
    epochs: int
    loss: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return _gelu(x @ w1 + b1) @ w2[:, 0] + b2[0]


def _gelu(z: np.ndarray) -> np.ndarray:
    return 0.5 * z * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))


def _gelu_slope(z: np.ndarray) -> np.ndarray:
    t = np.tanh(0.7978845608 * (z + 0.044715 * z**3))
    return 0.5 * (1 + t) + 0.5 * z * (1 - t * t) * 0.7978845608 * (1 + 3 * 0.044715 * z * z)


def train_head(
    x: np.ndarray, y: np.ndarray, groups: np.ndarray, val: tuple[np.ndarray, np.ndarray, np.ndarray], *, hidden: int = 128, rate: float = 1e-3, decay: float = 0.01, dropout: float = 0.1, batch: int = 64, epochs: int = 30, patience: int = 5, min_delta: float = 1e-3, seed: int = 42
) -> Head:
    """Linear, GELU, dropout, linear; AdamW on squared error. Early stopping by the validation MAE, averaged over groups. The training
    set is a labelled one and small, so it is fitted on the driver."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 1)), np.array([float(y.mean())])]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    best, stale, t = Head([a.copy() for a in w], 0, np.inf), 0, 0
    for epoch in range(1, epochs + 1):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            i = order[at : at + batch]
            z = x[i] @ w[0] + w[1]
            mask = (rng.random(z.shape) >= dropout) / (1 - dropout)
            h = _gelu(z) * mask
            error = (h @ w[2][:, 0] + w[3][0] - y[i]) * 2 / len(i)
            back = error[:, None] * w[2][:, 0][None] * mask * _gelu_slope(z)
            grads = [x[i].T @ back, back.sum(0), h.T @ error[:, None], np.array([error.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                step = rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                w[k] = w[k] * (1 - rate * decay * (k % 2 == 0)) - step
        now = Head([a.copy() for a in w], epoch, 0.0)
        errors = np.abs(now(val[0]) - val[1])
        now.loss = float(np.mean([errors[val[2] == g].mean() for g in np.unique(val[2])]))
        if now.loss < best.loss - min_delta:
            best, stale = now, 0
        else:
            stale += 1
            if stale >= patience:
                break
    return best


def predict(rows: DataFrame, head: Head, vector: str) -> DataFrame:
    """rows with `raw`, the head's output."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(head(np.stack(v.to_numpy()).astype(float)))

    return rows.withColumn("raw", run(vector))


def score_with(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[float]]], text: str = "text", name: str = "score_raw") -> DataFrame:
    """rows with an outside model's score. load runs once a task and returns a function over a batch of texts; rows of a partition are
    sorted by length first, so that batches need little padding."""
    schema = f"{', '.join(f'`{c}` {k}' for c, k in rows.dtypes)}, {name} double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield batch.assign(**{name: model(batch[text].fillna("").tolist())})

    return rows.sortWithinPartitions(F.length(text)).mapInPandas(run, schema)


def with_retries(ask: Callable[[str], str], attempts: int = 4, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str | None, str | None]]:
    """ask as a function that gives (answer, error): a failed call is made again after a pause that doubles each time."""

    def run(prompt: str) -> tuple[str | None, str | None]:
        for turn in range(attempts):
            try:
                return ask(prompt), None
            except Exception as e:  # noqa: BLE001  whatever an outside service raises
                error = f"{type(e).__name__}: {e}"
                if turn + 1 < attempts:
                    sleep(wait * 2**turn)
        return None, error

    return run


def score_batch(items: DataFrame, load: Callable[[], Callable[[str], str]], names: list[str], path: str, attempts: int = 4, wait: float = 1.0) -> DataFrame:
    """items (id, prompt) that the record at `path` doesn't have are asked for, each answer recorded as it comes: (id, raw, error,
    parse_status, one int a name) of all in the record. A reply that can't be read is kept as failed and not asked again."""
    told = ask_all(items, lambda: with_retries(load(), attempts, wait), path)
    values, status = parse_reply(F.coalesce("raw", F.lit("")), names)
    told = told.select("id", "raw", "error", status.alias("parse_status"), values.alias("_v"))
    return told.select("id", "raw", "error", "parse_status", *[F.col("_v")[n].alias(n) for n in names])
