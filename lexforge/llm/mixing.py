"""Mixing to target weights by soft membership.

A classifier trained on a labelled table gives each document a posterior over domains. A document of n tokens counts n * p(domain) tokens
towards each domain. Nonnegative rates, one a document, are fitted so that the expected token totals of the domains, sum of
rate * n * p, come as near to the targets as they can: least squares by projected gradient from rate 1. The step is scaled per document
by its tokens and per domain by the inverse of the domains' Gram matrix, so that its Lipschitz constant is 1 and the step length too.
Where targets are out of reach, the least squares are on an edge of what posteriors can mix: few documents keep a rate above 0, a high one,
and a warning gives what is reached.

What is gathered at a step is a few numbers a domain. A step's gradient is as short, so no table of rates is written: each task replays the
steps so far on its own documents, whose tokens and posteriors are written once.

Classifier: multinomial logistic regression on the presence of vocabulary words (A-Z lower-cased, ASCII punctuation at the ends dropped)
and on the shares of character kinds. It is fitted on the driver on at most `SAMPLE` labelled documents a domain, those of small id hash.

Defined cases: a null or empty text has no tokens and rate 1, which changes no total; null labels and labels of unknown documents teach
nothing; without labels all documents are of one domain; a null id gets its rate like any other; repeated rows get the same rate each; an
empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, few_each, small_batches

#: Bounds of the fit: labelled documents a domain, words of the vocabulary.
SAMPLE, VOCABULARY, LEAST_DOCS = 1500, 1000, 5
EPOCHS, RATE, DECAY = 150, 0.05, 1e-3
#: Steps of the rates, beyond which they aren't done, which a warning and the result's residual tell; they end when totals are off by less than SETTLED of the targets, or
#: when the projected gradient would change rates by less than FLAT (root mean square, weighted by tokens).
STEPS, SETTLED, FLAT = 400, 1e-6, 1e-6
#: Proximal steps: the first and the least weight of staying near, and the most Newton steps in one.
NEAR, NEAREST, NEWTON = 1e-2, 1e-9, 60
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()).encode()
LETTERS = bytes(range(ord("a"), ord("z") + 1)) + bytes(range(128, 256))
DIGITS, SPACES = b"0123456789", b" \t\n\r\x0b\x0c"


@dataclass
class Classifier:
    domains: list[str]
    words: dict[bytes, int]
    weights: np.ndarray  # (words + kinds, domains)
    bias: np.ndarray


def tokens(text: str | None) -> tuple[bytes, list[bytes]]:
    data = (text or "").encode().lower()
    return data, data.split()


def word_set(found: list[bytes]) -> set[bytes]:
    return {w.strip(EDGES) for w in set(found)} - {b""}


def kinds(data: bytes) -> list[float]:
    """Shares of digits and of other marks among the bytes that are no white space."""
    n = max(1, len(data.translate(None, SPACES)))
    digits = len(data) - len(data.translate(None, DIGITS))
    marks = len(data.translate(None, LETTERS + DIGITS + SPACES))
    return [10.0 * digits / n, 10.0 * marks / n]


def fit(samples: list[tuple[str, str]], epochs: int = EPOCHS) -> Classifier:
    """samples: (domain, text)."""
    domains = sorted({d for d, _ in samples}) or ["all"]
    read = [tokens(t) for _, t in samples]
    sets = [word_set(found) for _, found in read]
    held: dict[bytes, np.ndarray] = {}
    y = np.array([domains.index(d) for d, _ in samples], int)
    size = np.bincount(y, minlength=len(domains))
    for k, words in zip(y.tolist(), sets, strict=True):
        for w in words:
            if w not in held:
                held[w] = np.zeros(len(domains))
            held[w][k] += 1
    frequent = [w for w, n in held.items() if n.sum() >= LEAST_DOCS]
    whole = np.maximum(1, size)

    def score(n: np.ndarray) -> float:
        """How far the shares of domains that have the word stand apart, in standard errors."""
        mean = n.sum() / whole.sum()
        return float((np.abs(n / whole - mean) / np.sqrt(mean * (1 - mean) / whole + 1e-9)).max())

    spread = {w: score(held[w]) for w in frequent}
    chosen = sorted(frequent, key=lambda w: (-spread[w], w))[:VOCABULARY]
    words = {w: i for i, w in enumerate(chosen)}
    x = np.zeros((len(samples), len(words) + 2), np.float32)
    for i, ((data, _), have) in enumerate(zip(read, sets, strict=True)):
        x[i, [words[w] for w in have if w in words]] = 1
        x[i, -2:] = kinds(data)
    w, b = np.zeros((x.shape[1], len(domains)), np.float32), np.zeros(len(domains), np.float32)
    goal = np.eye(len(domains), dtype=np.float32)[y]
    share = (1 / np.maximum(1, size))[y].astype(np.float32)[:, None] / len(domains)
    m = v = np.zeros_like(w)
    for step in range(1, epochs + 1):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        p /= np.maximum(p.sum(1, keepdims=True), 1e-30)
        g = (p - goal) * share
        grad = x.T @ g + np.float32(DECAY) * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w - np.float32(RATE) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b = b - np.float32(RATE) * 10 * g.sum(0)
    return Classifier(domains, words, w.astype(np.float32), b)


def posterior(model: Classifier, text: str | None) -> tuple[int, np.ndarray]:
    """(tokens, posterior over the domains) of a whole text."""
    data, found = tokens(text)
    rows = [i for w in word_set(found) if (i := model.words.get(w)) is not None]
    z = model.bias + model.weights[rows].sum(0) + np.array(kinds(data), np.float32) @ model.weights[-2:]
    p = np.exp((z - z.max()).astype(float))
    return len(found), p / p.sum()


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, str]]:
    """(domain, text) of at most SAMPLE documents a domain; labels: (id, domain)."""
    marks = labels.filter(F.col("domain").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.min("domain").alias("domain"))
    marks = few_each(marks, "domain", F.xxhash64("id"), SAMPLE, "id")  # bounded: SAMPLE a domain
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "id").filter(F.col("text").isNotNull())
    got = rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text")))).filter("n = 1").select("id", "domain", "text").collect()
    return [(r["domain"], r["text"]) for r in sorted(got, key=lambda r: (r["domain"], r["id"]))]


def memberships(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, p array<double>) of every row, and the long columns `also`."""
    small_batches(docs.sparkSession, 512)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [posterior(model, x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([p.tolist() for _, p in got], pa.list_(pa.float64())), *batch.columns[2:]], ["doc_id", "n_tokens", "p", *also])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *also).mapInArrow(run, ", ".join(["doc_id long, n_tokens long, p array<double>", *(f"{x} long" for x in also)]))


def replay(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates of documents with posteriors p (n, domains) after the steps so far."""
    rate = np.ones(len(p))
    for step in steps:
        rate = np.maximum(0.0, rate - p @ step)
    return rate


def _column(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def gather(members: DataFrame, k: int, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """At the rates after these steps: expected tokens of each domain, and the Gram matrix of the documents whose rate isn't 0. One row
    of k + k * k numbers comes back from each task."""
    names = [f"t{i}" for i in range(k + k * k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            p, n = _column(batch, "p", k), batch.column("n_tokens").to_numpy()
            total += held(p, n, steps)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.tolist()], names)

    row = members.select("n_tokens", "p").mapInArrow(run, ", ".join(f"{x} double" for x in names)).agg(*[F.sum(x) for x in names]).first()
    got = np.array([x or 0.0 for x in row])
    return got[:k], got[k:].reshape(k, k)


def held(p: np.ndarray, n: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    rate = replay(p, steps)
    free = p * (n * (rate > 0))[:, None]
    return np.concatenate([(rate * n) @ p, (free.T @ p).ravel()])


def inverse(gram: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(gram + 1e-9 * np.eye(len(gram)) * max(1.0, float(np.trace(gram))))


def proximal(look, steps: list[np.ndarray], targets: np.ndarray, at: np.ndarray, free: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The step x whose gradient is taken where it leads: near @ x = totals after x - targets, by Newton's method. Its totals and Gram matrix too.

    near is a small multiple of the Gram matrix of all documents; the smaller it is, the longer the step. x is the least point of a convex
    function with gradient targets - totals + near @ x, so slopes along a direction tell how far to go.
    """
    x, first = np.zeros(len(targets)), None
    for _ in range(NEWTON):
        down = at - targets - near @ x
        way = inverse(free + near) @ down
        slope = float(down @ way)
        first = slope if first is None else first
        if slope <= 1e-16 * first:
            break
        t = 1.0
        while True:
            new, new_free = look([*steps, x + t * way])
            over = -float((new - targets - near @ (x + t * way)) @ way)
            if over <= 0.1 * slope or t < 1e-9:
                break
            t *= max(0.1, slope / (slope + over))
        x, at, free = x + t * way, new, new_free
    return x, at, free


def descend(look, targets: np.ndarray, turns: int = STEPS) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps whose replay gives the rates, and the totals they reach. look(steps) gives totals and free Gram matrix.

    A step is the gradient times the inverse Gram matrix of the documents that aren't at 0, which goes straight to the targets
    when no more documents reach 0. Where that doesn't halve the squares, targets may be out of reach: the Gram matrix of all documents
    gives the projected-gradient step of length 1, which always makes squares smaller and tells how far the rates are from the least
    squares; a proximal step, longer each time, goes there. It ends when targets are met or the projected gradient is nothing.
    """
    steps, near = [], NEAR
    at, free = look(steps)
    gram, whole = free, inverse(free)
    enough, tokens = SETTLED * max(1.0, float(np.abs(targets).sum())), max(1.0, float(at.sum()))
    squares = lambda x: float((x - targets) @ whole @ (x - targets))
    while np.abs(at - targets).max() > enough:
        if len(steps) >= turns:
            logging.getLogger(__name__).warning("rates are not at the least squares after %d steps", turns)
            break
        best = (step := inverse(free) @ (at - targets), *look([*steps, step]))
        if not squares(best[1]) <= squares(at) / 2:
            plain = (step := whole @ (at - targets), *look([*steps, step]))
            # Bounds the sum of tokens * (change of the rate)^2 of this step, which is 0 at the least squares only.
            if (at - targets) @ whole @ (at - plain[1]) <= FLAT**2 * tokens:
                break
            best = min(best, plain, proximal(look, steps, targets, at, free, near * gram), key=lambda x: squares(x[1]))
            near = max(near / 10, NEAREST)
            if not squares(best[1]) < squares(at):  # rounding is all that is left
                break
        steps.append(best[0])
        at, free = best[1:]
    return steps, at


def residual(look, steps: list[np.ndarray], targets: np.ndarray) -> float:
    """How far rates after these steps are from the least squares: the change of a rate that a projected-gradient step of length 1 would make
    (root mean square, weighted by tokens). 0 at the least squares, whether or not targets are in reach there; over FLAT if STEPS ended the fit."""
    (start, gram), (at, _) = look([]), look(steps)
    whole = inverse(gram)
    after = look([*steps, whole @ (at - targets)])[0]
    return float(np.sqrt(max(0.0, (at - targets) @ whole @ (at - after)) / max(1.0, float(start.sum()))))


def solve(members: DataFrame, targets: np.ndarray, turns: int = STEPS) -> tuple[list[np.ndarray], np.ndarray]:
    return descend(lambda steps: gather(members, len(targets), steps), targets, turns)


def rates(members: DataFrame, k: int, steps: list[np.ndarray]) -> DataFrame:
    """members with `rate`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = replay(_column(batch, "p", k), steps)
            rate[batch.column("n_tokens").to_numpy() == 0] = 1.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, "rate"])

    return members.mapInArrow(run, ", ".join([*(f"{x} {kind}" for x, kind in members.dtypes), "rate double"]))


def targets_of(weights: dict[str, float], domains: list[str], now: np.ndarray) -> np.ndarray:
    """Target tokens: the weights' shares of all tokens now. Domains without a weight get none."""
    want = np.array([weights.get(d, 0.0) for d in domains])
    return want / max(want.sum(), 1e-12) * now.sum()


@dataclass
class Mix:
    members: DataFrame
    domains: list[str]
    targets: np.ndarray
    reached: np.ndarray
    steps: list[np.ndarray]
    #: See `residual`; 0 where targets are met.
    residual: float

    @property
    def missed(self) -> float:
        """The largest distance of a domain's tokens from its target, as a share of all target tokens; about 0 where targets are met."""
        return float(np.abs(self.reached - self.targets).max(initial=0.0) / max(1.0, float(self.targets.sum())))


def mix(scratch: Scratch, docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, factors: dict[str, float] | None = None, without: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> Mix:
    """labels: (id, domain). Targets: by weights, domain to share of all tokens; or by factors on what a domain has now (else 1).

    without: targets are what the documents hold whose likeliest domain isn't one of these. Soft membership gives every document a little of
    every domain, so a target of zero could only be neared by giving up most clean documents; this one can be reached without.
    also: long columns of docs that members keep.
    """
    model = fit(labelled_sample(docs, labels))
    members = scratch.save(memberships(docs, model, also=also), "members")
    small_batches(docs.sparkSession, 10_000)
    now, _ = gather(members, len(model.domains), [])
    if without:
        likeliest = F.array_position("p", F.array_max("p")) - 1
        kept = members.filter(~likeliest.isin([i for i, d in enumerate(model.domains) if d in without]))
        now, _ = gather(kept, len(model.domains), [])
    targets = now * [(factors or {}).get(d, 1.0) for d in model.domains] if weights is None else targets_of(weights, model.domains, now)
    steps, reached = solve(members, targets)
    left = 0.0
    if np.abs(reached - targets).max(initial=0.0) > SETTLED * max(1.0, float(np.abs(targets).sum())):
        left = residual(lambda s: gather(members, len(targets), s), steps, targets)
        logging.getLogger(__name__).warning("targets out of reach: of %s got %s of %s", model.domains, reached.tolist(), targets.tolist())
    return Mix(rates(members, len(model.domains), steps), model.domains, targets, reached, steps, left)


def quality_domains(labels: DataFrame) -> DataFrame:
    """(id, domain) of the labels table: toxic, else good or low by quality."""
    domain = F.when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("quality") == 1, F.lit("good")).when(F.col("quality") == 0, F.lit("low"))
    return labels.select(F.col("doc_id").alias("id"), domain.alias("domain"))


def source_domains(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, domain) with a document's source as its domain: for mixing sources, rather than quality classes, to target weights."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("domain"))
