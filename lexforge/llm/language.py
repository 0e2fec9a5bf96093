"""Language identification by a bidirectional gated recurrent network over bytes.

Training is plain numpy: forward in both directions, cross entropy at every byte, backpropagation through time, Adam. It sees windows of
a bounded sample: per language documents of small id hash. Prediction covers whole texts: UTF-8 bytes are cut into segments that
start from a zero state, every byte gets a distribution over languages, and a document's is the mean over its bytes.

Defined cases: a null text, or one without any letter, is `und` with score 0; so is every text if there is nothing to learn from; a null
id hashes as the empty string; repeated rows get the same result; an empty table gives no rows. Only id, text and (for training) lang
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_each, small_batches

UNKNOWN = "und"
HIDDEN = 8
#: Bytes of a segment; segments computed at once.
SEGMENT, TOGETHER = 256, 1024
#: Bounds of the training sample: documents a language, and windows of a document, drawn from the whole of its text.
SAMPLE_DOCS, SAMPLE_WINDOWS = 320, 32
STEPS, BATCH, WINDOW, RATE = 300, 128, 64, 0.02


@dataclass
class Model:
    """Per direction: table (256, 3h) of input contributions, recurrent (h, 3h), inner bias (h); out (2h, languages) and its bias."""

    languages: list[str]
    weights: dict[str, np.ndarray]


def _fresh(n: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, out = HIDDEN, {}
    for d in "fb":
        out[f"table_{d}"] = rng.normal(0, 0.3, (256, 3 * h))
        out[f"back_{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
        out[f"inner_{d}"] = np.zeros(h)
    return {k: v.astype(np.float32) for k, v in (out | {"out": rng.normal(0, 0.3, (2 * h, n)), "bias": np.zeros(n)}).items()}


def _cell(w, d, x, state):
    """One step of the unit: reset and update gates, candidate. x: bytes (n,)."""
    h = HIDDEN
    given, back = w[f"table_{d}"][x], state @ w[f"back_{d}"]
    gates = 1 / (1 + np.exp(-(given[:, : 2 * h] + back[:, : 2 * h])))
    reset, update = gates[:, :h], gates[:, h:]
    inner = back[:, 2 * h :] + w[f"inner_{d}"]
    fresh = np.tanh(given[:, 2 * h :] + reset * inner)
    return update * state + (1 - update) * fresh, (state, reset, update, inner, fresh)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over all positions of x (n, t) with labels y (n,), and its gradient by backpropagation through time."""
    n, t = x.shape
    h, grad = HIDDEN, {k: np.zeros_like(v) for k, v in w.items()}
    states, kept = {}, {}
    for d in "fb":
        state, states[d], kept[d] = np.zeros((n, h), w["out"].dtype), np.zeros((t, n, h), w["out"].dtype), {}
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            state, kept[d][i] = _cell(w, d, x[:, i], state)
            states[d][i] = state
    both = np.concatenate([states["f"], states["b"]], 2)
    logits = both @ w["out"] + w["bias"]
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    loss = -np.log(p[:, np.arange(n), y] + 1e-9).mean()
    p[:, np.arange(n), y] -= 1
    p /= n * t
    grad["out"], grad["bias"] = np.einsum("tnh,tnk->hk", both, p), p.sum((0, 1))
    spread = p @ w["out"].T
    for d, part in (("f", spread[:, :, :h]), ("b", spread[:, :, h:])):
        carried = np.zeros((n, h), w["out"].dtype)
        for i in range(t - 1, -1, -1) if d == "f" else range(t):
            before, reset, update, inner, fresh = kept[d][i]
            g = part[i] + carried
            a = g * (1 - update) * (1 - fresh * fresh)
            g_reset = a * inner * reset * (1 - reset)
            g_update = g * (before - fresh) * update * (1 - update)
            gate = np.concatenate([g_reset, g_update], 1)
            back = np.concatenate([gate, a * reset], 1)
            np.add.at(grad[f"table_{d}"], x[:, i], np.concatenate([gate, a], 1))
            grad[f"back_{d}"] += before.T @ back
            grad[f"inner_{d}"] += (a * reset).sum(0)
            carried = g * update + back @ w[f"back_{d}"].T
    return float(loss), grad


def train(samples: list[tuple[str, bytes]], steps: int = STEPS, seed: int = 5) -> Model | None:
    """samples: (language, bytes). Windows are drawn with equal shares of the languages."""
    by: dict[str, list[bytes]] = {}
    for lang, text in samples:
        if text:
            by.setdefault(lang, []).append(text)
    languages = sorted(by)
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    whole = [np.frombuffer(b"\n".join(by[x]).ljust(WINDOW, b" "), np.uint8) for x in languages]
    w = _fresh(len(languages), rng)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(len(languages), size=BATCH)
        x = np.stack([whole[k][(at := int(rng.integers(len(whole[k]) - WINDOW + 1))) : at + WINDOW] for k in y.tolist()])
        _, grad = gradients(w, x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * (1 - step / (steps + 1))
        for k, g in grad.items():
            g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            first[k] = np.float32(0.9) * first[k] + np.float32(0.1) * g
            second[k] = np.float32(0.99) * second[k] + np.float32(0.01) * g * g
            w[k] = w[k] - np.float32(rate) * (first[k] / np.float32(1 - 0.9**step)) / (np.sqrt(second[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    return Model(languages, w)


def _positions(model: Model, x: np.ndarray, lengths: np.ndarray, each: bool = False):
    """Sums over positions of the label distribution of segments x (n, t), of falling lengths; with each, all distributions (t, n, k)."""
    h, w, n, t = HIDDEN, model.weights, len(x), int(lengths[0])
    active = (lengths[None] > np.arange(t)[:, None]).sum(1)
    halved = {}
    for d in "fb":  # sigmoid(v) = (1 + tanh(v / 2)) / 2: one tanh serves all gates
        table, back = w[f"table_{d}"].copy(), w[f"back_{d}"].copy()
        table[:, : 2 * h] *= 0.5
        back[:, : 2 * h] *= 0.5
        halved[d] = table, back, w[f"inner_{d}"]
    turned = np.ascontiguousarray(x.T)
    ahead = np.zeros((t, n, h), np.float32)

    def step(d, i, m, state):
        table, back, inner = halved[d]
        given, again = table[turned[i, :m]], state @ back
        gates = given[:, : 2 * h] + again[:, : 2 * h]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        fresh = again[:, 2 * h :] + inner
        fresh *= gates[:, :h]
        fresh += given[:, 2 * h :]
        np.tanh(fresh, out=fresh)
        out = state - fresh
        out *= gates[:, h:]
        out += fresh
        return out

    state = np.zeros((n, h), np.float32)
    for i in range(t):
        state = step("f", i, active[i], state[: active[i]])
        ahead[i, : active[i]] = state
    k = len(model.languages)
    total, every = np.zeros((n, k)), np.zeros((t, n, k), np.float32) if each else None
    state = np.zeros((0, h), np.float32)
    for i in range(t - 1, -1, -1):
        m = active[i]
        if len(state) < m:
            state = np.concatenate([state, np.zeros((m - len(state), h), np.float32)])
        state = step("b", i, m, state)
        p = ahead[i, :m] @ w["out"][:h]
        p += state @ w["out"][h:]
        p += w["bias"]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        total[:m] += p
        if each:
            every[i, :m] = p
    return total, every


def _segments(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    for i, text in enumerate(texts):
        for at in range(0, len(text), SEGMENT):
            yield i, text[at : at + SEGMENT]


def distributions(model: Model, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): each text's mean label distribution over all its bytes; zero for empty ones."""
    out = np.zeros((len(texts), len(model.languages)))
    parts = sorted(_segments(texts), key=lambda p: -len(p[1]))
    for at in range(0, len(parts), TOGETHER):
        some = parts[at : at + TOGETHER]
        lengths = np.array([len(p) for _, p in some])
        width = int(lengths[0])
        x = np.frombuffer(b"".join(p.ljust(width, b" ") for _, p in some), np.uint8).reshape(-1, width)
        total, _ = _positions(model, x, lengths)
        np.add.at(out, [i for i, _ in some], total)
    return out / np.maximum(1, [len(t) for t in texts])[:, None]


def label_positions(model: Model, text: str) -> list[str]:
    """The language of every byte of a text."""
    out: list[str] = []
    data = text.encode()
    for at in range(0, len(data), SEGMENT):
        part = np.frombuffer(data[at : at + SEGMENT], np.uint8)[None]
        _, every = _positions(model, part, np.array([part.shape[1]]), each=True)
        out += [model.languages[k] for k in every[:, 0].argmax(1).tolist()]
    return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def has_letter(text: str) -> bool:
    """Whether any character is of Unicode's category L; numerals such as one half or Roman four aren't."""
    return any(map(str.isalpha, text))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """Per language at most SAMPLE_DOCS documents that aren't held out, of small id hash. Training draws windows anyway: of a text with more
    than SAMPLE_WINDOWS of them that many are drawn here, at hashed places anywhere in the whole text; others come whole."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"), held_out(id_col).alias("out"))
    rows = rows.filter(~F.col("out") & F.col("l").isNotNull() & (F.length("t") > 0)).withColumn("h", F.xxhash64("i"))
    rows = few_each(rows, "l", F.col("h"), SAMPLE_DOCS, "i", "t")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = text.as_py().encode()
                if len(data) > SAMPLE_WINDOWS * WINDOW:
                    places = np.random.default_rng(h % 2**64).integers(0, len(data) - WINDOW + 1, SAMPLE_WINDOWS)
                    data = b"".join(data[at : at + WINDOW] for at in places.tolist())
                out.append(data)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["l", "h", "t"])

    small_batches(docs.sparkSession, 256)
    got = rows.select("l", "h", "t").mapInArrow(windows, "l string, h long, t binary").collect()
    return sorted((r["l"], bytes(r["t"])) for r in got)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score): each row of docs as a struct, its language and that language's pooled probability."""
    small_batches(docs.sparkSession, 256)
    rows, at = docs.select(F.struct(*docs.columns).alias("row")), docs.columns.index(text_col)  # texts are sent once, within their rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(0).flatten()[at].cast(pa.string()).to_pylist()]
            read = [t.encode() if model is not None and has_letter(t) else b"" for t in texts]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if any(read):
                p = distributions(model, read)
                for i, k in enumerate(p.argmax(1).tolist()):
                    if read[i]:
                        langs[i], scores[i] = model.languages[k], float(min(1.0, p[i, k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    fields = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {fields}, lang_pred string, score double")
