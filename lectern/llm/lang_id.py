"""Language identification by a convolutional network over bytes.

Byte embeddings, filters of several widths, maximum over positions, rectifier, softmax; trained in numpy on a bounded
sample of labelled rows, applied to every window of every text. Windows have a fixed length and overlap by the widest
filter less one, so every byte n-gram is seen once. Inference doesn't embed: a filter over two bytes is a table of 65,536
rows, and wider filters are sums of such tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

UNKNOWN = "und"
WINDOW = 128
WIDTHS = (2, 3, 4)
STRIDE = WINDOW - max(WIDTHS) + 1


@dataclass(frozen=True)
class Network:
    """labels; embedding (256 x e, the row of byte 0 is zero as it pads); filters[w] (w x e x f); biases (3f); out (3f x labels), out_bias."""

    labels: tuple[str, ...]
    embedding: np.ndarray
    filters: tuple[np.ndarray, ...]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(b"".join(np.ascontiguousarray(x).tobytes() for x in (self.embedding, *self.filters, self.bias, self.out, self.out_bias)) + repr(self.labels).encode()).hexdigest()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def to_windows(data: bytes) -> np.ndarray:
    """The fixed-length windows of a text, zero-padded at its end; none for an empty text."""
    n = len(data)
    if not n:
        return np.zeros((0, WINDOW), np.uint8)
    k = max(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    padded = np.zeros(k * STRIDE + WINDOW - STRIDE, np.uint8)
    padded[:n] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (k, WINDOW), (STRIDE, 1))


def train(texts: list[bytes], langs: list[str], seed: int = 11, embed: int = 8, features: int = 16, steps: int = 700, batch: int = 128, rate: float = 0.01) -> Network:
    """Fit the network on crops of random length and place, languages drawn in equal shares. Adam, cross-entropy."""
    rng = np.random.default_rng(seed)
    labels = tuple(sorted(set(langs)))
    rows = [[t for t, x in zip(texts, langs, strict=True) if x == label and t] or [b" "] for label in labels]
    p = [rng.normal(0, 0.5, (256, embed)), *[rng.normal(0, (1.5 / (w * embed)) ** 0.5, (w, embed, features)) for w in WIDTHS], np.zeros(features * len(WIDTHS)), rng.normal(0, 0.1, (features * len(WIDTHS), len(labels))), np.zeros(len(labels))]
    p = [x.astype(np.float32) for x in p]
    p[0][0] = 0
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, steps + 1 if len(labels) > 1 else 1):
        x, y = np.zeros((batch, WINDOW), np.uint8), rng.integers(0, len(labels), batch)
        for k in range(batch):
            text = rows[y[k]][rng.integers(len(rows[y[k]]))]
            size = min(int(rng.choice((8, 16, 32, 64, WINDOW, WINDOW))), len(text))
            at = rng.integers(0, len(text) - size + 1)
            x[k, :size] = np.frombuffer(text[at : at + size], np.uint8)
        e = p[0][x]
        pooled, where = [], []
        for w, f in zip(WIDTHS, p[1:4], strict=True):
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(batch, WINDOW - w + 1, w * embed)
            c = cols @ f.reshape(w * embed, features)
            at = c.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(c, at[:, None, :], axis=1)[:, 0])
        raw = np.concatenate(pooled, axis=1) + p[4]
        h = np.maximum(raw, 0)
        q = _softmax(h @ p[5] + p[6])
        q[np.arange(batch), y] -= 1
        dz = q / batch
        g = [np.zeros_like(x) for x in p]
        g[5], g[6] = h.T @ dz, dz.sum(axis=0)
        dh = (dz @ p[5].T) * (raw > 0)
        g[4] = dh.sum(axis=0)
        for n, (w, f, at) in enumerate(zip(WIDTHS, p[1:4], where, strict=True)):
            d = dh[:, n * features : (n + 1) * features]
            for j in range(w):
                byte = np.take_along_axis(x, at + j, axis=1)  # batch x features
                g[1 + n][j] = np.einsum("bf,bfe->ef", d, p[0][byte])
                np.add.at(g[0], byte.ravel(), (d[:, :, None] * f[j].T[None]).reshape(-1, embed))
        g[0][0] = 0
        lr = rate * min(1, 2 * (1 - step / (steps + 1)))
        for k in range(len(p)):
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Network(labels, p[0], tuple(p[1:4]), p[4], p[5], p[6])


_TABLES: dict[str, tuple[np.ndarray, ...]] = {}


def _tables(net: Network) -> tuple[np.ndarray, ...]:
    key = net.digest()
    if key not in _TABLES:
        _TABLES.clear()
        one = [[net.embedding @ f[j] for j in range(len(f))] for f in net.filters]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(1 << 16, -1)
        _TABLES[key] = (pair(*one[0]), pair(*one[1][:2]), one[1][2], pair(*one[2][:2]), pair(*one[2][2:]))
    return _TABLES[key]


def probabilities(net: Network, windows: np.ndarray, at_once: int = 192) -> np.ndarray:
    """Softmax of each window (rows of WINDOW bytes)."""
    two, three, three_end, four, four_end = _tables(net)
    out = np.empty((len(windows), len(net.labels)), np.float32)
    for a in range(0, len(windows), at_once):
        w = windows[a : a + at_once]
        pairs = (w[:, :-1].astype(np.int64) << 8) | w[:, 1:]
        x3, x4 = three.take(pairs[:, :-1], axis=0), four.take(pairs[:, :-2], axis=0)
        x3 += three_end.take(w[:, 2:], axis=0)
        x4 += four_end.take(pairs[:, 2:], axis=0)
        pooled = np.concatenate([two.take(pairs, axis=0).max(axis=1), x3.max(axis=1), x4.max(axis=1)], axis=1)
        out[a : a + at_once] = _softmax(np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500, chars: int = 2048, most_languages: int = 500, seed: int = 11) -> Network | None:
    """Train on the rows whose crc32(id as text) mod 4 is not 2 and whose language is known.

    The sample is bounded: about `per_language` rows of each language, drawn by a hash of the identifier, `chars`
    characters of each from a hashed place; more than `most_languages` labels are an error. None without labelled text.
    """
    src = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    src = src.where(F.col("l").isNotNull() & (F.length("t") > 0) & (F.pmod(F.crc32(F.col("i").cast("string").cast("binary")), F.lit(4)) != 2))
    counts = src.groupBy("l").count().limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], 1.1 * per_language / r["count"])])[F.col("l")]
    at = F.pmod(F.xxhash64("i", F.lit(seed + 1)), F.greatest(F.length("t") - chars, F.lit(1))).cast("int") + 1
    rows = src.where(draw < share).select("l", F.col("t").substr(at, F.lit(chars)).alias("t")).limit(2 * per_language * len(counts)).collect()
    rows = sorted((r["l"], r["t"]) for r in rows)
    return train([t.encode() for _, t in rows], [x for x, _ in rows], seed) if rows else None


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", passing: tuple[str, ...] = (), pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """A row per input row: id_col, the `passing` columns (the text itself may be one; one named like the next two gives way to
    it), pred_col and score_col, the mean over the text's windows (by bytes) of the network's probability for the predicted language. Text that is null or has no letter:
    `und` with score 0; so is every text if there was nothing to learn from. Texts of any length are read in all their windows, whose
    number alone grows with the text. Repeated rows and null identifiers are predicted like any other."""
    names = [c for c in dict.fromkeys((id_col, *passing)) if c not in (pred_col, score_col)]
    src = docs.select(*dict.fromkeys((*names, text_col)))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*names).schema) + f", `{pred_col}` string, `{score_col}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            preds, scores = [], []
            for data in as_bytes(b.column(text_col)):
                if net is None or data is None or not any(map(str.isalpha, data.decode("utf-8", "replace"))):
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                w = to_windows(data)
                weight = np.full(len(w), float(STRIDE))
                weight[-1] = len(data) - (len(w) - 1) * STRIDE
                # Long texts go through a bounded number of windows at a time inside probabilities().
                mean = weight @ probabilities(net, w) / weight.sum()
                k = int(mean.argmax())
                preds.append(net.labels[k])
                scores.append(min(1.0, float(mean[k])))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*names, pred_col, score_col])

    return src.mapInArrow(run, ddl)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training; a null identifier isn't (it isn't trained on either)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
