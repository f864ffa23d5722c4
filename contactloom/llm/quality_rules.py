"""Quality rules: document statistics plus a calibrated n-gram classifier against a fixed threshold.

The classifier is a logistic regression over hashed word unigrams, word bigrams
and character trigrams, each block averaged over the document, trained on a bounded
sample of labelled rows (`FIT_ROWS` rows of `FIT_BYTES` together) and calibrated by Platt scaling on a part of
the sample kept apart.  Scoring runs in Arrow batches over whole texts.

Null and empty texts have no words: all counts are 0, `base_failed` is true and
`kept` false.  Repeated rows are scored alike; a null doc_id stays null; other
columns are passed over (`score`) or kept as they are (`keep`).  Empty tables
give empty results; without labels the classifier gives 0.5 to every text.  Very long
texts are counted whole; a worker holds about 40 times the bytes of the longest one.
Lines and windows count as equal only where their bytes and words are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_filter, arrow_map, column, fit_logistic, labelled_sample, sigmoid
from .kernel import SYMBOL, WHITE, Chunk, chunks, mix, row_sums, window_places, windows

#: Bound on the labelled rows that the classifier is fitted on.
FIT_ROWS = 3000
BITS = 16
SIZE = 1 << BITS
#: Documents whose calibrated probability of being good is below this are rejected.
THRESHOLD = 0.3
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def statistics(c: Chunk) -> dict[str, np.ndarray]:
    """The counted properties of each row of a chunk."""
    bounds, h, row = c.bounds, c.hashes(), np.arange(c.n)
    n_words = np.diff(bounds)
    points = (c.data & 0xC0) != 0x80
    out = {"n_words": n_words, "word_chars": row_sums((points & ~WHITE[c.data]).astype(np.int64), c.offsets), "n_symbols": row_sums(SYMBOL[c.data].astype(np.int64), c.offsets)}
    out["n_dup_lines"] = np.array([repeated_lines(c.text(i)) for i in range(c.n)], np.int64)
    cover = np.zeros(len(h) + 1, np.int64)
    hit = repeated_windows(c, row)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 5, -1)
    out["n_repeat_words"] = row_sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), bounds)
    return out


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen = [x for x in text.split(b"\n") if x.strip()]  # bytes.strip() drops the white space of WHITE
    return len(seen) - len(set(seen))


def repeated_windows(c: Chunk, row: np.ndarray) -> np.ndarray:
    """First words of the 5-word windows that occur twice or more in their row; neighbours of one hash are compared word by word."""
    at, hashes = windows(c.hashes(), c.bounds, 5)
    key = hashes ^ mix(np.repeat(row, np.diff(c.bounds))[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if same.any():
        number, of = c.numbers()[1], np.repeat(row, np.diff(c.bounds))
        one, two = at[order[:-1][same]], at[order[1:][same]]
        if (of[one] != of[two]).any() or any((number[one + j] != number[two + j]).any() for j in range(5)):  # two windows of one hash
            full = np.column_stack([of[at], *(number[at + j] for j in range(5))])
            order = np.lexsort(full.T[::-1])
            same = (full[order][1:] == full[order][:-1]).all(1)
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return at[order[twice]]


def ngrams(c: Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per block of features: hashed index of each occurrence and the bounds of each row's occurrences."""
    bounds, h = c.bounds, c.hashes()
    at, pairs = windows(h, bounds, 2)
    points = np.frombuffer(c.data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    offsets = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])[c.offsets]  # of rows, in code points
    n = max(0, len(points) - 2)
    tri = mix(points[:n] | points[1 : n + 1] << np.uint64(21) | points[2 : n + 2] << np.uint64(42))
    place = window_places(offsets, 3)
    cut = np.uint64(64 - BITS)
    return [
        ((h >> cut).astype(np.int64), bounds),
        ((pairs >> cut).astype(np.int64) + SIZE, np.searchsorted(at, bounds)),
        ((tri[place] >> cut).astype(np.int64) + 2 * SIZE, np.searchsorted(place, offsets)),
    ]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    scale: tuple[float, float]

    def raw(self, c: Chunk) -> np.ndarray:
        out = np.full(c.n, self.bias)
        for index, bounds in ngrams(c):
            out += row_sums(self.weights[index], bounds) / np.maximum(np.diff(bounds), 1)
        return out

    def score(self, c: Chunk) -> np.ndarray:
        return sigmoid(self.scale[0] * self.raw(c) + self.scale[1])


def _features(batch: pa.RecordBatch) -> dict:
    packed = []
    for c in chunks(column(batch, "text")):
        blocks = ngrams(c)
        for i in range(c.n):
            keys, values = [], []
            for index, bounds in blocks:
                k, v = np.unique(index[bounds[i] : bounds[i + 1]], return_counts=True)
                keys.append(k)
                values.append(v / max(1, v.sum()))
            packed.append(np.concatenate(keys).astype(np.int32).tobytes() + np.concatenate(values).astype(np.float32).tobytes())
    return {"doc_id": column(batch, "doc_id"), "y": column(batch, "y"), "f": pa.array(packed, pa.binary())}


def fit(docs: DataFrame, labels: DataFrame, where: object = None, limit: int = FIT_ROWS) -> Model:
    """Train on at most `limit` labelled rows that satisfy `where`."""
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if where is None else where, limit)
    got = arrow_map(sample, _features, "doc_id long, y int, f binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.f)))
    y = np.array([r.y for r in got], float)
    weights = np.zeros(3 * SIZE)
    if not len(y) or y.min() == y.max():
        p = float(y.mean() * 0.98 + 0.01) if len(y) else 0.5
        return Model(weights.astype(np.float32), 0.0, (1.0, math.log(p / (1 - p))))
    flat = [np.frombuffer(r.f, np.int32) for r in got]
    index = np.concatenate([x[: len(x) // 2] for x in flat]).astype(np.int64)
    value = np.concatenate([x[len(x) // 2 :].view(np.float32) for x in flat]).astype(np.float64)
    row = np.repeat(np.arange(len(got)), [len(x) // 2 for x in flat])
    apart = np.arange(len(got)) % 5 == 4
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart[:] = False
    fitted = ~apart
    balance = np.where(y == 1, 0.5 / y[fitted].mean(), 0.5 / (1 - y[fitted].mean())) * fitted / fitted.sum()
    bias, m, v = 0.0, np.zeros(3 * SIZE), np.zeros(3 * SIZE)
    for step in range(1, 81):  # Adam on the whole sample
        z = np.bincount(row, value * weights[index], len(got)) + bias
        g = (sigmoid(z) - y) * balance
        grad = np.bincount(index, value * g[row], 3 * SIZE) + 1e-7 * weights
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        weights -= 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        bias -= 0.5 * g.sum()
    model = Model(weights.astype(np.float32), bias, (1.0, 0.0))
    z = np.bincount(row, value * model.weights[index], len(got)) + bias
    held = apart if apart.any() else fitted
    w, b = fit_logistic(z[held][:, None], y[held], l2=1e-2)
    model.scale = (float(w[0]), b) if w[0] > 0 else (1.0, 0.0)
    return model


def verdicts(model: Model, text: pa.Array, threshold: float = THRESHOLD) -> dict[str, np.ndarray]:
    parts = []
    for c in chunks(text):
        s = statistics(c)
        s["score"] = model.score(c)
        s["base_failed"] = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
        s["kept"] = ~s["base_failed"] & (s["score"] >= threshold)
        parts.append(s)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in names}


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Statistics, probability and verdict of every row of docs (doc_id, text)."""
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), lambda b: {"doc_id": column(b, "doc_id"), **verdicts(model, column(b, "text"), threshold)}, SCHEMA)


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    return arrow_filter(docs, lambda b: verdicts(model, column(b, "text"), threshold)["kept"])
