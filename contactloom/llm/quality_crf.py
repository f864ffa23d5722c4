"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every non-empty line is good or bad.  Its features describe the line and the lines
before and after it.  Forward-backward gives each line's probability of being
good; their mean, weighted by line length, is the document's quality, which a
logistic curve calibrates.  Training uses a bounded sample of labelled rows
(`FIT_ROWS` rows of `FIT_BYTES` together): lines begin with their document's label, and lines of bad documents
that look good are then relabelled once before the final fit.

Null and empty texts and texts of line breaks alone have no lines and quality 0.
Repeated rows are scored alike, a null doc_id stays null, other columns are passed
over, empty tables give empty results; without labels every score is 0.5.  Chains of
any length are read whole, in a number of steps that grows with the root of the length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, fit_logistic, labelled_sample, sigmoid
from .kernel import SYMBOL, WHITE, Chunk, chunks, mix, row_sums, span_hash

#: Bounds of the training sample: rows, and lines of a training sequence (longer documents are cut into several).
FIT_ROWS = 3000
FIT_LINES = 64
THRESHOLD = 0.3
SCHEMA = "doc_id long, score double, predicted int, n_lines long, line_quality double"

BREAK = np.zeros(256, bool)
BREAK[10] = True
DIGIT, UPPER, STOP, PIPE = (np.zeros(256, bool) for _ in range(4))
DIGIT[48:58] = UPPER[65:91] = True
STOP[list(b".!?")] = True
PIPE[ord("|")] = True
#: Own features of a line, by place, that the lines before and after also lend.
LENT = (1, 3, 4, 7, 8, 9, 10)


def lines(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every non-empty line, line lengths, and the bounds of each row's lines."""
    ls, le = c.tokens(BREAK)
    n = len(ls)
    bounds = np.searchsorted(ls, c.offsets)
    if not n:
        return np.zeros((0, 12 + 2 * len(LENT) + 2)), np.zeros(0), bounds
    size = (le - ls).astype(float)
    ws, we = c.words
    h = c.hashes()
    wb = np.append(np.searchsorted(ws, ls), len(ws))
    wb[:-1] = np.minimum(wb[:-1], len(ws))
    words = np.diff(wb).astype(float)
    some = np.maximum(words, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[c.data].astype(np.int64))])
        return (total[le] - total[ls]) / size

    line_of = np.repeat(np.arange(n), np.diff(wb))
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    key = h ^ mix(line_of.astype(np.uint64) + np.uint64(1))
    kinds = np.bincount(line_of[np.unique(key, return_index=True)[1]], minlength=n) if len(h) else np.zeros(n)
    row = np.searchsorted(c.offsets, ls, "right") - 1
    whole = span_hash(c.data, ls, le) ^ mix(row.astype(np.uint64) + np.uint64(1))
    _, inverse, count = np.unique(whole, return_inverse=True, return_counts=True)
    symbol_end = SYMBOL[c.data[np.maximum(we - 1, 0)]].astype(float)
    own = np.column_stack([
        np.ones(n), np.log1p(size) / 5, np.log1p(words) / 3, np.minimum((we - ws).sum() and row_sums((we - ws).astype(float), wb) / some, 30) / 10,
        share(SYMBOL), share(DIGIT), share(UPPER), row_sums(again, wb) / some, (count[inverse] > 1).astype(float), 1 - kinds / some,
        share(PIPE) * 5 + row_sums(symbol_end, wb) / some, STOP[c.data[le - 1]].astype(float),
    ])
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    starts = bounds[:-1][np.diff(bounds) > 0]
    first[starts] = True
    last[np.append(starts[1:], n) - 1] = True
    before, after = np.roll(own[:, LENT], 1, 0), np.roll(own[:, LENT], -1, 0)
    before[first], after[last] = 0, 0
    return np.column_stack([own, before, after, first, last]), size, bounds


def along(m: np.ndarray) -> np.ndarray:
    """Rows v[k] proportional to v[k - 1] @ m[k] from an even v[-1], in about 2 * sqrt(n) steps.

    Blocks of matrices are multiplied up side by side, their totals carried from block to block and
    applied to all.  A matrix of equal rows forgets what was before it, which is how a chain starts."""
    n = len(m)
    wide = max(1, int(np.ceil(np.sqrt(n))))
    many = -(-n // wide)
    a = np.full((many * wide, 2, 2), 0.5)
    a[:n] = m
    a = a.reshape(many, wide, 2, 2)
    a /= a.sum((2, 3), keepdims=True)
    for k in range(1, wide):
        x = a[:, k - 1] @ a[:, k]
        a[:, k] = x / x.sum((1, 2), keepdims=True)
    carry = np.full((many, 2), 0.5)
    for b in range(1, many):
        x = carry[b - 1] @ a[b - 1, -1]
        carry[b] = x / x.sum()
    v = np.einsum("bi,bkij->bkj", carry, a).reshape(-1, 2)[:n]
    return v / v.sum(1, keepdims=True)


def forward_backward(score: np.ndarray, bounds: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the good state, expected transitions and expected starts of many chains at once.

    score: log potential of good against bad of each line; trans and start: log potentials.  The
    messages of all chains, however long, are one scan each way."""
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), np.zeros(2)
    emit = np.column_stack([np.ones(n), np.exp(np.clip(score, -25, 25))])
    t, s = np.exp(trans), np.exp(start)
    inner = np.ones(n, bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    ahead = np.where(inner[:, None, None], t[None], s[None, None]) * emit[:, None, :]
    alpha = along(ahead)
    # the message from line k + 1 to line k; even where k + 1 begins a chain, and behind the last line
    back = np.full((n, 2, 2), 0.5)
    j = np.flatnonzero(inner)
    back[j - 1] = (t[None] * emit[j][:, None, :]).transpose(0, 2, 1)
    beta = along(back[::-1])[::-1]
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    pair = alpha[j - 1][:, :, None] * t[None] * (emit[j] * beta[j])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return p[:, 1], pair.sum(0), p[~inner].sum(0)


@dataclass
class Field:
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def marginals(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return forward_backward(x @ self.weights, bounds, self.trans, self.start)[0]

    def quality(self, x: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        p = self.marginals(x, bounds) if len(x) else np.zeros(0)
        return row_sums(p * size, bounds) / np.maximum(row_sums(size.astype(float), bounds), 1)

    def score(self, quality: np.ndarray) -> np.ndarray:
        q = np.clip(quality, 1e-4, 1 - 1e-4)
        return sigmoid(self.curve[0] * np.log(q / (1 - q)) + self.curve[1])


def train(x: np.ndarray, y: np.ndarray, bounds: np.ndarray, weight: np.ndarray, steps: int = 150) -> Field:
    """Maximum likelihood by Adam; weight balances the lines of the two classes in the emissions."""
    w, trans, start = np.zeros(x.shape[1]), np.zeros((2, 2)), np.zeros(2)
    n, chains = len(y), max(1, len(bounds) - 1)
    inner = np.ones(n, bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    j = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[j - 1].astype(int), y[j].astype(int)), 1)
    begun = np.bincount(y[~inner].astype(int), minlength=2)
    state = [np.zeros_like(v) for v in (w, trans, start)], [np.zeros_like(v) for v in (w, trans, start)]
    for k in range(1, steps + 1):
        p, pair, first = forward_backward(x @ w, bounds, trans, start)
        grads = (x.T @ ((p - y) * weight) / n + 1e-4 * w, (pair - seen) / n + 1e-3 * trans, (first - begun) / chains + 1e-2 * start)
        for v, g, m, s in zip((w, trans, start), grads, *state, strict=True):
            m[...] = 0.9 * m + 0.1 * g
            s[...] = 0.99 * s + 0.01 * g * g
            v -= 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return Field(w, trans, start)


def _sample(batch: pa.RecordBatch) -> dict:
    out = []
    for c in chunks(column(batch, "text")):
        x, size, bounds = lines(c)
        x = x.astype(np.float32)
        out += [x[bounds[i] : bounds[i + 1]].tobytes() + size[bounds[i] : bounds[i + 1]].astype(np.float32).tobytes() for i in range(c.n)]
    return {"doc_id": column(batch, "doc_id"), "y": column(batch, "y"), "f": pa.array(out, pa.binary())}


def fit(docs: DataFrame, labels: DataFrame, where: object = None, limit: int = FIT_ROWS) -> Field:
    """Train on at most `limit` labelled rows that satisfy `where`."""
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if where is None else where, limit)
    got = sorted((r.doc_id, bytes(r.f), r.y) for r in arrow_map(sample, _sample, "doc_id long, y int, f binary").collect())
    width = 12 + 2 * len(LENT) + 2
    y = np.array([r[2] for r in got], float)
    flat = [np.frombuffer(r[1], np.float32).astype(float) for r in got]
    counts = np.array([len(f) // (width + 1) for f in flat], int)
    if not counts.sum() or len(set(y)) < 2:
        return Field(np.zeros(width), np.zeros((2, 2)), np.zeros(2), (0.0, 0.0))
    x = np.concatenate([f[: n * width].reshape(n, width) for f, n in zip(flat, counts, strict=True)])
    size = np.concatenate([f[n * width :] for f, n in zip(flat, counts, strict=True)])
    docs_at = np.concatenate([[0], np.cumsum(counts)])
    cut = np.unique(np.concatenate([docs_at, *[np.arange(a, b, FIT_LINES) for a, b in zip(docs_at[:-1], docs_at[1:], strict=True)]]))
    label = np.repeat(y, counts)

    def balanced(v: np.ndarray) -> np.ndarray:
        share = min(max(float(v.mean()), 0.02), 0.98)
        return np.where(v == 1, 0.5 / share, 0.5 / (1 - share))

    model = train(x, label, cut, balanced(label))
    p = model.marginals(x, docs_at)
    looks = (label == 0) & (p > 0.7)
    left = row_sums(((label == 0) & ~looks).astype(np.int64), docs_at)
    looks &= np.repeat(left > 0, counts)  # a bad document keeps a bad line
    label[looks] = 1
    model = train(x, label, cut, balanced(label))
    q = np.clip(model.quality(x, size, docs_at), 1e-4, 1 - 1e-4)
    w, b = fit_logistic(np.log(q / (1 - q))[:, None], y, l2=1e-3)
    model.curve = (float(w[0]), b)
    return model


def score(docs: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """Score every row of docs (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> dict:
        quality, count = [np.zeros(0)], [np.zeros(0, np.int64)]
        for c in chunks(column(batch, "text")):
            x, size, bounds = lines(c)
            quality.append(model.quality(x, size, bounds))
            count.append(np.diff(bounds))
        q = np.concatenate(quality)
        p = model.score(q)
        return {"doc_id": column(batch, "doc_id"), "score": p, "predicted": (p >= threshold).astype(np.int32), "n_lines": np.concatenate(count), "line_quality": q}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)
