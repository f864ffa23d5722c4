"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding takes Unicode's compatibility forms (full-width and mathematical letters
become plain ones), lower-cases, maps look-alike letters and digit or sign
substitutions to Latin letters and turns everything else that is no letter into
single spaces.  ASCII texts are folded by one byte table.

The lexicon holds whole words and word beginnings of `STEM` letters that a bounded
sample of labelled rows (`FIT_ROWS` rows of `FIT_BYTES` together) shows to be toxic,
weighted by their log odds.  A hit inside an exception phrase does not count:
besides given phrases these are the pairs of neighbouring words around hits that the
same sample shows to be innocent.  The weighted hits, as they are and per word, go
through a calibrated logistic curve.  All counts are of the whole sample, however its
rows are partitioned.

Null and empty texts have no hits and get the score of a text without hits.
Repeated rows are scored alike, a null doc_id stays null, other columns are
passed over, empty tables give empty results; without labels the lexicon is
empty and every score is 0.5.  Very long texts are folded and matched whole, in time
and memory in proportion to their length.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIT_BYTES, arrow_map, column, fit_logistic, labelled_sample, materialise, sigmoid

#: Bound on labelled rows used for the fit.
FIT_ROWS = 8000
#: Support and precision that a lexicon entry needs in the sample, and letters of a word beginning.
LEAST_DOCS = 4
LEAST_PRECISION = 0.8
STEM = (4, 8)
#: A learned exception needs this many clean documents and at most this share of toxic ones.
LEAST_CLEAN = 4
MOST_TOXIC = 0.1
THRESHOLD = 0.3
#: Innocent phrases; a hit that lies within one is not counted.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "recycling trash", "clown fish", "sore loser rule", "pond scum", "worthless check", "scum line")
SCHEMA = "doc_id long, score double, predicted int, n_hits long, hit_weight double, n_words long"

#: Cyrillic, Greek and other letters that look like a Latin one, then digits and signs used for letters.
HOMOGLYPHS = dict(zip("авеһіјкмнорсѕтухԁԛԝαβεηικνορτυχωνıɡ", "abehijkmhopcstyxdqwabenikvoptuxwvig", strict=True))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
_TABLE = {**{ord(a): b for a, b in {**HOMOGLYPHS, **LEET}.items()}, **INVISIBLE}
_GAP = re.compile(r"[\W_]+")


def _byte_table() -> bytes:
    """What fold() makes of each ASCII byte."""
    low = [chr(b).lower() for b in range(128)]
    return bytes(ord(LEET.get(x, x)) if x in LEET or x.isalnum() else 32 for x in low) + bytes(128)


_BYTES = _byte_table()


def fold(text: str | bytes) -> str:
    """Lower case, substitutions undone, one space before each word and at the end."""
    raw = text.encode() if isinstance(text, str) else text
    if raw.isascii():
        return f" {b' '.join(raw.translate(_BYTES).split()).decode()} "
    low = unicodedata.normalize("NFKC", raw.decode()).lower()
    return f" {_GAP.sub(' ', low.translate(_TABLE)).strip()} "


def pieces(folded: str) -> set[str]:
    """What the lexicon may learn from a text: its words and word beginnings of STEM letters, each after a space."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        for k in range(STEM[0], min(STEM[1], len(w) - 1) + 1):
            out.add(f" {w[:k]}")
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[list[float], float] = field(default_factory=lambda: ([0.0, 0.0, 0.0], 0.0))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    @property
    def automaton(self):
        if "_automaton" not in self.__dict__:
            import ahocorasick

            a = ahocorasick.Automaton()
            for p, w in self.weights.items():
                a.add_word(p, (len(p), w))
            for p in self.exceptions:
                if (q := fold(p)) not in self.weights:
                    a.add_word(q, (len(q), None))
            a.make_automaton()
            self.__dict__["_automaton"] = a
        return self.__dict__["_automaton"]

    def measure(self, folded: str) -> tuple[int, float, int]:
        """Hits, their weight and the words of a folded text."""
        words = folded.count(" ") - 1 if len(folded) > 2 else 0
        if not len(self.automaton):
            return 0, 0.0, words
        found, calm = self._matches(folded)
        if calm:
            found = outside(found, calm)
        best: dict[int, float] = {}
        for start, _, w in found:  # a word counts once, with its heaviest entry
            best[start] = max(w, best.get(start, w))
        return len(best), sum(best.values()), words

    def _matches(self, folded: str) -> tuple[list, list]:
        """Hits (start, end, weight) and exception phrases (start, end)."""
        found, calm = [], []
        for end, (length, w) in self.automaton.iter(folded):
            if w is None:
                calm.append((end - length + 1, end + 1))
            else:
                found.append((end - length + 1, end + 1, w))
        return found, calm

    def phrases(self, folded: str) -> set[str]:
        """Pairs of neighbouring words of which one is hit."""
        out = set()
        for start in {s for s, _, _ in self._matches(folded)[0]}:
            end = folded.index(" ", start + 1)
            before, after = folded.rfind(" ", 0, start), folded.find(" ", end + 1)
            if before >= 0 and start > 0:
                out.add(folded[before + 1 : end])
            if after > 0:
                out.add(folded[start + 1 : after])
        return out

    def signals(self, folded: str) -> tuple[list[float], tuple[int, float, int]]:
        n, weight, words = self.measure(folded)
        return [math.log1p(weight), math.log1p(100 * weight / max(words, 20)), math.log1p(n)], (n, weight, words)


def outside(found: list[tuple], calm: list[tuple]) -> list[tuple]:
    """The hits that lie within no exception phrase."""
    calm = sorted(calm)
    starts = [a for a, _ in calm]
    reach, far = [], 0  # how far the phrases up to each one reach
    for _, b in calm:
        far = max(far, b)
        reach.append(far)
    return [x for x in found if not (k := bisect.bisect_right(starts, x[0])) or reach[k - 1] < x[1]]


def _tally(sample: DataFrame, keys: Callable[[str], set[str]]) -> DataFrame:
    """(piece, toxic, total): documents of the sample (text, y) with each of the keys of their folded text."""

    def count(batch: pa.RecordBatch) -> dict:
        totals, toxic = Counter(), Counter()
        for t, y in zip(column(batch, "text").to_pylist(), column(batch, "y").to_pylist(), strict=True):
            p = keys(fold(t or ""))
            totals.update(p)
            if y:
                toxic.update(p)
        pieces_ = list(totals)
        return {"piece": pieces_, "toxic": [toxic[k] for k in pieces_], "total": [totals[k] for k in pieces_]}

    return arrow_map(sample, count, "piece string, toxic long, total long").groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))


def fit(docs: DataFrame, labels: DataFrame, where: object = None, limit: int = FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn entries, weights, exceptions and curve from at most `limit` labelled rows that satisfy `where`.

    The entries that come to the driver are bounded by the sample: each is in LEAST_DOCS of its documents."""
    sample = materialise(labelled_sample(docs, labels, "toxic", F.lit(True) if where is None else where, limit, FIT_BYTES), "toxic-sample")
    rows = _tally(sample, pieces).where((F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") >= LEAST_PRECISION * F.col("total"))).collect()
    n = sample.groupBy("y").count().collect()
    n_toxic, n_clean = (sum(r["count"] for r in n if r.y == v) for v in (1, 0))
    weights: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.piece.rstrip()), r.piece)):
        if not any(r.piece.startswith(p) for p in weights if not p.endswith(" ")):  # its beginning says it already
            weights[r.piece] = max(0.1, math.log((r.toxic + 0.5) / (n_toxic + 1)) - math.log((r.total - r.toxic + 0.5) / (n_clean + 1)))
    plain = Lexicon(weights, ())
    calm = _tally(sample, plain.phrases).where((F.col("total") - F.col("toxic") >= LEAST_CLEAN) & (F.col("toxic") <= MOST_TOXIC * F.col("total"))).collect()
    lexicon = Lexicon(weights, (*exceptions, *sorted(r.piece for r in calm)))

    def signals(batch: pa.RecordBatch) -> dict:
        x = [lexicon.signals(fold(t or ""))[0] for t in column(batch, "text").to_pylist()]
        return {"doc_id": column(batch, "doc_id"), "y": column(batch, "y"), "x": x}

    got = sorted((r.doc_id, list(r.x), r.y) for r in arrow_map(sample, signals, "doc_id long, y int, x array<double>").collect())
    w, b = fit_logistic(np.array([r[1] for r in got]).reshape(-1, 3), np.array([r[2] for r in got], float), l2=1e-3)
    lexicon.curve = ([float(v) for v in w] if len(w) == 3 else [0.0, 0.0, 0.0], float(b))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """Score every row of docs (doc_id, text)."""
    w, b = np.array(lexicon.curve[0]), lexicon.curve[1]

    def run(batch: pa.RecordBatch) -> dict:
        x, raw = [], []
        for t in column(batch, "text").cast(pa.binary()):
            s, m = lexicon.signals(fold(t.as_py() or b""))
            x.append(s)
            raw.append(m)
        p = sigmoid(np.array(x).reshape(-1, 3) @ w + b)
        hits, weight, words = (list(v) for v in zip(*raw, strict=True)) if raw else ([], [], [])
        return {"doc_id": column(batch, "doc_id"), "score": p, "predicted": (p >= threshold).astype(np.int32), "n_hits": hits, "hit_weight": weight, "n_words": words}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)
