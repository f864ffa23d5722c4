"""Periodic runs of words, found by a suffix automaton with small-to-large merging of end positions.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at
least `LEAST_LENGTH` words and `LEAST_EXPONENT` periods, which no neighbouring word extends.

For each text:

1. Words become numbers (equal numbers are equal bytes).  A run longer than 2 q + k - 1 words is covered by
   windows of k words that occur twice in the text; `window_of` gives the k that holds for every period.  Stretches
   that such windows cover go on, all else cannot hold a run (windows are met by hash: a collision only adds work).
2. The suffix automaton of a stretch is built word by word.  States are merged into their suffix links from the
   longest to the shortest; of two ordered sets of end positions the smaller one goes into the larger.  An inserted
   position i with a new neighbour j at a distance d of at most the state's length ends a square: the words
   before i and before j agree over d words and more.
3. A square is extended to both sides while words d apart agree, unless it lies in a run found before.  The
   result is a run if d is its smallest period (no d / f with a prime f is one) and it is long enough.

For a run of smallest period q, the last end position and the one q before it are neighbours in the state where they
meet, because any position between them would give the run a smaller period.  So every run is found.

Each text is judged on its own, by one task, whole.  Null counts as no words, texts without words have no
runs, repeated rows are judged alike, an empty table stays empty, other columns are passed over.  Very long
texts: a worker holds about 60 times the bytes of the longest text, and about 400 bytes for each word of the longest stretch
that repeated windows cover.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, column
from .kernel import Chunk, chunks, window_hash

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
RUN = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
#: From (doc_id, number of words) to the original word behind every place, or None for the text as it is.
Edit = Callable[[int | None, int], np.ndarray | None]


def window_of(least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> int:
    """The largest k for which windows of k words that occur twice cover every run: length >= 2 q + k - 1 for all q."""
    periods = range(1, least_length + 2)
    return max(1, min(max(least_length, least_exponent * q) - 2 * q + 1 for q in periods))


def stretches(words: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Maximal stretches [a, b) that windows of k words occurring twice or more cover."""
    if len(words) < k + 1:
        return []
    at = np.arange(len(words) - k + 1)
    h = window_hash(words.astype(np.uint64), at, k)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return []
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    mark = np.zeros(len(words) + 1, np.int64)
    mark[at[twice]] += 1
    np.add.at(mark, at[twice] + k, -1)
    inside = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and end position (-1 for a clone) of every state; state 0 is the start.

    The first transition of a state stands in two lists, only branching states have a dict."""
    length, link, end = [0], [-1], [-1]
    word, to, more = [-1], [-1], {}

    def follow(v: int, w: int) -> int:
        if word[v] == w:
            return to[v]
        rest = more.get(v)
        return -1 if rest is None else rest.get(w, -1)

    def direct(v: int, w: int, target: int) -> None:
        if word[v] == w or word[v] < 0:
            word[v], to[v] = w, target
        else:
            more.setdefault(v, {})[w] = target

    def state(size: int, at: int) -> int:
        length.append(size)
        link.append(0)
        end.append(at)
        word.append(-1)
        to.append(-1)
        return len(length) - 1

    last = 0
    for i, w in enumerate(words):
        new = state(i + 1, i)
        v = last
        while v >= 0 and (target := follow(v, w)) < 0:
            direct(v, w, new)
            v = link[v]
        if v >= 0:
            if length[target] == length[v] + 1:
                link[new] = target
            else:
                clone = state(length[v] + 1, -1)
                word[clone], to[clone], link[clone] = word[target], to[target], link[target]
                if target in more:
                    more[clone] = dict(more[target])
                while v >= 0 and follow(v, w) == target:
                    direct(v, w, clone)
                    v = link[v]
                link[target] = link[new] = clone
        last = new
    return length, link, end


class Ordered:
    """An ordered set of many numbers in parts of bounded length, so that an insertion moves few of them."""

    PART = 2048
    __slots__ = ("least", "parts", "size")

    def __init__(self, numbers: list[int]):
        half = self.PART // 2
        self.parts = [numbers[i : i + half] for i in range(0, len(numbers), half)]
        self.least = [p[0] for p in self.parts]
        self.size = len(numbers)

    def __len__(self) -> int:
        return self.size

    def __iter__(self):
        return chain.from_iterable(self.parts)

    def add(self, e: int) -> tuple[int | None, int | None]:
        """Insert e; the neighbours to its left and right."""
        k = max(bisect_left(self.least, e) - 1, 0)
        part = self.parts[k]
        at = bisect_left(part, e)
        left = part[at - 1] if at else None
        right = part[at] if at < len(part) else self.least[k + 1] if k + 1 < len(self.least) else None
        part.insert(at, e)
        self.least[k] = part[0]
        self.size += 1
        if len(part) > self.PART:
            half = len(part) // 2
            self.parts.insert(k + 1, part[half:])
            self.least.insert(k + 1, part[half])
            del part[half:]
        return left, right


def squares(words: list[int], seen: Callable[[int, int, int], None]) -> None:
    """Call seen(last, distance, length) for each new pair of neighbouring end positions that ends a square: the words up to
    `last` and those up to last - distance agree over `length` >= distance words."""
    length, link, end = automaton(words)
    ends: list[list[int] | Ordered | None] = [[e] if e >= 0 else None for e in end]
    by_length = np.argsort(-np.array(length), kind="stable")
    for v in by_length.tolist():
        if v == 0:
            break
        up, own = link[v], ends[v]
        ends[v] = None
        if up == 0:
            continue  # the start: no agreement
        if ends[up] is None:
            ends[up] = own
            continue
        large, small, agree = ends[up], own, length[up]
        if len(small) > len(large):
            large, small = small, large
        if isinstance(large, list) and len(large) > Ordered.PART:
            large = Ordered(large)
        for e in small:
            if isinstance(large, list):
                at = bisect_left(large, e)
                left, right = large[at - 1] if at else None, large[at] if at < len(large) else None
                large.insert(at, e)
            else:
                left, right = large.add(e)
            if left is not None and e - left <= agree:
                seen(e, e - left, agree)
            if right is not None and right - e <= agree:
                seen(right, right - e, agree)
        ends[up] = large


def reach(words: np.ndarray, at: int, d: int, step: int) -> int:
    """How many places from `at` on, going by step (1 or -1), hold words equal to those d further right."""
    size, done, n = 16, 0, len(words)
    while True:
        if step > 0:
            a = at + done
            b = min(a + size, n - d)
            wrong = np.flatnonzero(words[a:b] != words[a + d : b + d]) if b > a else ()
            if len(wrong):
                return done + int(wrong[0])
            whole = b == n - d or b <= a
            done += max(0, b - a)
        else:
            b = at - done + 1
            a = max(0, b - size)
            wrong = np.flatnonzero(words[a:b] != words[a + d : b + d]) if b > a else ()
            if len(wrong):
                return done + (b - 1 - a - int(wrong[-1]))
            whole = a == 0
            done += max(0, b - a)
        if whole:
            return done
        size *= 4


def primes(n: int) -> list[int]:
    """The prime factors of n."""
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] * (n > 1)


def runs_in(words: np.ndarray, least_length: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a stretch."""
    known: dict[int, list[tuple[int, int]]] = {}
    out = []

    def seen(last: int, d: int, agree: int) -> None:
        found, left = known.setdefault(d, []), last - d  # words[left] equals words[last]
        at = bisect_left(found, (left + 1,)) - 1
        if at >= 0 and found[at][1] > left + d:
            return
        a = left - reach(words, left, d, -1) + 1
        b = left + reach(words, left, d, 1) + d
        insort(found, (a, b))
        if b - a >= max(least_length, least_exponent * d) and not any((words[a : b - d // f] == words[a + d // f : b]).all() for f in primes(d)):
            out.append((a, b - a, d))

    squares(words.tolist(), seen)
    return out


def find(words: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one text's word numbers, by start, then period."""
    out = []
    for a, b in stretches(words, window_of(least_length, least_exponent)):
        out += [(a + s, n, q) for s, n, q in runs_in(words[a:b], least_length, least_exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words lie in a run behind its first period."""
    mark = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        mark[start + period] += 1
        mark[start + length] -= 1
    return np.cumsum(mark[:-1]) > 0


def runs(docs: DataFrame, edit: Edit | None = None, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every run of every text by start, then period, and the text without repetitions, words joined by one space.

    With edit, a text's words are first replaced by those that it names."""

    def judge(chunk: Chunk, ids: list) -> tuple[list, list, list]:
        starts, ends = chunk.words
        number, bounds = chunk.numbers()[1], chunk.bounds.tolist()
        found, sizes, kept = [], [], []
        for i, doc_id in enumerate(ids):
            a, b = bounds[i], bounds[i + 1]
            order = edit(doc_id, b - a) if edit else None
            own = number[a:b] if order is None else number[a:b][order]
            got = find(own, least_length, least_exponent)
            words = chunk.text(i).split()  # on the same six characters
            if order is not None:
                words = [words[j] for j in order.tolist()]
            if got:
                gone = dropped(len(words), got)
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            found.append([{"start": s, "length": n, "period": q} for s, n, q in got])
            sizes.append(b - a)
            kept.append(b" ".join(words).decode())
        return found, sizes, kept

    def function(batch: pa.RecordBatch) -> dict:
        ids = column(batch, "doc_id").to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        for chunk in chunks(column(batch, "text")):
            for all_, part in zip(out, judge(chunk, ids[chunk.rows]), strict=True):
                all_ += part
        return {"doc_id": column(batch, "doc_id"), "n_words": out[1], "runs": out[0], "collapsed": out[2]}

    return arrow_map(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text"), function, SCHEMA)
