"""Numpy kernels over the UTF-8 bytes of Arrow string columns.

A column is walked in chunks of about half a megabyte.  Word and line boundaries
are found on the bytes, and every word or line gets a hash that mixes its bytes
block by block (eight at a time, each through a finaliser; long ones by BLAKE2), so
no per-word Python object is made.  Windows fold the hashes of their words in turn.
There are two lanes of 64 bits with different mixing, for 128 bits where identity
across documents counts.  Where a count depends on equality within a chunk,
`numbers` compares the bytes themselves.  Hashes depend on content alone, never on
the place in a chunk, and nothing is kept between chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
#: Spans of more bytes than this are hashed by BLAKE2, one at a time.
LONG = 64
#: Odd multipliers of the two lanes.
LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Low bytes of a block that belong to a span of so many more bytes.
LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte on, as one number each; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of the bytes of each span.  Spans of up to eight bytes and one length never collide."""
    size = ends - starts
    every = blocks(data)
    out = mix((size + 1).astype(np.uint64) * LANES[lane])
    at = np.arange(len(size))
    for k in range(0, LONG, 8):
        at = at[size[at] > k] if k else np.flatnonzero(size > 0)
        if not len(at):
            return out
        block = every[starts[at] + k] & LOW[np.minimum(size[at] - k, 8)]
        out[at] = mix((out[at] ^ block) * LANES[lane] + np.uint64(k))
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=16).digest()
        out[i] = np.frombuffer(digest, np.uint64)[lane]
    return out


def window_hash(hashes: np.ndarray, at: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of the k word hashes from each place on, folded in turn."""
    out = np.full(len(at), LANES[lane])
    shift = np.uint64(29 + 3 * lane)
    for j in range(k):
        out += hashes[at + j]
        out *= LANES[lane]
        out ^= out >> shift
    return mix(out)


def numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of a first occurrence of each distinct span, and the number of every span among these.

    Equal numbers mean equal bytes: spans of one hash are compared block by block (long ones have
    128 bits of BLAKE2 behind them), and should any differ, all are told apart by their bytes."""
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    size, model = ends - starts, first[inverse]
    same = size == size[model]
    if same.all():
        every, at = blocks(data), np.flatnonzero((model != np.arange(len(model))) & (size <= LONG))
        for k in range(0, LONG, 8):
            at = at[size[at] > k]
            if not len(at):
                break
            low = LOW[np.minimum(size[at] - k, 8)]
            if ((every[starts[at] + k] ^ every[starts[model[at]] + k]) & low).any():
                same[at[0]] = False
                break
        long = np.flatnonzero((model != np.arange(len(model))) & (size > LONG))
        if len(long) and same.all():
            one, two = (span_hash(data, starts[i], ends[i], 1) for i in (long, model[long]))
            same[long] = one == two
    if same.all():
        return first, inverse
    seen: dict[bytes, int] = {}
    first, inverse = [], np.empty(len(starts), np.int64)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        k = seen.setdefault(data[s:e].tobytes(), len(first))
        if k == len(first):
            first.append(i)
        inverse[i] = k
    return np.array(first, np.int64), inverse


class Chunk:
    """Some rows of a string column: bytes, row offsets, words and their hashes. Null counts as empty."""

    def __init__(self, rows: slice, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets
        self.n = len(offsets) - 1
        self._words: tuple[np.ndarray, np.ndarray] | None = None
        self._hashes: dict[int, np.ndarray] = {}

    def tokens(self, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs without break bytes, cut at row ends."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        inside = ~breaks[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last[:-1] &= ~inside[1:] | edge[1:n]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        if self._words is None:
            self._words = self.tokens(WHITE)
        return self._words

    @property
    def bounds(self) -> np.ndarray:
        """Row i has the words bounds[i] to bounds[i + 1]."""
        return np.searchsorted(self.words[0], self.offsets)

    def hashes(self, lane: int = 0) -> np.ndarray:
        if lane not in self._hashes:
            self._hashes[lane] = span_hash(self.data, *self.words, lane)
        return self._hashes[lane]

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words by first place, and each word's number; equal numbers are equal words."""
        return numbers(self.data, *self.words, self.hashes())

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def window_places(bounds: np.ndarray, k: int) -> np.ndarray:
    """Index of the first word of every k-word window within a row."""
    n = int(bounds[-1])
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    return np.flatnonzero(room >= k)


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every k-word window within a row."""
    at = window_places(bounds, k)
    return at, window_hash(hashes, at, k, lane)


def sequence_hash(hashes: np.ndarray, bounds: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of each row's whole word sequence: the sum of every word mixed with its number in the row."""
    length = np.diff(bounds)
    number = (np.arange(len(hashes)) - np.repeat(bounds[:-1], length)).astype(np.uint64)
    each = mix(hashes ^ mix((number + np.uint64(1)) * LANES[lane]))
    total = np.zeros(len(each) + 1, np.uint64)
    np.cumsum(each, out=total[1:])
    return mix((total[bounds[1:]] - total[bounds[:-1]]) ^ (length.astype(np.uint64) * LANES[lane]))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for every row i."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Walk a string column; a row longer than limit makes a chunk of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, off, val = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(val, np.uint8) if val is not None and val.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Chunk(slice(i, j), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
