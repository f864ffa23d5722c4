"""Exact token ids of a public word-end BPE tokenizer, found once for each distinct word of a worker.

The tokenizer drops white space and never joins text across it, so a text's ids are
those of its white-space words one behind the other.  A chunk's words are told apart
by their bytes (`kernel.numbers`).  Remembered words are found by hash in sorted arrays
and count as found only if their bytes are equal, too.  Words of letters, and ASCII
words, are split by the tokenizer's own rule here and their parts looked up; every
other word goes through the tokenizer.

A worker remembers `REMEMBERED` words, about 50 bytes each, and then starts anew; long
words are never remembered.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from .kernel import CHUNK_BYTES, LOW, Chunk, blocks, chunks

#: Words, and parts of words, that a worker remembers, and bytes of the longest one that is.
REMEMBERED = 600_000
PARTS = 100_000
LONGEST = 64
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.letters = _byte_letters()
        self._parts: dict[str, list[int]] = {}
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes
        self.slot = np.zeros(0, np.int32)  # their places in what follows
        self.size, self.at, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.length, self.start, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def part(self, text: str) -> list[int]:
        ids = self._parts.get(text)
        if ids is None:
            letters = text if text.isascii() else "".join(self.letters[b] for b in text.encode())
            ids = [t.id for t in self.model.tokenize(letters)]
            if len(text) <= LONGEST:
                if len(self._parts) >= PARTS:
                    self._parts.clear()
                self._parts[text] = ids
        return ids

    def word(self, word: str) -> list[int]:
        low = word.lower()
        if low.isalpha():
            if low.isascii() or ("Σ" not in word and unicodedata.is_normalized("NFC", word)):
                return self.part(low)
        elif word.isascii() and word.isprintable() and "<|" not in word:
            return [i for p in _ASCII.findall(low) for i in self.part(p)]
        return self.whole.encode(word, add_special_tokens=False).ids

    def _find(self, c: Chunk, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Slot of each of a chunk's words whose bytes are remembered, else -1."""
        out = np.full(len(first), -1, np.int64)
        if not len(self.known) or not len(first):
            return out
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        starts, size = c.words[0][first], (c.words[1] - c.words[0])[first]
        slot = self.slot[at]
        same = (self.known[at] == hashes) & (self.size[slot] == size)
        mine, theirs = blocks(c.data), blocks(self.bytes)
        for k in range(0, LONGEST, 8):
            i = np.flatnonzero(same & (size > k))
            if not len(i):
                break
            low = LOW[np.minimum(size[i] - k, 8)]
            same[i] = ((mine[starts[i] + k] ^ theirs[self.at[slot[i]] + k]) & low) == 0
        return np.where(same, slot, out)

    def _remember(self, hashes: np.ndarray, words: list[bytes], ids: list[list[int]]) -> None:
        size, length = (np.fromiter(map(len, v), np.int32, len(v)) for v in (words, ids))
        place = len(self.size) + np.arange(len(words), dtype=np.int32)
        self.at = np.concatenate([self.at, len(self.bytes) + np.cumsum(size, dtype=np.int64) - size])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length, dtype=np.int64) - length])
        self.size, self.length = np.concatenate([self.size, size]), np.concatenate([self.length, length])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum()))])
        known, slot = np.concatenate([self.known, hashes]), np.concatenate([self.slot, place])
        order = np.argsort(known, kind="stable")  # two sorted runs
        self.known, self.slot = known[order], slot[order]

    def ids(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk and the bounds of each row's ids."""
        first, inverse = c.numbers()
        hashes = c.hashes()[first]
        if len(self.known) > REMEMBERED:
            self._clear()
        slot = self._find(c, first, hashes)
        new = np.flatnonzero(slot < 0)
        new = new[np.argsort(hashes[new], kind="stable")]
        data, starts, ends = c.data.tobytes(), *c.words
        words = [data[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        ids = [self.word(w.decode()) for w in words]
        # ids of this chunk's distinct words: remembered ones, then new ones
        fresh = np.fromiter(map(len, ids), np.int64, len(ids))
        length, start = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        old = slot >= 0
        length[old], start[old] = self.length[slot[old]], self.start[slot[old]]
        length[new], start[new] = fresh, len(self.flat) + np.cumsum(fresh) - fresh
        flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(fresh.sum()))])
        short = [k for k, w in enumerate(words) if len(w) <= LONGEST]
        if short:
            self._remember(hashes[new][short], [words[k] for k in short], [ids[k] for k in short])
        length, start = length[inverse], start[inverse]
        ends = np.cumsum(length)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)
        return flat[index], np.concatenate([[0], ends])[c.bounds]


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer of a file."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def token_ids(texts: pa.Array, path: str) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, their ids one behind the other, and the bounds of each row's ids."""
    t = tokenizer(path)
    for c in chunks(texts, 2 * CHUNK_BYTES):
        yield (c.rows, *t.ids(c))
