"""Substring dedup: repeated passages found by anchors at difference-cover positions.

Words of a document are numbered from 0.  An anchor is the hash of `ANCHOR` words
that begin at a number which lies in the difference cover D modulo `PERIOD`.  For
any two word numbers i and j some shift d < PERIOD puts both i + d and j + d into
D, so two equal windows of PERIOD + ANCHOR - 1 = 20 words hold an equal anchor at
the same shift.  Hence:

1. anchors are dealt by hash in packed blocks; those found twice or more survive;
2. every window that holds a surviving anchor is extended to its full 20 words,
   hashed with 96 bits of two separate lanes and dealt by hash; a window with an earlier equal window
   (smaller doc_id, or same document and earlier start) is a repeat;
3. the words that repeats cover are removed.

Blocks are combined before the shuffle: of equal hashes within a block only the
earliest travels, so a passage in every document sends one entry for each block.
There are as many buckets as the input has `BUCKET_BYTES` (but one a partition at
least); a task sorts its buckets and holds one at a time.  The answers (anchor places,
repeated windows) come back as runs by document, and are joined to the documents by
broadcast only below a counted bound.

Null counts as no words.  Texts under 20 words lose nothing.  Rows with the same
doc_id and text are one document and are treated alike; different texts under one
doc_id are ordered as one document by start.  Rows without a doc_id sort before all
others; each of their texts is a document of its own, ordered by the text's hash.  Other columns are passed over.  Empty tables give empty results.  Very long
texts are read whole; a worker holds about 60 times the bytes of the longest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, give_back, materialise, partitions
from .kernel import Chunk, chunks, mix, sequence_hash, window_hash

WINDOW = 20
PERIOD = 13
#: A perfect difference set modulo 13: every difference occurs.
COVER = (0, 1, 3, 9)
#: Most bytes of answers that are joined by broadcast.
ANSWER_BYTES = 64 << 20
#: Bytes of text that are combined before their blocks are dealt.
DEAL_BYTES = 1 << 20
#: Bytes of text for each bucket; a bucket's entries are held at once.
BUCKET_BYTES = 16 << 20
NO_ID = np.iinfo(np.int64).min
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text, id): id orders documents and names their answers.  A row without doc_id is a document by its text,
    and has an id made of the text's hash among the lowest quarter of numbers."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("text"), 2)))


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    return column(batch, "id").to_numpy(zero_copy_only=False)


def covered(runs: np.ndarray, n: int, ahead: int) -> np.ndarray:
    """Which of n numbers lie in [a, b + ahead) of some run [a, b)."""
    mark = np.zeros(n + 1, np.int64)
    ab = runs.reshape(-1, 2).astype(np.int64)
    np.add.at(mark, np.clip(ab[:, 0], 0, n), 1)
    np.add.at(mark, np.clip(ab[:, 1] + ahead, 0, n), -1)
    return np.cumsum(mark[:-1]) > 0


def runs_of(answer: bytes | None, h: int) -> np.ndarray | None:
    """The runs of the text with hash h in an answer, a sequence of (hash, length, runs)."""
    at = 0
    while answer is not None and at < len(answer):
        own, n = np.frombuffer(answer, np.int64, 2, at)
        if own == h:
            return np.frombuffer(answer, np.int32, int(n), at + 16)
        at += 16 + 4 * int(n)
    return None


#: Arrays of an entry in a block, by step: an anchor carries 32 bits of its hash besides the bucket (a chance
#: meeting only makes a window travel), a window 96.
ARRAYS = {"anchors": (("key", np.uint32), ("place", np.int32), ("seen", np.uint8)), "windows": (("key", np.uint64), ("more", np.uint32), ("place", np.int32))}


def pack(step: str, deal: np.ndarray, ids: np.ndarray, h: np.ndarray, entry: dict[str, np.ndarray], buckets: int) -> tuple[list, list]:
    """Blocks of entries by bucket, which the low bits of `deal` choose; a document is stored once for each run of its entries."""
    bucket = ((deal & np.uint64(0x7FFFFFFF)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((entry["place"], h, ids, bucket))
    b, ids, h = bucket[order], ids[order], h[order]
    entry = {k: entry[k][order].astype(kind) for k, kind in ARRAYS[step]}
    edge = np.flatnonzero(np.diff(b, prepend=-1))
    new = np.ones(len(b), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (h[1:] != h[:-1]) | (b[1:] != b[:-1])
    out: tuple[list, list] = ([], [])
    for s, e in zip(edge, np.append(edge[1:], len(b)), strict=True):
        at = np.flatnonzero(new[s:e])
        parts = [np.array([e - s, len(at)], np.int64), ids[s:e][at], h[s:e][at], np.diff(np.append(at, e - s)).astype(np.int32), *(v[s:e] for v in entry.values())]
        out[0].append(int(b[s]))
        out[1].append(b"".join(p.tobytes() for p in parts))
    return out


def unpack(step: str, block: bytes) -> dict[str, np.ndarray]:
    """ids, h and the entry arrays of a packed block."""
    n, docs = np.frombuffer(block, np.int64, 2)
    at, out = 16, {}
    for k, kind, count in (("ids", np.int64, docs), ("h", np.int64, docs), ("runs", np.int32, docs), *((k, kind, n) for k, kind in ARRAYS[step])):
        out[k] = np.frombuffer(block, kind, count, at)
        at += out[k].nbytes
    runs = out.pop("runs")
    return out | {"ids": np.repeat(out["ids"], runs), "h": np.repeat(out["h"], runs)}


def pack_answers(ids: np.ndarray, h: np.ndarray, place: np.ndarray, targets: int) -> tuple[list, list]:
    """Blocks of places by the part that their document's answer is put together in."""
    part = (mix(ids.view(np.uint64)) % np.uint64(targets)).astype(np.int32)
    order = np.lexsort((place, h, ids, part))
    part, ids, h, place = part[order], ids[order], h[order], place[order].astype(np.int32)
    edge = np.flatnonzero(np.diff(part, prepend=-1))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])
    out: tuple[list, list] = ([], [])
    for s, e in zip(edge, np.append(edge[1:], len(part)), strict=True):
        at = np.flatnonzero(new[s:e] | (np.arange(e - s) == 0))
        parts = (np.array([e - s, len(at)], np.int64), ids[s:e][at], h[s:e][at], np.diff(np.append(at, e - s)).astype(np.int32), place[s:e])
        out[0].append(int(part[s]))
        out[1].append(b"".join(p.tobytes() for p in parts))
    return out


def unpack_answers(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, docs = np.frombuffer(block, np.int64, 2)
    ids, h = np.frombuffer(block, np.int64, docs, 16), np.frombuffer(block, np.int64, docs, 16 + 8 * docs)
    runs = np.frombuffer(block, np.int32, docs, 16 + 16 * docs)
    return np.repeat(ids, runs), np.repeat(h, runs), np.frombuffer(block, np.int32, n, 16 + 20 * docs)


def anchors(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and word number of every anchor of a chunk."""
    length = WINDOW - PERIOD + 1
    bounds, h = c.bounds, c.hashes()
    row = np.repeat(np.arange(c.n), np.diff(bounds))
    number = np.arange(len(h)) - bounds[row]
    # a document under WINDOW words has no window
    at = np.flatnonzero(np.isin(number % PERIOD, COVER) & (number + length <= np.diff(bounds)[row]) & (np.diff(bounds)[row] >= WINDOW))
    return window_hash(h, at, length), row[at], number[at]


def _both(packed: list[tuple], local: list[tuple]) -> dict:
    """Blocks of entries by bucket, and blocks of answers that are known already by part."""
    out = [sum((p[k] for p in packed), []) for k in range(2)]
    done = [sum((p[k] for p in local), []) for k in range(2)]
    n, m = len(out[0]), len(done[0])
    return {"bucket": np.array(out[0] + done[0], np.int32), "answer": np.arange(n + m) >= n, "block": pa.array(out[1] + done[1], pa.binary())}


MIXED = "bucket int, answer boolean, block binary"


def _deal_anchors(batch: pa.RecordBatch, buckets: int) -> dict:
    ids, packed, local = ids_of(batch), [], []
    for c in chunks(column(batch, "text"), DEAL_BYTES):
        key, row, number = anchors(c)
        if not len(key):
            continue
        h = sequence_hash(c.hashes(), c.bounds).view(np.int64)
        doc = ids[c.rows][row]
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        first, twice = ~same[:-1], same[:-1] | same[1:]
        # equal ones within the block are known to survive: one of them travels, marked as seen
        o = order[twice]
        if len(o):
            local.append(pack_answers(doc[o], h[row[o]], number[o], buckets))
        o, seen = order[first], twice[first]
        packed.append(pack("anchors", key[o], doc[o], h[row[o]], {"key": key[o] >> np.uint64(32), "place": number[o], "seen": seen}, buckets))
    return _both(packed, local)


def _deal_windows(batch: pa.RecordBatch, buckets: int) -> dict:
    """Full windows that hold a surviving anchor."""
    ids, packed, local = ids_of(batch), [], []
    runs = column(batch, "runs").to_pylist()
    for c in chunks(column(batch, "text"), DEAL_BYTES):
        bounds, wh = c.bounds, c.hashes()
        h = sequence_hash(wh, bounds).view(np.int64)
        picked = []
        for i in range(c.n):
            r = runs_of(runs[c.rows.start + i], int(h[i]))
            n = int(bounds[i + 1] - bounds[i])
            if r is not None and n >= WINDOW:
                picked.append(np.flatnonzero(covered(r, n - WINDOW + 1, 0)) + bounds[i])
        at = np.concatenate(picked) if picked else np.zeros(0, np.int64)
        if not len(at):
            continue
        row = np.searchsorted(bounds, at, "right") - 1
        a = window_hash(wh, at, WINDOW)
        b = window_hash(c.hashes(1), at, WINDOW, 1) & np.uint64(0xFFFFFFFF)
        doc, number = ids[c.rows][row], at - bounds[row]
        order = np.lexsort((number, doc, b, a))
        later = _later(a[order], b[order], doc[order], number[order])
        first = np.ones(len(order), bool)
        first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        o = order[later]
        if len(o):
            local.append(pack_answers(doc[o], h[row[o]], number[o], buckets))
        # of equal windows all with the earliest key travel (there are several if a row is repeated)
        o = order[~later]
        packed.append(pack("windows", a[o], doc[o], h[row[o]], {"key": a[o], "more": b[o], "place": number[o]}, buckets))
    return _both(packed, local)


def _later(a: np.ndarray, b: np.ndarray, doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Of windows sorted by (a, b, doc, number): has it an equal window with a smaller (doc, number)?"""
    n = len(a)
    new = np.ones(n, bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return (doc != doc[head]) | (number != number[head])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[bytes]]]:
    """The blocks of each key of sorted rows, a key at a time."""
    now, held = None, []
    for batch in batches:
        for k, block in zip(column(batch, key).to_pylist(), column(batch, "block"), strict=True):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(block.as_py())
    if held:
        yield now, held


def _found(step: str, blocks: list[bytes], targets: int) -> tuple[list, list]:
    """Answers from all blocks of a bucket, as blocks by part."""
    parts = [unpack(step, x) for x in blocks]
    x = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    if step == "anchors":
        order = np.argsort(x["key"], kind="stable")
        k = x["key"][order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        hit = order[same[:-1] | same[1:]]  # an entry that is alone here was answered where it was seen twice
    else:
        order = np.lexsort((x["place"], x["ids"], x["more"], x["key"]))
        hit = order[_later(*(x[k][order] for k in ("key", "more", "ids", "place")))]
    return pack_answers(x["ids"][hit], x["h"][hit], x["place"][hit], targets) if len(hit) else ([], [])


BLOCKS = "part int, block binary"


def _gather(step: str, targets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers from the blocks of whole buckets, rows being sorted by bucket; blocks that are answers already come last and pass through."""
    fields = pa.schema([("part", pa.int32()), ("block", pa.binary())])
    entries: list[pa.RecordBatch] = []

    def rest() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = column(batch, "answer").to_numpy(zero_copy_only=False)
            if done.any():
                entries.append(batch.filter(pa.array(done)))
                batch = batch.filter(pa.array(~done))
            if batch.num_rows:
                yield batch
            if done.all():
                return

    def passed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column(batch, "bucket"), column(batch, "block")], schema=fields)

    batches = iter(batches)
    for _, blocks in _runs(rest(), "bucket"):
        part, block = _found(step, blocks, targets)
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.binary())], schema=fields)
    for batch in (*entries, *batches):
        yield passed(batch)
    give_back()


def _joined(step: str, blocks: list[bytes]) -> tuple[list, list]:
    """Documents and their answers, from all blocks of a part."""
    back = PERIOD - 1 if step == "anchors" else 0
    ids, h, place = (np.concatenate(v) for v in zip(*map(unpack_answers, blocks), strict=True))
    order = np.lexsort((place, h, ids))
    ids, h, place = ids[order], h[order], place[order]
    text = np.ones(len(ids), bool)
    text[1:] = (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])
    start = text.copy()
    start[1:] |= place[1:] - back > place[:-1] + 1
    at = np.flatnonzero(start)
    runs = np.column_stack([np.maximum(place[at] - back, 0), place[np.append(at[1:], len(place)) - 1] + 1]).astype(np.int32)
    edge = np.flatnonzero(text[at])  # first run of each text
    ends = np.append(edge[1:], len(at))
    out: dict[int, list[bytes]] = {}
    for s, e in zip(edge, ends, strict=True):
        out.setdefault(int(ids[at[s]]), []).append(np.array([h[at[s]], 2 * (e - s)], np.int64).tobytes() + runs[s:e].tobytes())
    return list(out), [b"".join(v) for v in out.values()]


def _merge(step: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One answer for each document, by the hash of its text: runs of repeated windows, or of the windows that hold a surviving anchor."""
    for _, blocks in _runs(batches, "part"):
        ids, runs = _joined(step, blocks)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, pa.binary())], schema=pa.schema([("id", pa.int64()), ("runs", pa.binary())]))
    give_back()


def _answer(dealt: DataFrame, step: str, buckets: int) -> DataFrame:
    """One row for each document with an answer."""
    n = partitions(dealt.sparkSession)
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions("answer", "bucket")
    found = dealt.mapInArrow(partial(_gather, step, buckets), BLOCKS).repartition(n, "part").sortWithinPartitions("part")
    return materialise(found.mapInArrow(partial(_merge, step), "id long, runs binary"), f"sub-{step}")


def _with_answer(docs: DataFrame, answer: DataFrame, how: str) -> DataFrame:
    """docs (doc_id, text, id) joined to its answers."""
    size = answer.agg(F.sum(F.length("runs") + 16)).first()[0] or 0
    return docs.join(F.broadcast(answer) if size <= ANSWER_BYTES else answer.hint("merge"), "id", how).select("doc_id", "text", "id", "runs")


def repeats(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Word numbers at which a repeated window starts: (id, runs), to be read by runs_of()."""
    spark, docs = docs.sparkSession, identified(docs)
    if not buckets:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(partitions(spark), size // BUCKET_BYTES)
    anchored = _answer(arrow_map(docs, lambda b: _deal_anchors(b, buckets), MIXED), "anchors", buckets)
    found = _with_answer(docs, anchored, "inner")
    return _answer(arrow_map(found, lambda b: _deal_windows(b, buckets), MIXED), "windows", buckets)


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of docs: words, removed words and the digest (and text, if asked) of what is kept."""
    joined = _with_answer(identified(docs), repeats(docs), "left")

    def run(batch: pa.RecordBatch) -> dict:
        runs, n_words, n_removed, digest, kept_text = column(batch, "runs").to_pylist(), [], [], [], []
        for c in chunks(column(batch, "text"), DEAL_BYTES):
            bounds = c.bounds
            some = any(runs[c.rows])
            h = sequence_hash(c.hashes(), bounds).view(np.int64) if some else None
            for i in range(c.n):
                n = int(bounds[i + 1] - bounds[i])
                words = c.text(i).split()  # bytes.split() cuts at the white space of the words' pattern
                r = runs_of(runs[c.rows.start + i], int(h[i])) if some else None
                if r is not None:
                    gone = covered(r, n, WINDOW - 1)
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                kept = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_text.append(kept.decode())
        return {"doc_id": column(batch, "doc_id"), "n_words": n_words, "n_removed": n_removed, "kept_sha256": digest, "kept_text": kept_text}

    return arrow_map(joined, run, SCHEMA + (", kept_text string" if with_text else ""))
