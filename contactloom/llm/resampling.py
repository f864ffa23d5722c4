"""Importance resampling towards a target distribution, by a dictionary of distinct features.

Features are runs of one or two consecutive words; a feature's bucket is the CRC-32 of its bytes modulo
`BUCKETS`.  A bucket's gain compares its share of the target's features with its share of all features,
a document's weight is the floored mean of the gains of its features, and the documents with the highest
weight plus seeded Gumbel noise are drawn.

1. Texts are read in blocks of about `BLOCK_BYTES`.  A block gives its distinct feature strings, sorted, each with the
   documents of the block that hold it and how often: the per-document feature counts, by feature.  They are dealt by a hash of the
   string into parts; a string travels once a block, however often it occurs, so a frequent one is no hot key.
2. A part merges its strings into the dictionary: the global count of every distinct string, whose CRC-32 is taken once.
   The counts are added up by bucket, and the per-document counts are joined with the dictionary: (document, bucket, count).
3. With the bucket totals of documents and target the gains (`BUCKETS` numbers, the only thing that is broadcast)
   are joined to the per-document counts; products are added up by document in a task, then by block.
4. Documents are numbered in the order of their scores by a sort in ranges and the sizes of the ranges.

Parts are as many as the input has `PART_BYTES` of text, at least one a shuffle partition.  What a step makes for the
next is a written table in the shared folder.

Null texts count as no words: no features, weight 0.  A null doc_id draws the noise of the empty id and sorts behind
all ids of its score; repeated rows are drawn each for itself.  An empty table gives an empty result, an empty target only makes
all target counts 0.  Other columns are passed over, whatever their names.  Very long texts are a block of their own; a worker
holds about 100 times the bytes of a block.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, column, give_back, materialise, partitions
from .kernel import Chunk, mix, numbers, span_hash

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
#: Bytes of text in a block, and for each part of the dictionary.
BLOCK_BYTES = 6 << 20
PART_BYTES = 8 << 20
#: Bytes of sums that a task gathers before it hands them on.
SUM_BYTES = 32 << 20

_CODES = np.arange(256)
_UPPER = (_CODES >= ord("A")) & (_CODES <= ord("Z"))
#: Bytes in lower case (A-Z only), and which of them separate words: ASCII besides letters and digits.
LOWER = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint8)
SEPARATOR = (_CODES < 128) & ~((_CODES >= ord("0")) & (_CODES <= ord("9"))) & ~((_CODES >= ord("a")) & (_CODES <= ord("z"))) & ~_UPPER

DEALT = "part int, block long, strings binary, postings binary, header binary"
COUNTED = "block long, counts binary, header binary, totals array<bigint>"
SUMMED = "block long, sums binary, header binary"
WEIGHED = "doc_id long, n_words long, n_features long, total long, block long, place long"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of natural numbers or signed 64-bit ones, in the least bytes each, compressed."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        kind = np.min_scalar_type(int(a.max())) if len(a) and int(a.min()) >= 0 else np.dtype(np.int64)
        parts += [np.array([kind.itemsize if kind.kind == "u" else -8, len(a)], np.int64).tobytes(), a.astype(kind).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 8, []
    for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
        size, n = (int(x) for x in np.frombuffer(raw, np.int64, 2, at))
        out.append(np.frombuffer(raw, f"<u{size}" if size > 0 else "<i8", n, at + 16).astype(np.int64))
        at += 16 + n * abs(size)
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] to starts[i] + sizes[i], for each i in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Block:
    """Some texts and their features: words in the order of their bytes, and every feature as a pair of word ranks (0: no second word)."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, values = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = LOWER[np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]]] if values is not None and values.size else np.zeros(0, np.uint8)
        chunk = Chunk(slice(0, len(texts)), data, offsets - offsets[0])
        starts, ends = chunk.tokens(SEPARATOR)
        hashes = span_hash(data, starts, ends)
        first, number = numbers(data, starts, ends, hashes)
        words = [data[s:e].tobytes() for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(1, len(words) + 1)
        self.words, self.hashes = [words[i] for i in order], hashes[first[order]] if len(order) else hashes[:0]
        bounds = np.searchsorted(starts, chunk.offsets)
        self.n_words = np.diff(bounds)
        self.n_features = 2 * self.n_words - (self.n_words > 0)
        doc, word = np.repeat(np.arange(len(texts)), self.n_words), rank[number] if len(number) else np.zeros(0, np.int64)
        pairs = np.flatnonzero(doc[1:] == doc[:-1])
        key = np.concatenate([word << 32, word[pairs] << 32 | word[pairs + 1]])
        doc = np.concatenate([doc, doc[pairs]])
        order = np.argsort(key, kind="stable")  # documents stay in order within a feature
        key, doc = key[order], doc[order]
        new_key = np.append(True, key[1:] != key[:-1])[: len(key)]
        new = np.flatnonzero(new_key | np.append(True, doc[1:] != doc[:-1])[: len(key)])
        #: Postings (document, count) by feature, and where each feature's begin.
        self.doc, self.times = doc[new], np.diff(np.append(new, len(key)))
        at = np.flatnonzero(new_key[new])
        self.begin, self.size, self.key = at, np.diff(np.append(at, len(new))), key[new][at]

    def parts(self, n: int) -> np.ndarray:
        """The part of every feature, by content alone."""
        one, two = (self.key >> 32) - 1, (self.key & 0xFFFFFFFF) - 1
        h = self.hashes[one]
        return (mix(np.where(two < 0, h, h * np.uint64(0xD6E8FEB86659FD93) + mix(self.hashes[two]))) % np.uint64(n)).astype(np.int32)

    def dealt(self, n: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(part, strings, postings) of every part that has features."""
        part = self.parts(n)
        order = np.argsort(part, kind="stable")
        edge = [*np.flatnonzero(np.diff(part[order], prepend=-1)).tolist(), len(order)]
        second = [b"", *(b" " + w for w in self.words)]
        compress = zstandard.ZstdCompressor(level=3).compress
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            own = order[s:e]
            one, two = (self.key[own] >> 32) - 1, self.key[own] & 0xFFFFFFFF
            strings = b"\n".join([self.words[a] + second[b] for a, b in zip(one.tolist(), two.tolist(), strict=True)])
            at = ragged(self.begin[own], self.size[own])
            yield int(part[order[s]]), compress(strings), pack(self.size[own], self.doc[at], self.times[at])


def header_of(ids: pa.Array, block: Block) -> bytes:
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return pack(np.append(values, -1), np.asarray(ids.is_null()), block.n_words, block.n_features)


def deal(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The rows of DEALT for the texts of a partition, block by block."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("strings", pa.binary()), ("postings", pa.binary()), ("header", pa.binary())])
    partition, number = TaskContext.get().partitionId(), count()

    def rows(pending: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(pending).combine_chunks()
        ids, texts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
        block = Block(texts)
        header = header_of(ids, block)
        key = f"{partition} {next(number)} ".encode() + header  # another order of rows gives another block
        name = int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((name % n, name, None, None, header), schema, strict=True)], schema=schema)
        out, held = [], 0
        for row in block.dealt(n):
            out.append(row)
            held += len(row[1]) + len(row[2])
            if held > 1 << 20:
                yield batch(out, name)
                out, held = [], 0
        if out:
            yield batch(out, name)

    def batch(out: list[tuple[int, bytes, bytes]], name: int) -> pa.RecordBatch:
        part, strings, postings = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([name] * len(out), pa.int64()), pa.array(strings, pa.binary()), pa.array(postings, pa.binary()), pa.nulls(len(out), pa.binary())], schema=schema)

    pending: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        at = 0
        lengths = pc.fill_null(pc.binary_length(column(b, "text")), 0).to_numpy(zero_copy_only=False).tolist()
        for i, size in enumerate(lengths):
            if held and held + size > BLOCK_BYTES:
                pending.append(b.slice(at, i - at))
                yield from rows(pending)
                pending, held, at = [], 0, i
            held += size
        pending.append(b.slice(at))
    if sum(map(len, pending)):
        yield from rows(pending)
    give_back()


def count_part(table: pa.Table) -> pa.Table:
    """Of a part of the dictionary: the bucket totals, and every block's per-document counts by bucket."""
    names: dict[bytes, int] = defaultdict(count().__next__)
    headers, rows = [], []
    decompress = zstandard.ZstdDecompressor().decompress
    for block, strings, postings, header in zip(*(table.column(c) for c in ("block", "strings", "postings", "header")), strict=True):
        if header.is_valid:
            headers.append((block.as_py(), header.as_py()))
        else:
            strings = decompress(strings.as_py()).split(b"\n")
            rows.append((block.as_py(), np.fromiter(map(names.__getitem__, strings), np.int64, len(strings)), postings.as_py()))
    total = np.zeros(len(names), np.int64)
    for _, place, postings in rows:
        size, _, times = unpack(postings)
        total[place] += np.add.reduceat(times, np.cumsum(size) - size)
    bucket = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % BUCKETS  # each distinct string once
    totals = np.zeros(BUCKETS, np.int64)
    np.add.at(totals, bucket, total)
    names.clear()
    counts = []
    for _, place, postings in rows:
        size, doc, times = unpack(postings)
        order = np.argsort(doc, kind="stable")
        edge = np.flatnonzero(np.diff(doc[order], prepend=-1))
        counts.append(pack(doc[order][edge], np.diff(np.append(edge, len(doc))), np.repeat(bucket[place], size)[order], times[order]))
    n, m = len(rows), len(headers)
    return pa.table([
        pa.array([r[0] for r in rows] + [h[0] for h in headers] + [None], pa.int64()),
        pa.array([*counts, *[None] * (m + 1)], pa.binary()),
        pa.array([*[None] * n, *(h[1] for h in headers), None], pa.binary()),
        pa.array([*[None] * (n + m), totals], pa.list_(pa.int64())),
    ], schema=pa.schema([("block", pa.int64()), ("counts", pa.binary()), ("header", pa.binary()), ("totals", pa.list_(pa.int64()))]))


def counted(texts: DataFrame, doc_id: str, name: str) -> DataFrame:
    """The table of per-document counts by bucket and of bucket totals, through the dictionary."""
    spark = texts.sparkSession
    bounded_batches(spark)
    rows = texts.selectExpr(f"cast({doc_id} as long) as doc_id", "cast(text as string) as text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), math.ceil(size / PART_BYTES))
    dealt = rows.mapInArrow(lambda batches: deal(batches, n), DEALT)
    return materialise(dealt.repartitionById(n, F.col("part")).groupBy("part").applyInArrow(count_part, COUNTED), name)


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of totals for those of a task."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for row in column(batch, "totals"):
            total += row.values.to_numpy()
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["totals"])


def bucket_totals(table: DataFrame) -> np.ndarray:
    """The total of every bucket: BUCKETS numbers on the driver.  Tasks add up before rows are made of the sums."""
    added = table.where("totals is not null").select("totals").mapInArrow(add_up, "totals array<bigint>")
    rows = added.select(F.posexplode("totals").alias("bucket", "n")).where("n > 0").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.collect():
        out[r.bucket] = r.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) for every bucket, in doubles."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (float(source.sum()) + BUCKETS)) / ((s + 1) * (float(target.sum()) + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighed(table: DataFrame, gains: np.ndarray) -> DataFrame:
    """WEIGHED for every document: the products of its counts and gains added up."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            names = list(sums)
            packed = [pack(at := np.flatnonzero(sums[b]), sums[b][at]) for b in names]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary()), pa.nulls(len(names), pa.binary())], names=["block", "sums", "header"])

        for batch in batches:
            for block, counts in zip(column(batch, "block").to_pylist(), column(batch, "counts"), strict=True):
                doc, size, bucket, times = unpack(counts.as_py())
                own = np.add.reduceat(gains[bucket] * times, np.cumsum(size) - size)
                held = sums.get(block, np.zeros(0, np.int64))
                if len(held) <= doc[-1]:
                    held = sums[block] = np.concatenate([held, np.zeros(int(doc[-1]) + 1 - len(held), np.int64)])
                held[doc] += own
            if sum(a.nbytes for a in sums.values()) > SUM_BYTES:
                yield flush()
        if sums:
            yield flush()
        give_back()

    def assemble(group: pa.Table) -> pa.Table:
        header = [h.as_py() for h in group.column("header") if h.is_valid]
        if len(header) != 1:
            raise ValueError("the rows of a block came in another order when a task ran again: write the documents to a table first")
        ids, no_id, n_words, n_features = unpack(header[0])
        total = np.zeros(len(n_words), np.int64)
        for sums in group.column("sums"):
            if sums.is_valid:
                doc, own = unpack(sums.as_py())
                total[doc] += own
        return pa.table({
            "doc_id": pa.array(ids[:-1], pa.int64(), mask=no_id.astype(bool)), "n_words": n_words, "n_features": n_features, "total": total,
            "block": np.full(len(total), group.column("block")[0].as_py()), "place": np.arange(len(total)),
        })

    sums = table.where("counts is not null").select("block", "counts").mapInArrow(multiply, SUMMED)
    headers = table.where("header is not null").selectExpr("block", "cast(null as binary) as sums", "header")
    return sums.unionByName(headers).groupBy("block").applyInArrow(assemble, WEIGHED)


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """weight: the floored mean of the gains; score: weight plus Gumbel noise of the id and seed."""
    uniform = f"(cast(conv(substr(sha2(concat('{seed}:', coalesce(cast(doc_id as string), '')), 256), 1, 8), 16, 10) as double) + 0.5D) / 4294967296D"
    return weights.selectExpr(
        "*", "case when n_features = 0 then 0L else (total - pmod(total, n_features)) div n_features end as weight"
    ).selectExpr("*", f"weight + cast(floor(-1000D * ln(-ln({uniform}))) as long) as score")


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rank: 1, 2, 3... by score, then doc_id, for the drawn share of the rows with least_words words or more; null for all others.

    Ranges of the order are sorted side by side and numbered by their sizes."""
    spark = rows.sparkSession
    rows = materialise(rows.withColumn("fit", F.col("n_words") >= least_words), "scored")
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("block"), F.col("place")]
    placed = materialise(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    sizes = placed.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"), F.sum(F.col("fit").cast("long")).alias("fit")).orderBy("range").collect()
    before = np.cumsum([0, *(r.n for r in sizes)])[:-1].tolist()
    ahead = spark.createDataFrame([(r.range, b) for r, b in zip(sizes, before, strict=True)], "range long, ahead long")  # a row for each partition
    drawn = percent * sum(r.fit for r in sizes) // 100
    rank = F.col("ahead") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(ahead), "range").withColumn("rank", F.when(F.col("fit") & (rank <= drawn), rank))


def resample(docs: DataFrame, target: DataFrame, target_id: str = "doc_id", seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words): every row of docs, drawn towards the texts of target; undrawn rows have a null rank."""
    table = counted(docs, "doc_id", "features")
    gains = gains_of(bucket_totals(table), bucket_totals(counted(target, target_id, "target-features")))
    return ranked(scored(weighed(table, gains), seed), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
