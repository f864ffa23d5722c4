"""Best-fit packing: a configuration linear program over the length histogram, then rounding.

Documents are tokenised, closed by an end id and cut into pieces of at most
`CAPACITY` tokens.  Only the histogram of piece lengths (at most CAPACITY rows)
comes to the driver.  There

* the configuration LP (how often to use each way of filling a sequence) is solved
  by multiplicative weights: a knapsack by dynamic programming finds the filling of
  the greatest weight, lengths that are covered lose weight and lengths that lag
  gain; rounds follow on what is left until little is;
* the fractions are rounded down, and the pieces left over are put by best fit, in
  groups of equal sequences, into sequences with room or into new ones.

The plan's size depends on the histogram, not on the number of pieces.  Pieces of a
length are numbered in two steps (counts by bucket, numbers within a bucket), and
each number finds its sequence and offset in the plan.

With an order of the documents (their order in stored files, which the mix decides),
pieces of a length are numbered in that order, buckets being ranges of it, and
sequences are numbered by the mean place of their tokens.  Which lengths share a
sequence stays the plan's choice.  Without one, buckets are dealt by row, so rows
without an id, or with one id or one text, spread over them like any others.

Null counts as the empty text: one piece with the end id alone.  Repeated rows are
packed each on its own.  A null doc_id stays null.  Other columns are passed over.
Empty tables give empty results.  Very long texts are tokenised whole; a worker holds
about 40 times the bytes of the longest one.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, column, join_checked, materialise, partitions
from .word_tokens import token_ids

CAPACITY = 4096
END_ID = 1
#: Rounds of the LP at most, and fillings found in each.
ROUNDS = 12
FILLINGS = 120
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Least number of buckets that number the pieces of a length; more with more shuffle partitions.
BUCKETS = 256


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stored_order(docs: DataFrame) -> Column:
    """Place of each row of a table read from Spark's files: the number of its file, then the row in it."""
    meta = docs.metadataColumn("_metadata")
    number = F.regexp_extract(meta["file_name"], r"^part-(\d+)", 1)
    return F.struct(F.when(number == "", F.lit(0)).otherwise(number).cast("long").alias("file"), meta["row_index"].alias("row"))


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, order: Column | None = None) -> DataFrame:
    """The pieces of every row of docs (doc_id, text), with the crc32 of their little-endian ids and the row's place (file, row)."""
    path = path or tokenizer_path()
    order = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row")) if order is None else order

    def run(batch: pa.RecordBatch) -> dict:
        of, piece, start, length, crc = [], [], [], [], []
        end = np.array([END_ID], np.uint32)
        for rows, ids, bounds in token_ids(column(batch, "text"), path):
            for i in range(rows.stop - rows.start):
                own = np.concatenate([ids[bounds[i] : bounds[i + 1]], end]).astype("<u4", copy=False)
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    for v, x in zip((of, piece, start, length, crc), (rows.start + i, k, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                        v.append(x)
        own_row = pa.array(of, pa.int64())
        return {**{k: column(batch, k).take(own_row) for k in ("doc_id", "file", "row")}, "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", order.alias("order")).select("doc_id", "text", "order.file", "order.row")
    return arrow_map(placed, run, PIECES + ", file long, row long")


def knapsack(sizes: np.ndarray, weight: np.ndarray, most: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """A filling (index, times) of great weight; an index occurs at most `most` times (repaired after an unbounded search)."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        n = int(np.searchsorted(sizes, c, "right"))
        v = best[c - sizes[:n]] + weight[:n]
        k = int(v.argmax())
        if v[k] > best[c - 1]:
            best[c], pick[c] = v[k], k
        else:
            best[c], pick[c] = best[c - 1], -2
    got: Counter = Counter()
    c = capacity
    while c > 0 and pick[c] != -1:
        if pick[c] == -2:
            c -= 1
            continue
        got[int(pick[c])] += 1
        c -= int(sizes[pick[c]])
    return [(k, min(t, int(most[k]))) for k, t in sorted(got.items())]


def linear_program(sizes: np.ndarray, counts: np.ndarray, capacity: int, fillings: int) -> list[tuple[float, tuple]]:
    """Fractional uses of fillings that cover the counts about evenly, by multiplicative weights."""
    need = counts.astype(float)
    total = float((need * sizes).sum()) / capacity
    covered = np.zeros(len(sizes))
    log_weight = np.zeros(len(sizes))
    step = max(1.0, total / fillings)
    uses: dict[tuple, float] = {}
    for _ in range(fillings):
        w = sizes / capacity * np.exp(np.clip(log_weight, -30, 30))
        filling = knapsack(sizes, w, np.maximum(counts, 1), capacity)
        k, t = (np.array(v) for v in zip(*filling, strict=True))
        use = min(step, float((need[k] / t).min()))
        use = max(use, 1.0)
        uses[tuple(filling)] = uses.get(tuple(filling), 0.0) + use
        covered[k] += t * use
        log_weight[k] -= np.minimum(t * use / need[k], 4.0)
        if (covered >= need).all():
            break
    return sorted(((u, f) for f, u in uses.items()), key=lambda x: (-x[0], x[1]))


def best_fit(groups: list[list], sizes: list[int], counts: list[int], capacity: int) -> None:
    """Put the pieces left over, long ones first, into the fullest sequences with room; groups of [used, times, items] are split as needed."""
    import bisect

    room: dict[int, list[int]] = {}
    for g, (used, times, _) in enumerate(groups):
        if times:
            room.setdefault(capacity - used, []).append(g)
    keys = sorted(room)
    for size, n in sorted(zip(sizes, counts, strict=True), reverse=True):
        while n:
            at = bisect.bisect_left(keys, size)
            if at < len(keys):
                free = keys[at]
                g = room[free].pop()
                if not room[free]:
                    del room[free], keys[at]
            else:
                fit = capacity // size
                groups.append([0, max(1, n // fit), {}])
                g, free = len(groups) - 1, capacity
            used, times, items = groups[g]
            fit = min(free // size, n)
            take = min(times, n // fit)
            if take < times:  # the others keep their room
                groups.append([used, times - take, dict(items)])
                if free not in room:
                    room[free] = []
                    bisect.insort(keys, free)
                room[free].append(len(groups) - 1)
            items[size] = items.get(size, 0) + fit
            groups[g] = [used + fit * size, take, items]
            n -= fit * take
            left = free - fit * size
            if left:
                if left not in room:
                    room[left] = []
                    bisect.insort(keys, left)
                room[left].append(g)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, fillings: int = FILLINGS) -> list[tuple[int, dict[int, int]]]:
    """Ways of filling a sequence with their numbers: (times, {length: pieces}); covers the histogram exactly."""
    left = {s: n for s, n in histogram.items() if n > 0}
    groups: list[list] = []
    if left.get(capacity):
        groups.append([capacity, left.pop(capacity), {capacity: 1}])
    for _ in range(rounds):
        if sum(left.values()) <= 64 or sum(s * n for s, n in left.items()) < 8 * capacity:
            break
        sizes = np.array(sorted(left))
        counts = np.array([left[s] for s in sizes])
        before = sum(left.values())
        for use, filling in linear_program(sizes, counts, capacity, fillings):
            times = min(int(use), *(left.get(int(sizes[k]), 0) // t for k, t in filling)) if filling else 0
            used = sum(int(sizes[k]) * t for k, t in filling)
            if times <= 0 or used < 0.995 * capacity:
                continue
            groups.append([used, times, {int(sizes[k]): t for k, t in filling}])
            for k, t in filling:
                left[int(sizes[k])] -= times * t
        left = {s: n for s, n in left.items() if n}
        if sum(left.values()) > 0.98 * before:
            break
    # long pieces first among what remains of the plan
    best_fit(groups, list(left), list(left.values()), capacity)
    return [(times, items) for _, times, items in groups if times]


def layout(ways: list[tuple[int, dict[int, int]]]) -> list[tuple]:
    """Rows (length, first number, past the last, first sequence, pieces a sequence, offset) in order of number."""
    rows, given, sequence = [], Counter(), 0
    for times, items in ways:
        offset = 0
        for size in sorted(items, reverse=True):
            t = items[size]
            rows.append((size, given[size], given[size] + t * times, sequence, t, offset))
            given[size] += t * times
            offset += t * size
        sequence += times
    return rows


def in_order(sequences: DataFrame) -> DataFrame:
    """(sequence_id, new_id): sequences (sequence_id, at) numbered by at, in two steps: counts by range of at, numbers within a range."""
    spark = sequences.sparkSession
    last = sequences.agg(F.max("at")).first()[0] or 0.0
    n = max(BUCKETS, 2 * partitions(spark))
    cut = sequences.withColumn("bucket", F.least(F.lit(n - 1), F.floor(F.col("at") / F.lit(last + 1.0) * n)).cast("int"))
    counts = sorted((int(r.bucket), int(r["count"])) for r in cut.groupBy("bucket").count().collect())  # n rows
    sums = np.cumsum([0] + [c for _, c in counts]).tolist()
    before = spark.createDataFrame([(b, s) for (b, _), s in zip(counts, sums, strict=False)], "bucket int, before long")
    number = F.row_number().over(Window.partitionBy("bucket").orderBy("at", "sequence_id")) - 1 + F.col("before")
    return cut.join(F.broadcast(before), "bucket").select("sequence_id", number.cast("long").alias("new_id"))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, order: Column | None = None) -> DataFrame:
    """The pieces of every row of docs with sequence_id and offset; with an order (a struct of file and row), in that order."""
    spark = docs.sparkSession
    buckets = max(BUCKETS, 2 * partitions(spark))
    parts = materialise(pieces(docs, path, capacity, order), "pack-pieces")
    if order is None:
        parts = parts.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))
        sort = ["doc_id", "piece", "ids_crc32", "row"]
    else:
        last = parts.agg(F.max("file"), F.max("row")).first()
        at = F.col("file") + F.col("row") / F.lit((last[1] or 0) + 1)  # a file's rows lie between its number and the next
        parts = parts.withColumn("at", at).withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(F.col("at") / F.lit((last[0] or 0) + 1.0) * buckets)).cast("long"))
        sort = ["at", "doc_id", "piece", "ids_crc32", "row"]
    counts = materialise(parts.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = layout(plan(histogram, capacity))
    by: dict[int, tuple[np.ndarray, ...]] = {}
    for size in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == size]
        by[size] = tuple(np.array([r[i] for r in own], np.int64) for i in range(1, 6))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(counts.select("length", "bucket", before.alias("before")), "pack-offsets")
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*sort)) - 1
    numbered = parts.withColumn("within", within)
    numbered = join_checked(numbered, offsets, ["length", "bucket"]).withColumn("number", F.col("within") + F.col("before"))
    ways = spark.sparkContext.broadcast(by)  # bounded by the histogram's fillings

    def run(batch: pa.RecordBatch) -> dict:
        length, number = (column(batch, k).to_numpy(zero_copy_only=False) for k in ("length", "number"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        edge = np.flatnonzero(np.diff(length[order], prepend=-1))
        for s, e in zip(edge, np.append(edge[1:], len(order)), strict=True):
            at = order[s:e]
            size = int(length[at[0]])
            first, _, base, times, start = ways.value[size]
            k = np.searchsorted(first, number[at], "right") - 1
            rank = number[at] - first[k]
            sequence[at] = base[k] + rank // times[k]
            offset[at] = start[k] + rank % times[k] * size
        return {**{k: column(batch, k) for k in kept}, "sequence_id": sequence, "offset": offset}

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["at"] * (order is not None)
    packed = arrow_map(numbered.select(*kept, "number"), run, PIECES + ", at double" * (order is not None) + ", sequence_id long, offset long")
    if order is None:
        return packed
    packed = materialise(packed, "pack-packed")
    mean = materialise(packed.groupBy("sequence_id").agg((F.sum(F.col("at") * F.col("length")) / F.sum("length")).alias("at")), "pack-means")
    new = materialise(in_order(mean), "pack-sequences")
    return join_checked(packed, new, "sequence_id").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("new_id").alias("sequence_id"), "offset")
