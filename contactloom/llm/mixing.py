"""Mixing sources to target weights by Pfair scheduling.

Each source's documents stand in a fixed pseudo-random order and are cut into blocks
of `block` characters.  Time runs in slots, one block each.  With share w of the
weights, block j = 1, 2, ... of a source is released at floor((j - 1) / w) and due at
ceil(j / w), in exact arithmetic; the earliest deadline among released blocks goes
first.  Shares sum to 1, so every deadline is met, and at any time of a phase each
source is less than one block away from its exact share, however long the phase.

When a source runs out, a new phase begins with the weights of the sources left.
The schedule is made on the driver, one number a block.  Every document gets exactly
one slot; nothing is dropped or repeated.  Only totals by source (a dimension, one
row each) come to the driver; documents are numbered in two steps by source and hash
bucket, so a source with most of the rows is spread over all tasks.

Blocks have `BLOCK` characters, or more where the whole table would make over
`MOST_BLOCKS`, which is what the driver and the tasks hold of the schedule.

A null source is a source of its own.  Null and empty texts count one character.
Repeated rows each get a place.  A null doc_id stays null.  Empty tables give empty
results.  A source without a given weight weighs 0 and comes after all others.  Only
the length of a text matters, so very long ones cost nothing more; one that is longer
than a block keeps the slot of its first character.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, column, columns_of, fresh, join_checked, materialise, partitions

#: Characters of a block.
BLOCK = 65_536
#: Blocks of a schedule at most (one number each).
MOST_BLOCKS = 1 << 22
#: Power of a source's size that is its weight where no weights are given.
ALPHA = 0.7


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportion of the weights."""
    exact = [Fraction(w) for w in weights]
    common = math.lcm(*(x.denominator for x in exact))
    return [int(x * common) for x in exact]


def pfair(weights: list[int], blocks: list[int] | None = None) -> np.ndarray:
    """Source of each slot, earliest deadline first among released blocks, until a source is asked for more than its blocks (the weights themselves if none are given: one period)."""
    total, blocks = sum(weights), weights if blocks is None else blocks
    future = [(0, i, 1) for i, w in enumerate(weights) if w]
    heapq.heapify(future)
    ready: list[tuple[int, int, int]] = []
    out: list[int] = []
    while True:
        while future and future[0][0] <= len(out):
            _, i, j = heapq.heappop(future)
            heapq.heappush(ready, (-(-j * total // weights[i]), i, j))
        _, i, j = heapq.heappop(ready)
        if j > blocks[i]:
            return np.array(out, np.int64)
        out.append(i)
        heapq.heappush(future, (j * total // weights[i], i, j + 1))


def phases(blocks: list[int], weights: list[float]) -> list[dict]:
    """Phases until every source is used up; each holds its start and, by source, its first block, the block past its last and their slots."""
    left, done, start, out = list(blocks), [0] * len(blocks), 0, []
    while any(left):
        live = [i for i, n in enumerate(left) if n and weights[i] > 0] or [i for i, n in enumerate(left) if n]
        w = [weights[i] if weights[i] > 0 else float(blocks[i]) for i in live]
        order = pfair(whole(w), [left[i] for i in live])
        phase = {"start": start, "sources": {}}
        for k, i in enumerate(live):
            slots = start + np.flatnonzero(order == k)
            phase["sources"][i] = (done[i], done[i] + len(slots), slots)
            done[i] += len(slots)
            left[i] -= len(slots)
        start += len(order)
        out.append(phase)
    return out


def row_key():
    """Hash of a row's doc_id, text and source: rows without an id, or with one id, stand each for itself."""
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")), F.col("source").cast("string"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, source, block, slot, place, phase) of every row of docs (doc_id, source, text); the mix is the order of (slot, place)."""
    return dealt(docs, weights, block, alpha).drop("h")


def dealt(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, alpha: float = ALPHA) -> DataFrame:
    """mix() with the row's key h."""
    spark = docs.sparkSession
    buckets = max(64, 2 * partitions(spark))
    size = F.greatest(F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long"), F.lit(1))
    base = materialise(docs.select("doc_id", F.col("source").cast("string"), size.alias("size"), row_key().alias("h")).withColumn("bucket", F.pmod("h", F.lit(buckets))), "mix-base")
    sums = materialise(base.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-sums")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = sorted(((r.source, int(r.n)) for r in sums.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    names = [s for s, _ in totals]
    by_name = {s: i for i, s in enumerate(names)}
    goal = [float(weights.get(s, 0.0)) for s in names] if weights is not None else [float(n) ** alpha for _, n in totals]
    block = max(block, -(-sum(n for _, n in totals) // MOST_BLOCKS))
    plan = phases([-(-n // block) for _, n in totals], goal)
    # by source, the slot of each block and the first block of each phase
    slots = {i: np.concatenate([p["sources"][i][2] for p in plan if i in p["sources"]]) for i in range(len(names))}
    began = {i: [(p["sources"][i][0], k) for k, p in enumerate(plan) if i in p["sources"] and p["sources"][i][1] > p["sources"][i][0]] for i in range(len(names))}
    own = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    offsets = materialise(sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("before")), "mix-offsets")
    placed = base.withColumn("run", F.sum("size").over(own) - F.col("size"))
    # offsets has a row for each source and bucket
    offsets = offsets.withColumn("key", F.xxhash64(F.coalesce("s", F.lit("")), F.col("s").isNull(), "b")).drop("s", "b")
    placed = placed.withColumn("key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "bucket"))
    placed = join_checked(placed, offsets, "key").select("doc_id", "source", "h", (F.col("before") + F.col("run")).alias("at"))

    def run(batch: pa.RecordBatch) -> dict:
        source = np.array([by_name[s] for s in column(batch, "source").to_pylist()], np.int64)
        at = column(batch, "at").to_numpy(zero_copy_only=False)
        number = at // block
        slot, phase = np.zeros(len(at), np.int64), np.zeros(len(at), np.int32)
        for i in np.unique(source):
            mine = np.flatnonzero(source == i)
            first, k = (np.array(v) for v in zip(*began[int(i)], strict=True))
            slot[mine] = slots[int(i)][number[mine]]
            phase[mine] = k[np.searchsorted(first, number[mine], "right") - 1]
        return {"doc_id": column(batch, "doc_id"), "source": column(batch, "source"), "block": number, "slot": slot, "place": at % block, "phase": phase, "h": column(batch, "h")}

    return arrow_map(placed, run, tail(docs) + ", source string, block long, slot long, place long, phase int, h long")


def tail(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def places(docs: DataFrame, **options) -> DataFrame:
    """(h, slot, place) of every distinct row of docs, by row_key(); repeated rows share the first place."""
    order = dealt(docs, **options).groupBy("h").agg(F.min(F.struct("slot", "place")).alias("at"))
    return materialise(order.select("h", "at.slot", "at.place"), "mix-order")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with all columns, dealt and sorted in the order of the mix."""
    key, at = fresh(docs, "mix_key", "mix_at")
    order = places(docs, **options).select(F.col("h").alias(key), F.struct("slot", "place").alias(at))
    out = join_checked(docs.withColumn(key, row_key()), order, key).repartitionByRange(partitions(docs.sparkSession), at).sortWithinPartitions(at)
    return out.select(*columns_of(docs))
