"""All-pairs and row-by-centre distances over (row_id, features).

All pairs are computed block by block: rows are stored in blocks of bounded size, a
pair of blocks is one unit of work and one numpy computation, and no pair of blocks is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import METRICS
from ..runtime import cut, prepare

#: Rows of a block at least, and of one in a large table; rows of a part at most.
BLOCK = 256
LARGE = 160
PART = 4096
#: Squared differences below this share of the squares are computed anew, as they lose digits.
NEAR = 1e-6
#: Values within this share of a limit are computed anew before they are held against it, so that they do not depend on the blocks their rows are in.
CLOSE = 1e-7


def matrix_of(features: pd.Series) -> np.ndarray:
    if len(features) and all(isinstance(f, np.ndarray) and f.dtype == np.float64 for f in features):
        return np.stack(features.to_list())
    return np.array([[np.nan if x is None else x for x in f] for f in features], float).reshape(len(features), -1)


def _levelled(x: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rows about their mean in units of their deviation, both taken to powers of two, so that little is lost; correlations stay as they are.  Missing entries are 0."""
    n = np.maximum(seen.sum(1, keepdims=True), 1)
    mean = x.sum(1, keepdims=True) / n
    sd = np.sqrt((np.where(seen, x - mean, 0.0) ** 2).sum(1, keepdims=True) / n)
    unit = np.exp2(np.floor(np.log2(np.where(sd > 0, sd, 1.0))))
    return np.where(seen, (x - np.rint(mean / unit) * unit) / unit, 0.0)


def pair_values(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """F5-F8 between all rows of a and of b; nan where nothing is comparable."""
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    x, y = np.where(ma, a, 0.0), np.where(mb, b, 0.0)
    fa, fb = ma.astype(float), mb.astype(float)
    n = (ma.astype(np.float32) @ mb.astype(np.float32).T).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric in ("euclidean", "mean_square"):
            mine, theirs = (x * x) @ fb.T, fa @ (y * y).T
            sse = mine - 2 * x @ y.T + theirs
            p, q = np.nonzero(sse < NEAR * (mine + theirs))  # what cancels is computed from the differences
            for s in range(0, len(p), 65536):
                at = p[s : s + 65536], q[s : s + 65536]
                d = np.where(ma[at[0]] & mb[at[1]], x[at[0]] - y[at[1]], 0.0)
                sse[at] = (d * d).sum(1)
            mse = sse / n
            return mse if metric == "mean_square" else np.sqrt(a.shape[1] * mse)
        if metric == "manhattan":
            out, t = np.zeros(n.shape), np.empty(n.shape)
            if not (np.isfinite(x).all() and np.isfinite(y).all()):
                for u, v in zip(a.T.copy(), b.T.copy(), strict=True):  # column by column; what is missing counts 0
                    np.abs(np.subtract(u[:, None], v, out=t), out=t)
                    out += np.fmax(t, 0.0, out=t)
                return a.shape[1] * out / n
            for u, v in zip(x.T.copy(), y.T.copy(), strict=True):  # |u - v| is twice the larger one less both; two operations a column
                out += np.maximum(u[:, None], v, out=t)
            mine, theirs = np.abs(x), np.abs(y)
            out = 2 * out - x.sum(1)[:, None] - y.sum(1) - mine @ (1 - fb).T - (1 - fa) @ theirs.T  # without entries that only one row has
            p, q = np.nonzero(out < NEAR * (mine.sum(1)[:, None] + theirs.sum(1)))  # what cancels is computed from the differences
            for s in range(0, len(p), 65536):
                at = p[s : s + 65536], q[s : s + 65536]
                out[at] = np.where(ma[at[0]] & mb[at[1]], np.abs(x[at[0]] - y[at[1]]), 0.0).sum(1)
            return a.shape[1] * out / n
        if metric == "correlation":
            x, y = _levelled(x, ma), _levelled(y, mb)
        dot, xx, yy = x @ y.T, (x * x) @ fb.T, fa @ (y * y).T
        if metric == "cosine":
            return dot / np.sqrt((xx + 1e-100) * (yy + 1e-100))
        if metric == "correlation":
            sx, sy = x @ fb.T, fa @ y.T
            cov, vx, vy = dot - sx * sy / n, xx - sx * sx / n, yy - sy * sy / n
            return np.where((vx > 1e-12) & (vy > 1e-12), cov / np.sqrt(vx * vy), np.nan)
    raise ValueError(f"unknown metric {metric}")


def values_of(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """The values of pair_values between each row of x and the same row of y, summed pair by pair: equal rows give equal values wherever they are."""
    mx, my = ~np.isnan(x), ~np.isnan(y)
    both = mx & my
    n = both.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric in ("euclidean", "mean_square"):
            d = np.where(both, x - y, 0.0)
            mse = (d * d).sum(1) / n
            return mse if metric == "mean_square" else np.sqrt(x.shape[1] * mse)
        if metric == "manhattan":
            return x.shape[1] * np.where(both, np.abs(x - y), 0.0).sum(1) / n
        if metric == "correlation":
            x, y = _levelled(np.where(mx, x, 0.0), mx), _levelled(np.where(my, y, 0.0), my)
        x, y = np.where(both, x, 0.0), np.where(both, y, 0.0)
        dot, xx, yy = (x * y).sum(1), (x * x).sum(1), (y * y).sum(1)
        if metric == "cosine":
            return dot / np.sqrt((xx + 1e-100) * (yy + 1e-100))
        if metric == "correlation":
            sx, sy = x.sum(1), y.sum(1)
            cov, vx, vy = dot - sx * sy / n, xx - sx * sx / n, yy - sy * sy / n
            return np.where((vx > 1e-12) & (vy > 1e-12), cov / np.sqrt(vx * vy), np.nan)
    raise ValueError(f"unknown metric {metric}")


def around(low: np.ndarray, high: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Intervals widened by the share CLOSE of their ends, or of 1 for metrics whose values lie about 0."""
    least = float(metric in ("cosine", "correlation"))
    with np.errstate(invalid="ignore"):
        return low - CLOSE * np.maximum(np.abs(low), least), high + CLOSE * np.maximum(np.abs(high), least)


def settled(value: np.ndarray, x: np.ndarray, y: np.ndarray, metric: str, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """pair_values(x, y) in which those near to or within the interval of their row of x are computed pair by pair; the others are as far from it as they seem."""
    first, last = around(low, high, metric)
    p, q = np.nonzero((value >= first[:, None]) & (value <= last[:, None]))
    for s in range(0, len(p), 65536):
        at = p[s : s + 65536], q[s : s + 65536]
        value[at] = values_of(x[at[0]], y[at[1]], metric)
    return value


def nearer(x: np.ndarray, y: np.ndarray, metric: str, limit: np.ndarray) -> np.ndarray:
    """Which rows of y are nearer to a row of x than its limit."""
    return settled(pair_values(x, y, metric), x, y, metric, limit, limit) < limit[:, None]


class Blocks:
    """The rows (row_id, features, more) of a table in stored blocks, for work on all pairs of rows.

    Rows are dealt to parts and packed to blocks (b, row_id, features, more as bytes), which are written once.  Every pair of parts is a
    task of a Cartesian product that reads both parts; pairs of blocks are never shuffled or stored, so disk grows as the rows do."""

    def __init__(self, rows: DataFrame, block: int = BLOCK, *more: str):
        spark = prepare(rows.sparkSession)
        self.rows = rows = cut(rows.where("row_id is not null").select("row_id", "features", *more))
        self.n = rows.count()
        size = max(block, min(LARGE, self.n // 64))
        self.parts = max(-(-self.n // PART), min(4 * spark.sparkContext.defaultParallelism, max(1, self.n // 256)))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [b for b in batches if b.num_rows]
            if own:
                table = pa.Table.from_batches(own).combine_chunks()
                ids = table["row_id"].to_numpy()
                order = np.argsort(ids, kind="stable")
                x = table["features"].chunk(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
                columns = [ids.astype(np.int64), x, *(table[c].to_numpy().astype(np.int64) for c in more)]
                starts = range(0, len(ids), size)
                number = (TaskContext.get().partitionId() << 32) + np.arange(len(starts))
                yield pa.RecordBatch.from_arrays([pa.array(number), *(pa.array([c[order[s : s + size]].tobytes() for s in starts], pa.binary()) for c in columns)], names=["b", "row_id", "features", *more])

        self.packed = cut(rows.repartition(self.parts, "row_id").mapInArrow(pack, ", ".join(["b long", *(f"{c} binary" for c in ("row_id", "features", *more))])))

    def units(self, left: DataFrame | None = None, halves: bool = False) -> DataFrame:
        """Pairs of blocks, columns with 1 and 2 behind their names: every block with every one, those of `left` if given, or each pair only once."""
        one = self.packed if left is None else left
        one, two = (d.select(*[F.col(c).alias(f"{c}{k}") for c in d.columns]) for k, d in ((1, one), (2, self.packed)))
        return one.hint("shuffle_replicate_nl").join(two, F.col("b1") <= F.col("b2") if halves else None, "inner" if halves else "cross")


def array_of(batch: pa.RecordBatch, name: str, k: int, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(batch.column(name)[k].as_buffer(), kind)


def unit_of(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row ids and features of both blocks of unit k."""
    i, j = array_of(batch, "row_id1", k), array_of(batch, "row_id2", k)
    return i, array_of(batch, "features1", k, float).reshape(len(i), -1), j, array_of(batch, "features2", k, float).reshape(len(j), -1)


def _pairs(batch: pa.RecordBatch, k: int, metric: str, strict: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, value) for i <= j (or i < j) of unit k, each pair once."""
    i, x, j, y = unit_of(batch, k)
    value = pair_values(x, y, metric)
    if batch.column("b1")[k] == batch.column("b2")[k]:
        p, q = np.nonzero(i[:, None] < j[None, :] if strict else i[:, None] <= j[None, :])
        return i[p], j[q], value[p, q]
    i, j = np.repeat(i, len(y)), np.tile(j, len(x))
    return np.minimum(i, j), np.maximum(i, j), value.ravel()


def all_pairs(rows: DataFrame, metric: str = "euclidean", strict: bool = False, block: int = BLOCK) -> DataFrame:
    """(i, j, value) for i <= j (or i < j). Every value is wanted, so the result is quadratic by nature; memory is two blocks a task."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, value = _pairs(batch, k, metric, strict)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(value, pa.float64(), mask=np.isnan(value))], names=["i", "j", "value"])

    return Blocks(rows, block).units(halves=True).mapInArrow(run, "i long, j long, value double")


def largest(rows: DataFrame, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """The largest value (value) between two different rows; tasks hand on their largest one."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")

    def run(batches):
        most = -np.inf
        for batch in batches:
            for k in range(batch.num_rows):
                most = max(most, np.nan_to_num(_pairs(batch, k, metric, True)[2], nan=-np.inf, posinf=np.inf, neginf=-np.inf).max(initial=-np.inf))
        yield pa.RecordBatch.from_arrays([pa.array([most if most > -np.inf else None], pa.float64())], names=["value"])

    return Blocks(rows, block).units(halves=True).mapInArrow(run, "value double").agg(F.max("value").alias("value"))


#: Metrics that pair_values has; others of the registry go by their column expression.
KERNELS = ("euclidean", "mean_square", "manhattan", "cosine", "correlation")


def against(rows: DataFrame, queries: DataFrame, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """(i, j, value) of every row i against every query j, both (row_id, features), by blocks; nothing is shuffled but the rows."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if metric not in KERNELS:
        other = queries.select(F.col("row_id").alias("j"), F.col("features").alias("_g"))
        return rows.select(F.col("row_id").alias("i"), "features").crossJoin(other).select("i", "j", METRICS[metric]("features", "_g").alias("value"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                j, y, i, x = unit_of(batch, k)
                value = pair_values(x, y, metric).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i))), pa.array(value, mask=np.isnan(value))], names=["i", "j", "value"])

    return Blocks(rows, block).units(Blocks(queries, block).packed).mapInArrow(run, "i long, j long, value double")


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both triangles of a symmetric matrix."""
    once, twice = F.struct("i", "j", "value"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "value")
    return pairs.select(F.inline(F.when(F.col("i") == F.col("j"), F.array(once)).otherwise(F.array(once, twice))))  # not a union, which would compute the pairs twice


def masked_pairs(rows: DataFrame, assigned: DataFrame, check: int, metric: str) -> DataFrame:
    """Pairs i < j among rows whose assignment (row_id, cid) is below `check`; unassigned counts as -1."""
    kept = rows.join(assigned, "row_id", "left").where(F.coalesce("cid", F.lit(-1)) < check).select("row_id", "features")
    return all_pairs(kept, metric, strict=True)


def to_centres(rows: DataFrame, centres: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(row_id, cid, value) of every row against every centre (cid, centre); centres are k rows."""
    return rows.join(F.broadcast(centres)).select("row_id", "cid", METRICS[metric]("features", "centre").alias("value"))


def several_metrics(rows: DataFrame, centres: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Several metrics side by side."""
    return rows.join(F.broadcast(centres)).select("row_id", "cid", *[METRICS[m]("features", "centre").alias(m) for m in metrics])


def root_weighted(rows: DataFrame, col_weights: DataFrame) -> DataFrame:
    """J9, M22 on arrays: features times the root of their column's weight, weights in column order."""
    w = col_weights.agg(F.transform(F.sort_array(F.collect_list(F.struct("col_id", "w"))), lambda x: x["w"]).alias("_w"))
    return rows.join(F.broadcast(w)).select("row_id", F.zip_with("features", "_w", lambda x, v: x * F.sqrt(v)).alias("features"))


def best_centre(values: DataFrame, above: float = 0.3) -> DataFrame:
    """The centre of the largest value above the threshold; the first centre wins ties; no match gives no row."""
    return values.where(F.col("value") > above).groupBy("row_id").agg(F.max_by("cid", F.struct("value", -F.col("cid"))).alias("cid"))


def _between(n: Column, percent: float) -> tuple[Column, Column, Column]:
    """The places (from 1) of the two of n ordered values that a percentile lies between by the estimator at place (n + 1) p, and its share of the way."""
    place = (n + 1) * percent / 100
    low = F.greatest(F.lit(1), F.least(F.floor(place), n))
    return low, F.least(low + 1, n), F.when((place < 1) | (place >= n), 0.0).otherwise(place - F.floor(place))


def _below_percentile(found: DataFrame, percent: float) -> DataFrame:
    """(i, j) of the rows (i, j, value, _n) whose value is below the percentile of the _n values of i, of which at least the lowest ones are here."""
    w = Window.partitionBy("i")
    low, high, share = _between(F.col("_n"), percent)
    ranked = found.withColumn("_k", F.row_number().over(w.orderBy("value", "j")))
    ends = ranked.withColumn("_a", F.max(F.when(F.col("_k") == low, F.col("value"))).over(w)).withColumn("_b", F.max(F.when(F.col("_k") == high, F.col("value"))).over(w))
    return ends.where(F.col("value") < F.col("_a") + share * (F.col("_b") - F.col("_a"))).select("i", "j")


def nearest(pairs: DataFrame, percent: float = 2.0) -> DataFrame:
    """J10 of given pairs: neighbours nearer than the row's percentile of distances; a row is not its own neighbour.  Sorts all values of a row; from rows, use nearest_rows."""
    both = mirrored(pairs.where("i <> j")).where("value is not null")
    return _below_percentile(both.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("i"))), percent)


#: Low bits of a distance that its bin leaves out: 8 binary digits behind the leading one remain, 256 bins to a doubling.
BIN_BITS = 44
#: Parts of the interval that a row's percentile is sought in, and rows that the first interval is guessed from.
BINS = 256
SAMPLE = 1024


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values: their bits, of which negative ones are turned round."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def value_bins(values: np.ndarray) -> np.ndarray:
    """Bins in the order of the values: their leading bits."""
    return ordered_bits(values) >> BIN_BITS


def _distances(batch: pa.RecordBatch, k: int, metric: str, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """Distances between both blocks of unit k, settled about the intervals of its first rows if given; nan from a row to itself."""
    i, x, j, y = unit_of(batch, k)
    value = pair_values(x, y, metric)
    if low is not None:
        value = settled(value, x, y, metric, low, high)
    if batch.column("b1")[k].as_py() >> 32 == batch.column("b2")[k].as_py() >> 32:  # a row has one part
        value[i[:, None] == j[None, :]] = np.nan
    return value


class _Counts:
    """Of the rows of a block: numbers of distances in all and below the row's interval, and numbers, least and greatest ones by its parts."""

    def __init__(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray):
        self.low, self.high, self.limit = low, high, limit
        self.n, self.below = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        self.size, self.least, self.most = np.zeros(len(low) * BINS, np.int64), np.full(len(low) * BINS, np.inf), np.full(len(low) * BINS, -np.inf)
        self.first = ordered_bits(low)
        span = (ordered_bits(high) - self.first).view(np.uint64)
        self.shift = np.maximum(np.frexp(span.astype(float))[1] - 8, 0).astype(np.uint64)

    def add(self, value: np.ndarray) -> None:
        self.n += (~np.isnan(value)).sum(1)
        self.below += (value < self.low[:, None]).sum(1)
        p, q = np.nonzero((value >= self.low[:, None]) & (value <= self.high[:, None]))
        v = value[p, q]
        at = p * BINS + ((ordered_bits(v) - self.first[p]).view(np.uint64) >> self.shift[p]).astype(np.int64)
        self.size += np.bincount(at, minlength=len(self.size))
        np.minimum.at(self.least, at, v)
        np.maximum.at(self.most, at, v)

    def columns(self) -> list[np.ndarray]:
        return [self.low, self.high, self.limit, self.n, self.below, self.size, self.least, self.most]


def _narrowed(low: np.ndarray, high: np.ndarray, limit: np.ndarray, n: np.ndarray, below: np.ndarray, size: np.ndarray, least: np.ndarray, most: np.ndarray, percent: float, metric: str, rough: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next intervals and limits of a block's rows.  A row is settled, with an empty interval, once both values that its percentile lies between are known.

    Rough counts, of values as pair_values has them, settle no row that has values: their intervals are widened by what such values may be off."""
    size, least, most = (z.reshape(-1, BINS) for z in (size, least, most))
    ends, rows = np.cumsum(size, 1), np.arange(len(n))
    place = (n + 1) * percent / 100
    at = np.maximum(1, np.minimum(np.floor(place).astype(np.int64), n))
    share = np.where((place < 1) | (place >= n), 0.0, place - np.floor(place))
    found = []
    for rank in (at - 1 - below, np.minimum(at + 1, n) - 1 - below):
        part = np.minimum((ends <= rank[:, None]).sum(1), BINS - 1)
        inside, own = rank - (ends[rows, part] - size[rows, part]), size[rows, part]
        first, last = least[rows, part], most[rows, part]
        here = (rank >= 0) & (rank < ends[:, -1])
        value = np.where(inside == 0, first, last)
        known = here & ((inside == 0) | (inside == own - 1) | (first == last))
        a = np.where(known, value, np.where(here, first, np.where(rank < 0, -np.inf, np.nextafter(high, np.inf))))
        b = np.where(known, value, np.where(here, last, np.where(rank < 0, np.nextafter(low, -np.inf), np.inf)))
        found.append((known, a, b))
    (known, a, b), (known2, a2, b2) = found
    open_ = low <= high
    with np.errstate(invalid="ignore"):
        between = np.where(a == a2, a, a + share * (a2 - a))
    if rough:
        low, high = around(np.minimum(a, a2), np.maximum(b, b2), metric)
        return np.where(n == 0, np.inf, low), np.where(n == 0, -np.inf, high), limit
    done = ~open_ | (n == 0) | (known & known2)
    limit = np.where(open_ & done & (n > 0), between, limit)
    return np.where(done, np.inf, np.minimum(a, a2)), np.where(done, -np.inf, np.maximum(b, b2)), limit


#: Votes that a task adds up before it hands them on.
HELD = 4_000_000


def tallied(units: Iterable[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(i, cid, n) of units (number of a block, its row ids, which rows of another block are neighbours, their labels), added up over the units of a task."""
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        if held:
            i, n = (np.concatenate(z) for z in zip(*held.values(), strict=True))
            cid = np.repeat([c for _, c in held], [len(z) for z, _ in held.values()])
            yield pa.RecordBatch.from_arrays([pa.array(z[n > 0], pa.int64()) for z in (i, cid, n)], names=["i", "cid", "n"])
            held.clear()

    size = 0
    for b, i, near, labels in units:
        cids, which = np.unique(labels, return_inverse=True)
        n = (near.astype(np.float32) @ (which[:, None] == np.arange(len(cids))).astype(np.float32)).astype(np.int64)
        for c, cid in enumerate(cids.tolist()):
            if (b, cid) in held:
                held[b, cid][1][:] += n[:, c]
            else:
                held[b, cid] = i, n[:, c].copy()
                size += len(i)
        if size > HELD:
            yield from counted()
            size = 0
    yield from counted()


class Nearest:
    """The neighbours of the rows (row_id, features) that are nearer than row i's percentile of its distances, by every one of the rules (metric, percent).

    The limits of all rows are sought by narrowing intervals, as medians are: a pass over all pairs counts each row's distances in parts of its interval,
    which end at distances that are there.  The first interval is guessed from a few rows' distances; a wrong guess costs a pass, no result.  A task takes a
    part of the rows against all rows, so it hands on a few counts of each row and never a pair.  The last pass finds the neighbours, which are not shuffled.
    Values near a limit are computed pair by pair, so a row's neighbours do not depend on the blocks.
    Missing distances do not count; a row without any has no neighbour.  Labels (row_id, cid) go with the rows, so that votes need no join with pairs."""

    def __init__(self, rows: DataFrame, *rules: tuple[str, float], block: int = BLOCK, labels: DataFrame | None = None):
        if unknown := {m for m, _ in rules} - set(METRICS):
            raise ValueError(f"unknown metric {', '.join(sorted(unknown))}")
        if labels is not None:
            rows = rows.join(labels.select("row_id", F.col("cid").alias("_cid")), "row_id", "left").select("row_id", "features", F.coalesce(F.col("_cid").cast("long"), F.lit(-1)).alias("cid"))
        self.rules, self.blocks = rules, Blocks(rows, block, *(["cid"] if labels is not None else []))
        self.left = self.blocks.packed
        for number, (metric, percent) in enumerate(rules):
            self.left = self._together(self.left, self._limits(metric, percent).select("b", F.col("limit").alias(f"limit{number}_")))

    def _together(self, left: DataFrame, state: DataFrame) -> DataFrame:
        return cut(left.join(state, "b").repartitionByRange(self.blocks.parts, "b"))

    def _per_row(self, left: DataFrame) -> DataFrame:
        """Units in which a part of `left` meets all blocks one after the other in a task."""
        return self.blocks.units(left).coalesce(max(1, left.rdd.getNumPartitions()))

    def _limits(self, metric: str, percent: float) -> DataFrame:
        """(b, limit) of all blocks."""
        if not self.blocks.n:
            return self.blocks.packed.select("b", F.col("features").alias("limit"))
        sample = matrix_of(self.blocks.rows.orderBy(F.xxhash64("row_id"), "row_id").limit(SAMPLE).select("features").toPandas().features)
        names = ["low", "high", "limit", "n", "below", "size", "least", "most"]
        kinds = [float, float, float, np.int64, np.int64, np.int64, float, float]

        def guess(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    x = array_of(batch, "features", k, float).reshape(len(array_of(batch, "row_id", k)), -1)
                    value = np.sort(pair_values(x, sample, metric), 1)
                    n, rows = (~np.isnan(value)).sum(1), np.arange(len(x))
                    p = min(max(percent / 100, 0.0), 1.0)
                    gap = 5 * np.sqrt(p * (1 - p) * n) + 3
                    first, last = np.floor(p * n - gap).astype(int), np.ceil(p * n + gap).astype(int)
                    low = np.where(first < 0, -np.inf, value[rows, np.maximum(first, 0)])
                    high = np.where(last >= n, np.inf, value[rows, np.minimum(last, value.shape[1] - 1)])
                    yield pa.RecordBatch.from_arrays([batch.column("b")[k : k + 1], *(pa.array([z.tobytes()], pa.binary()) for z in (low, high, np.full(len(x), -np.inf)))], names=["b", *names[:3]])

        def count(batches, rough):
            held, rows = {}, 0

            def counted():
                for b, c in held.items():
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), *(pa.array([z.tobytes()], pa.binary()) for z in c.columns())], names=["b", *names])
                held.clear()

            for batch in batches:
                for k in range(batch.num_rows):
                    b = batch.column("b1")[k].as_py()
                    if b not in held:
                        own = _Counts(*(array_of(batch, f"{c}1", k, float) for c in names[:3]))
                        if rows + len(own.n) > 2 * PART:  # not for each part, as a task's blocks can be of two
                            yield from counted()
                            rows = 0
                        held[b], rows = own, rows + len(own.n)
                    held[b].add(_distances(batch, k, metric, *(() if rough else (held[b].low, held[b].high))))
            yield from counted()

        def settling(rough: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
            def settle(pdf: pd.DataFrame) -> pd.DataFrame:
                parts = [[np.frombuffer(v, kind) for v in pdf[c]] for c, kind in zip(names, kinds, strict=True)]
                low, high, limit = (z[0] for z in parts[:3])
                n, below, size = (np.sum(z, 0) for z in parts[3:6])
                low, high, limit = _narrowed(low, high, limit, n, below, size, np.min(parts[6], 0), np.max(parts[7], 0), percent, metric, rough)
                return pd.DataFrame({"b": pdf.b[:1], "low": [low.tobytes()], "high": [high.tobytes()], "limit": [limit.tobytes()], "open": int((low <= high).sum())})

            return settle

        binary = lambda columns: ", ".join(f"{c} binary" for c in columns)
        state = self.blocks.packed.mapInArrow(guess, f"b long, {binary(names[:3])}")
        rough = True  # the first pass; later intervals are narrow, and what is near them is computed pair by pair
        while True:
            counts = self._per_row(self._together(self.blocks.packed, state)).mapInArrow(partial(count, rough=rough), f"b long, {binary(names)}")
            state = cut(counts.groupBy("b").applyInPandas(settling(rough), f"b long, {binary(names[:3])}, open int"))
            if not state.agg(F.sum("open")).first()[0]:
                return state
            state, rough = state.drop("open"), False

    def _near_of(self) -> Callable[[pa.RecordBatch, int], np.ndarray]:
        rules = self.rules

        def near(batch: pa.RecordBatch, k: int) -> np.ndarray:
            limit = array_of(batch, "limit0_1", k, float)
            out = _distances(batch, k, rules[0][0], limit, limit) < limit[:, None]
            for number, (metric, _) in enumerate(rules[1:], 1):  # only of those that the rules before leave
                limit, (_, x, _, y), (p, q) = array_of(batch, f"limit{number}_1", k, float), unit_of(batch, k), np.nonzero(out)
                for s in range(0, len(p), 65536):
                    at = p[s : s + 65536], q[s : s + 65536]
                    out[at] = values_of(x[at[0]], y[at[1]], metric) < limit[at[0]]
            return out

        return near

    def limits(self) -> DataFrame:
        """(row_id, x, value): each row's features as bytes and its limit by the first rule."""

        def unpack(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    ids = array_of(batch, "row_id", k)
                    x = array_of(batch, "features", k, float).reshape(len(ids), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f.tobytes() for f in x], pa.binary()), pa.array(array_of(batch, "limit0_", k, float))], names=["row_id", "x", "value"])

        return self.left.select("row_id", "features", "limit0_").mapInArrow(unpack, "row_id long, x binary, value double")

    def pairs(self) -> DataFrame:
        """(i, j): j is a neighbour of i."""
        near = self._near_of()

        def pick(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    p, q = np.nonzero(near(batch, k))
                    yield pa.RecordBatch.from_arrays([pa.array(array_of(batch, "row_id1", k)[p]), pa.array(array_of(batch, "row_id2", k)[q])], names=["i", "j"])

        return self.blocks.units(self.left).mapInArrow(pick, "i long, j long")

    def votes(self) -> DataFrame:
        """(i, cid, n): neighbours of i by label; -1 are those without one."""
        near = self._near_of()

        def tally(batches):
            return tallied((batch.column("b1")[k].as_py(), array_of(batch, "row_id1", k), near(batch, k), array_of(batch, "cid2", k)) for batch in batches for k in range(batch.num_rows))

        return self._per_row(self.left).mapInArrow(tally, "i long, cid long, n long").groupBy("i", "cid").agg(F.sum("n").alias("n"))


def nearest_rows(rows: DataFrame, metric: str = "euclidean", percent: float = 2.0, block: int = BLOCK) -> DataFrame:
    """(i, j) of neighbours nearer than row i's percentile of its distances, from rows (row_id, features), as nearest(all_pairs(rows))."""
    return Nearest(rows, (metric, percent), block=block).pairs()


def others(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Ids of the rows that are no members."""
    return cells.select("row_id").distinct().join(members.select("row_id"), "row_id", "left_anti")


def common_neighbours(one: DataFrame, two: DataFrame) -> DataFrame:
    """Neighbours by both metrics."""
    return one.intersect(two)


def unassigned_share(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of each row's neighbours without a label (row_id, cid); ascending, rows in order among equals."""
    j = neighbours.join(labels.select(F.col("row_id").alias("j"), "cid"), "j", "left")
    return unassigned_votes(j.groupBy("i", F.coalesce("cid", F.lit(-1)).alias("cid")).agg(F.count(F.lit(1)).alias("n")))


def unassigned_votes(votes: DataFrame) -> DataFrame:
    """A37, O2 from votes (i, cid, n)."""
    none = F.sum(F.when(F.col("cid") < 0, F.col("n")).otherwise(0))
    return votes.groupBy("i").agg((none / F.sum("n")).alias("share")).orderBy("share", "i")


def majority(neighbours: DataFrame, labels: DataFrame, above: float | None = None) -> DataFrame:
    """Most frequent label among neighbours, the lowest wins ties; with `above`, only if it holds more than that share."""
    j = neighbours.join(labels.select(F.col("row_id").alias("j"), "cid"), "j")
    return majority_votes(j.groupBy("i", "cid").agg(F.count(F.lit(1)).alias("n")), above)


def majority_votes(votes: DataFrame, above: float | None = None) -> DataFrame:
    """A34 from votes (i, cid, n)."""
    top = votes.where("cid >= 0").groupBy("i").agg(F.max_by(F.struct("cid", "n"), F.struct("n", -F.col("cid"))).alias("t"), F.sum("n").alias("all"))
    out = top.select("i", F.col("t.cid").alias("cid"), F.col("t.n").alias("n"), "all")
    return (out if above is None else out.where(F.col("n") > above * F.col("all"))).select("i", "cid")
