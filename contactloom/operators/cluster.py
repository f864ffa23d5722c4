"""Missing-aware k-means and k-medians on (row_id, features), restarts side by side.

Each iteration is one pass over the rows: every task assigns its rows to the centres
(restarts x k arrays, sent along) and gives partial sums, which Spark adds up; only
the new centres come to the driver.  First centres are drawn over all rows in a few passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut, prepare, side_by_side
from .metrics import PART, Blocks, _levelled, array_of, matrix_of, pair_values, unit_of

#: Draws of first candidates, and candidates of a draw for each centre.
TURNS = 3
OVER = 2
#: Parts of an interval that medians are sought in, and numbers that a task may hold for it.
BINS = 16
NUMBERS = 8_000_000
#: Edges of a column's parts, rows that they are guessed from, and values that are gathered in a pass.
EDGES = 128
SAMPLE = 1024
GATHERED = 4_000_000
MAX_ITERATIONS = 200
RESTARTS = 20
#: Runs that may fail before the search for valid ones ends.
ATTEMPTS = 200
MIN_CLUSTER = 5
PENALTY = 3.4028234663852886e38


def _distance(kind: str) -> str:
    return "euclidean" if kind == "means" else "manhattan"


def _uniform(ids: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in (0, 1) for each row id, the same wherever the row is."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + turn * 7919 & (1 << 64) - 1)
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _gaps(x: np.ndarray, centres: np.ndarray, kind: str) -> np.ndarray:
    """Squared distance of every row to its nearest centre; one that cannot be compared counts 0."""
    return np.nan_to_num(pair_values(x, centres, _distance(kind)), nan=0.0).min(1) ** 2


def _drawn(rows: DataFrame, found: list[np.ndarray], n: int, seeds: list[int], turn: int, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every restart (ids, features) of n rows drawn without repetition, with weights by their squared distance to what the restart has found.

    A row's key is ln(u) / weight with a uniform u of its own, and the n largest keys are drawn: a task hands on its n best rows, the
    best of these are the draw.  So one pass does, and at most n rows a restart reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list] = [[] for _ in seeds]
        for pdf in batches:
            x, ids = matrix_of(pdf.features), pdf.row_id.to_numpy()
            for i, seed in enumerate(seeds if len(x) else []):
                weight = _gaps(x, found[i], kind) if len(found[i]) else np.ones(len(x))
                key = np.log(_uniform(ids, seed, turn)) / np.maximum(weight, 1e-100)
                best[i] = sorted([*best[i], *((-key[j], int(ids[j]), x[j]) for j in np.argsort(-key, kind="stable")[:n])], key=lambda r: r[:2])[:n]
        yield pd.DataFrame([(i, key, row, v.tolist()) for i, own in enumerate(best) for key, row, v in own], columns=["restart", "key", "row_id", "features"])

    kept = rows.select("row_id", "features").mapInPandas(run, "restart int, key double, row_id long, features array<double>")
    place = F.row_number().over(Window.partitionBy("restart").orderBy("key", "row_id"))
    got = kept.withColumn("_p", place).where(F.col("_p") <= n).orderBy("restart", "_p").toPandas()
    width = found[0].shape[1] if len(found[0]) else len(got.features.iloc[0]) if len(got) else 0
    out = []
    for i in range(len(seeds)):
        own = got[got.restart == i]
        out.append((own.row_id.to_numpy(np.int64), np.array([np.array(f, float) for f in own.features]).reshape(len(own), width)))
    return out


def first_centres(rows: DataFrame, k: int, seeds: list[int], kind: str = "means") -> np.ndarray:
    """Spread-out first centres of every restart, by oversampling over all rows.

    One row is drawn, then `TURNS` times `OVER` * k rows with weights by squared distance to those drawn before.  Every row gives its
    weight to the nearest of these candidates, and k of them are picked one after another by weight and squared distance.  Candidates (at most
    1 + TURNS * OVER * k rows a restart) are all that the driver holds; missing entries of a centre take the mean of the candidates'."""
    prepare(rows.sparkSession)
    known = _drawn(rows, [np.zeros((0, 0))] * len(seeds), 1, seeds, 0, kind)
    for turn in range(1, TURNS + 1):
        new = _drawn(rows, [x for _, x in known], OVER * k, seeds, turn, kind)
        for i, ((ids, x), (more, y)) in enumerate(zip(known, new, strict=True)):
            fresh = ~np.isin(more, ids)
            known[i] = np.concatenate([ids, more[fresh]]), np.concatenate([x, y[fresh]])
    if min(len(ids) for ids, _ in known) < k:
        raise ValueError(f"{min(len(ids) for ids, _ in known)} rows cannot give {k} clusters")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(len(ids)) for ids, _ in known]
        for pdf in batches:
            x = matrix_of(pdf.features)
            for i, (_, candidates) in enumerate(known if len(x) else []):
                d = pair_values(x, candidates, _distance(kind))
                np.add.at(total[i], np.where(np.isnan(d), np.inf, d).argmin(1), 1)
        yield pd.DataFrame([(i, c, n) for i, own in enumerate(total) for c, n in enumerate(own.tolist()) if n], columns=["restart", "c", "n"])

    weights = [np.zeros(len(ids)) for ids, _ in known]
    for r in rows.select("features").mapInPandas(run, "restart int, c int, n double").groupBy("restart", "c").agg(F.sum("n").alias("n")).collect():
        weights[r.restart][r.c] = r.n
    out = []
    for seed, (_, x), weight in zip(seeds, known, weights, strict=True):
        rng, free = np.random.default_rng(seed), np.ones(len(x), bool)
        d, chosen = np.ones(len(x)), []
        while len(chosen) < k:
            p = np.where(free, weight * d, 0)
            p = p if p.sum() > 0 else free.astype(float)
            chosen.append(int(rng.choice(len(x), p=p / p.sum())))
            free[chosen[-1]] = False
            gap = _gaps(x, x[chosen[-1:]], kind)
            d = gap if len(chosen) == 1 else np.minimum(d, gap)
        seen = ~np.isnan(x)
        fill = np.where(seen, x, 0).sum(0) / np.maximum(seen.sum(0), 1)
        out.append(np.where(np.isnan(x[chosen]), fill, x[chosen]))
    return np.array(out)


def _closest(x: np.ndarray, centres: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    d = pair_values(x, centres, _distance(kind))
    d = np.where(np.isnan(d), np.inf, d)
    return d.argmin(1), d.min(1)


def _closest_medians(x: np.ndarray, centres: np.ndarray) -> Iterator[np.ndarray]:
    """The closest centre of every row in each restart; restarts go together, as their distances are made column by column."""
    r, k, w = centres.shape
    some = max(1, 64 // k)
    for s in range(0, r, some):
        d = pair_values(x, centres[s : s + some].reshape(-1, w), _distance("medians")).reshape(len(x), -1, k)
        yield from np.where(np.isnan(d), np.inf, d).argmin(2).T


def _passes(rows: DataFrame, centres: np.ndarray, kind: str) -> DataFrame:
    """Partial sums and counts (restart, cid, s, n), arrays as bytes, of one iteration of k-means."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, k, w = centres.shape
        s, n, size = np.zeros((r, k, w)), np.zeros((r, k, w)), np.zeros((r, k))
        for pdf in batches:
            x = matrix_of(pdf.features)
            if not len(x):
                continue
            seen = (~np.isnan(x)).astype(float)
            value = np.where(seen > 0, x, 0.0)
            for i in range(r):
                cid, _ = _closest(x, centres[i], kind)
                own = (np.arange(k)[:, None] == cid).astype(float)
                s[i] += own @ value
                n[i] += own @ seen
                size[i] += own.sum(1)
        yield pd.DataFrame([(i, c, s[i, c].tobytes(), n[i, c].tobytes()) for i in range(r) for c in range(k) if size[i, c]], columns=["restart", "cid", "s", "n"])

    return rows.select("features").mapInPandas(run, "restart int, cid int, s binary, n binary")


def _step_means(rows: DataFrame, centres: np.ndarray, tasks: int) -> np.ndarray:
    """Sums of tasks are few numbers and are added up by the driver; where they are more than NUMBERS, Spark adds them up first."""
    new, parts = centres.copy(), _passes(rows, centres, "means")
    if tasks * centres.size * 2 > NUMBERS:

        def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(*key, *(np.sum([np.frombuffer(z) for z in pdf[c]], 0).tobytes() for c in ("s", "n")))], columns=["restart", "cid", "s", "n"])

        parts = parts.groupBy("restart", "cid").applyInPandas(add, parts.schema)
    s, n = np.zeros(centres.shape), np.zeros(centres.shape)
    for i, c, *sums in zip(*parts.toArrow().to_pydict().values(), strict=True):
        for total, own in zip((s, n), sums, strict=True):
            total[i, c] += np.frombuffer(own)
    new[n > 0] = s[n > 0] / n[n > 0]
    return new


def _counts(rows: DataFrame, centres: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of values, and least and greatest ones, in BINS equal parts of the intervals [low, high] of (restart, cid, column, rank)."""
    r, k, w = centres.shape
    shape = (k, w, 2, BINS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = r, k * w * 2 * BINS
        n, least, most = np.zeros(flat), np.full(flat, np.inf), np.full(flat, -np.inf)
        for pdf in batches:
            x = matrix_of(pdf.features)
            for i, cid in enumerate(_closest_medians(x, centres) if len(x) else ()):
                for rank in (0, 1):
                    a, b = low[i, cid, :, rank], high[i, cid, :, rank]
                    row, j = np.nonzero((x >= a) & (x <= b))
                    v, a, b = x[row, j], a[row, j], b[row, j]
                    part = np.minimum((np.divide(v - a, b - a, out=np.zeros(len(v)), where=b > a) * BINS).astype(int), BINS - 1)
                    at = ((cid[row] * w + j) * 2 + rank) * BINS + part
                    n[i] += np.bincount(at, minlength=n.shape[1])
                    np.minimum.at(least[i], at, v)
                    np.maximum.at(most[i], at, v)
        own = lambda z, i, c: z[i].reshape(k, -1)[c]
        out = [(i, c, *(own(z, i, c) for z in (n, least, most))) for i in range(r) for c in range(k) if own(n, i, c).any()]
        yield pd.DataFrame(out, columns=["restart", "cid", "n", "least", "most"])

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n, least, most = (np.array(part[c].tolist()) for c in ("n", "least", "most"))
        return pd.DataFrame([(*key, n.sum(0), least.min(0), most.max(0))], columns=["restart", "cid", "n", "least", "most"])

    kind = "restart int, cid int, n array<double>, least array<double>, most array<double>"
    got = rows.select("features").mapInPandas(run, kind).groupBy("restart", "cid").applyInPandas(add, kind).toPandas()
    n, least, most = np.zeros((r, *shape)), np.full((r, *shape), np.inf), np.full((r, *shape), -np.inf)
    for i, c, *parts in got.itertuples(index=False):
        n[i, c], least[i, c], most[i, c] = (np.asarray(p, float).reshape(shape[1:]) for p in parts)
    return n, least, most


def _parted(rows: DataFrame, centres: np.ndarray, edges: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of (restart, cid, column): the number of values, the two middle ones (nan unless their parts are from `first` to `last`), their parts, ranks within
    these parts, and the numbers of values in the parts of both and in those beside them as well.

    Parts lie between the edges of a column.  Tasks count values by part and hand on those in parts from `first` to `last`; those of a restart are put in order together."""
    r, k, w = centres.shape
    size = len(edges) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, got = np.zeros((r, k * w * size), np.int32), [[(np.zeros(0, np.int32), np.zeros(0))] for _ in range(r)]
        for pdf in batches:
            x = matrix_of(pdf.features)
            if not len(x):
                continue
            seen = ~np.isnan(x)
            part = np.stack([np.searchsorted(e, v, "right") for e, v in zip(edges.T, x.T, strict=True)], 1)
            for i, cid in enumerate(_closest_medians(x, centres)):
                n[i] += np.bincount(((cid[:, None] * w + np.arange(w)) * size + part)[seen], minlength=n.shape[1]).astype(np.int32)
                row, j = np.nonzero((part >= first[i, cid]) & (part <= last[i, cid]) & seen)
                got[i].append(((cid[row] * w + j).astype(np.int32), x[row, j]))
        columns = ([np.concatenate([g[z] for g in own]).tobytes() for own in got] for z in (0, 1))
        yield pd.DataFrame(dict(zip(("restart", "n", "at", "v"), (range(r), [z.tobytes() for z in n], *columns), strict=True)))

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = first[key[0]], last[key[0]]
        n = np.sum([np.frombuffer(z, np.int32) for z in pdf.n], 0, dtype=np.int64).reshape(k, w, size)
        at, v = np.frombuffer(b"".join(pdf["at"]), np.int32), np.frombuffer(b"".join(pdf.v))
        order = np.lexsort((v, at))
        start, v = np.searchsorted(at[order], np.arange(k * w)).reshape(k, w, 1), v[order]
        ends = np.concatenate([np.zeros((k, w, 1), np.int64), np.cumsum(n, -1)], -1)
        before = lambda z: np.take_along_axis(ends, np.clip(z, 0, size), -1)
        total = ends[..., -1]
        rank = np.stack([(total - 1) // 2, total // 2], -1)
        part = np.minimum((ends[..., None, 1:] <= rank[..., None]).sum(-1), size - 1)
        here = (total > 0)[..., None] & (part >= a[..., None]) & (part <= b[..., None])
        found = np.full(rank.shape, np.nan)
        found[here] = v[(start + rank - before(a[..., None]))[here]]
        low, high = part[..., :1], part[..., 1:]
        own, wide = (before(high + 1) - before(low))[..., 0], (before(high + 2) - before(low - 1))[..., 0]
        out = total, found, part, rank - before(part), own, wide
        return pd.DataFrame({"restart": [key[0]], **{name: [np.ascontiguousarray(z).tobytes()] for name, z in zip(names, out, strict=True)}})

    names = ("total", "found", "part", "rank", "own", "wide")
    counted = rows.select("features").mapInPandas(run, "restart int, n binary, at binary, v binary")
    got = counted.groupBy("restart").applyInPandas(settle, "restart int, " + ", ".join(f"{c} binary" for c in names)).toArrow().sort_by("restart")
    shape = (len(got), k, w, -1)
    total, found, part, rank, own, wide = (np.frombuffer(b"".join(v.as_py() for v in got[c]), float if c == "found" else np.int64).reshape(shape) for c in names)
    return total[..., 0], found.copy(), part, rank, own[..., 0], wide[..., 0]


def _narrowed(rows: DataFrame, centres: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Values by restart, cluster and column at two ranks among those from `low` to `high`, nan where not open.

    A pass counts the values of each interval in parts and gives the ends of each part, so the next interval begins and ends with values
    that are there; it ends where a part holds two values or one repeated value.  No cell is shuffled."""
    found, open_ = np.full(rank.shape, np.nan), open_.copy()
    while open_.any():
        n, least, most = _counts(rows, centres, np.where(open_, low, np.inf), high)
        ends = np.cumsum(n, -1)
        part = np.minimum((ends <= rank[..., None]).sum(-1), BINS - 1)[..., None]
        pick = lambda z: np.take_along_axis(z, part, -1)[..., 0]
        size, first, last = pick(n), pick(least), pick(most)
        rank = np.where(open_, rank - (pick(ends) - size), rank)
        done = open_ & ((size <= 2) | (first == last))
        found[done] = np.where(rank == 0, first, last)[done]
        open_ &= ~done
        low, high = np.where(open_, first, low), np.where(open_, last, high)
    return found


def _medians(rows: DataFrame, centres: np.ndarray, edges: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Exact medians by restart, cluster and column, and in `near` the parts about them.

    One pass does where the middle values are in the parts `near` that are given, as when centres move little.  Others are gathered in a second pass,
    or, if their parts hold too many values, sought by narrowing."""
    total, found, part, rank, own, wide = _parted(rows, centres, edges, *near)
    near[:] = (part[..., 0] - 1, part[..., 1] + 1) if wide.sum() <= GATHERED else (np.ones_like(total), np.zeros_like(total))
    open_ = np.isnan(found) & (total > 0)[..., None]
    some = open_.any((1, 2, 3))
    if some.any():
        wanted = open_[some].any(-1)
        if own[some][wanted].sum() <= GATHERED:
            again = _parted(rows, centres[some], edges, np.where(wanted, part[some][..., 0], 1), np.where(wanted, part[some][..., 1], 0))[1]
        else:
            column = np.arange(edges.shape[1])[:, None]
            low = edges[np.maximum(part[some] - 1, 0), column]
            high = np.where(part[some] < len(edges), np.nextafter(edges[np.minimum(part[some], len(edges) - 1), column], -np.inf), edges[-1][:, None])
            again = _narrowed(rows, centres[some], low, high, rank[some], open_[some])
        found[some] = np.where(open_[some], again, found[some])
    middle = found.mean(-1)
    return np.where(np.isnan(middle), centres, middle)


def _bounds(rows: DataFrame, width: int) -> np.ndarray:
    """Least and greatest value of every column; an interval without values where there are none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for pdf in batches:
            x = matrix_of(pdf.features)
            if len(x):
                low, high = np.fmin(low, np.fmin.reduce(x)), np.fmax(high, np.fmax.reduce(x))
        yield pd.DataFrame({"j": np.arange(width), "low": low, "high": high})

    out = np.stack([np.full(width, np.inf), np.full(width, -np.inf)])
    for r in rows.select("features").mapInPandas(run, "j int, low double, high double").groupBy("j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        out[:, r.j] = r.low, r.high
    return out


def _edges(rows: DataFrame, bounds: np.ndarray, k: int) -> np.ndarray:
    """Edges of parts (edge x column) from the least to the greatest value; those between are quantiles of a few rows, so that parts hold about as many values each.  The medians do not depend on them."""
    sample = matrix_of(rows.orderBy(F.xxhash64("row_id"), "row_id").limit(SAMPLE).select("features").toPandas().features)
    width = bounds.shape[1]
    number = min(EDGES, max(BINS, NUMBERS // max(1, k * width)))
    some = np.sort(sample, 0)  # missing entries come last
    n = (~np.isnan(some)).sum(0)
    place = np.minimum((np.linspace(0, 1, number)[1:-1, None] * n).astype(int), np.maximum(n - 1, 0))
    middle = np.where(n > 0, some[place, np.arange(width)], bounds[0])
    return np.concatenate([bounds[:1], middle, bounds[1:]])


def _step_medians(rows: DataFrame, centres: np.ndarray, edges: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
    """Edges begin with the least and end with the greatest values.  Restarts go together as long as a task's counts stay within NUMBERS."""
    r, k, w = centres.shape
    if near is None:
        near = _nowhere(r, k, w)
    some = max(1, NUMBERS // max(1, k * w * max(len(edges) + 1, 6 * BINS)))
    return np.concatenate([_medians(rows, centres[i : i + some], edges, near[:, i : i + some]) for i in range(0, r, some)])


def _nowhere(*shape: int) -> np.ndarray:
    """No parts, from 1 to 0."""
    return np.stack([np.ones(shape, np.int64), np.zeros(shape, np.int64)])


def assign(rows: DataFrame, centres: np.ndarray, kind: str = "means") -> DataFrame:
    """(restart, row_id, cid, distance) of every row in every restart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = matrix_of(pdf.features)
            for i in range(len(centres)):
                cid, d = _closest(x, centres[i], kind) if len(x) else (np.zeros(0, int), np.zeros(0))
                yield pd.DataFrame({"restart": i, "row_id": pdf.row_id, "cid": cid, "distance": d})

    return rows.select("row_id", "features").mapInPandas(run, "restart int, row_id long, cid int, distance double")


#: Called after every iteration with its number and the farthest move of a coordinate in each restart.
Listener = Callable[[int, np.ndarray], None]


def fit(rows: DataFrame, k: int, kind: str = "means", seeds: list[int] | None = None, iterations: int = MAX_ITERATIONS, listener: Listener | None = None) -> np.ndarray:
    """M1, M2: centres (restarts x k x width) after Lloyd iterations until nothing moves."""
    centres, tasks = first_centres(rows, k, seeds or [0], kind), rows.rdd.getNumPartitions()
    if kind == "medians":
        edges, near = _edges(rows, _bounds(rows, centres.shape[2]), k), _nowhere(*centres.shape)
    live = np.ones(len(centres), bool)  # a restart whose centres did not move stays as it is
    for number in range(iterations):
        new = centres.copy()
        if kind == "means":
            new[live] = _step_means(rows, centres[live], tasks)
        else:
            own = near[:, live]
            new[live] = _step_medians(rows, centres[live], edges, own)
            near[:, live] = own  # where the next step looks first
        moved = np.abs(new - centres).reshape(len(new), -1).max(1, initial=0.0)
        centres = new
        if listener is not None:
            listener(number, moved)
        live = moved >= 1e-9
        if not live.any():
            break
    return centres


def within(assigned: DataFrame, k: int) -> DataFrame:
    """(restart, wcss, n_clusters): distances over k, with a penalty for each cluster under five members."""
    g = assigned.groupBy("restart", "cid").agg(F.sum("distance").alias("d"), F.count(F.lit(1)).alias("n"))
    return g.groupBy("restart").agg((F.sum("d") / k + F.sum(F.when(F.col("n") < MIN_CLUSTER, PENALTY).otherwise(0.0))).alias("wcss"), F.count(F.lit(1)).alias("n_clusters"))


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows stored once, dealt to all cores: passes are many, and a small file would be one task's."""
    rows = cut(rows.select("row_id", "features"))
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return cut(rows.repartition(max(-(-n // 65536), min(cores, max(1, n // 256))), "row_id"))


def best_of(rows: DataFrame, k: int, kind: str = "means", restarts: int = RESTARTS, seed: int = 0, iterations: int = MAX_ITERATIONS) -> tuple[np.ndarray, DataFrame]:
    """M3: of `restarts` valid runs (k clusters, finite WCSS) the lowest WCSS; gives up after ATTEMPTS runs."""
    rows = _dealt(rows)
    valid, best, tried = 0, None, 0
    while valid < restarts and tried < ATTEMPTS:
        n = min(restarts - valid, ATTEMPTS - tried)
        centres = fit(rows, k, kind, [seed + tried + i for i in range(n)], iterations)
        tried += n
        for r in within(assign(rows, centres, kind), k).where((F.col("n_clusters") == k) & (F.col("wcss") < PENALTY)).orderBy("wcss", "restart").collect():
            valid += 1
            if best is None or r.wcss < best[0]:
                best = (r.wcss, centres[r.restart])
    if best is None:
        raise ValueError(f"no valid clustering with {k} clusters in {tried} runs")
    members = assign(rows, best[1][None], kind).select("row_id", "cid")
    return best[1], ordered(members)


def sweep(rows: DataFrame, first: int, past: int, kinds: tuple[str, ...] = ("means", "medians"), **options) -> Iterator[tuple[int, str, DataFrame]]:
    """M4: (k, kind, members) for k from first to past - 1; runs go side by side."""
    rows = _dealt(rows)
    runs = [(k, kind) for k in range(first, past) for kind in kinds]
    members = side_by_side(rows.sparkSession, lambda run: best_of(rows, *run, **options)[1], runs)
    yield from ((*run, m) for run, m in zip(runs, members, strict=True))


def ordered(members: DataFrame) -> DataFrame:
    """M5, M6: cluster ids by size, large first, then by first member; (row_id, cid)."""
    size = members.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("f"))
    rank = size.select("cid", (F.row_number().over(Window.orderBy(F.desc("n"), "f")) - 1).cast("int").alias("_new"))
    return members.join(F.broadcast(rank), "cid").select("row_id", F.col("_new").alias("cid"))


def large_clusters(members: DataFrame, least: int = 10) -> DataFrame:
    """Members of clusters with more than `least` rows."""
    size = members.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("cid")
    return members.join(F.broadcast(size), "cid", "left_semi").select("row_id", "cid")


def mean_centres(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Mean of the present values by cluster and column (NULL if there are none), and the cluster's size."""
    size = members.groupBy("cid").agg(F.count(F.lit(1)).alias("weight"))
    return cells.join(members, "row_id").groupBy("cid", "col_id").agg(F.avg("v").alias("v")).join(F.broadcast(size), "cid").select("cid", "col_id", "v", "weight")


def quick_centres(rows: DataFrame, cells: DataFrame, k: int, seed: int = 93824, least: int = 10) -> DataFrame:
    """M7: k-means of 20 iterations, small clusters dropped, means of the rest."""
    members = ordered(assign(rows, fit(rows, k, "means", [seed], 20)).select("row_id", "cid"))
    return mean_centres(cells, large_clusters(members, least))


def to_track(members: DataFrame, intervals: DataFrame, one_based: bool = True) -> DataFrame:
    """Clusters on the intervals (row_id, chr_idx, x1, x2) of their rows."""
    cid = (F.col("cid") + (1 if one_based else 0)).alias("cluster_id")
    return members.where("cid >= 0").join(intervals, "row_id").select("chr_idx", "x1", "x2", cid)


def values_on_intervals(values: DataFrame, intervals: DataFrame) -> DataFrame:
    """(row_id, value) on intervals."""
    return values.join(intervals, "row_id").select("chr_idx", "x1", "x2", "value")


def centres_frame(spark: SparkSession, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cid int, centre array<double>")


def centre_pairs(centres: DataFrame, strict: bool = True) -> DataFrame:
    """K against k rows."""
    a, b = centres.select(F.col("cid").alias("c1"), F.col("centre").alias("a")), centres.select(F.col("cid").alias("c2"), F.col("centre").alias("b"))
    return a.join(F.broadcast(b), F.col("c1") < F.col("c2") if strict else F.col("c1") <= F.col("c2"))


def similar_entries(centres: DataFrame, limit: float = 0.05) -> DataFrame:
    """For each pair of centres the entries with squared difference over |expected| below the limit."""
    hit = lambda p: F.when(F.try_divide((p["x"] - p["y"]) * (p["x"] - p["y"]), F.abs(p["y"])) < limit, 1).otherwise(0)
    n = F.aggregate(F.zip_with("a", "b", lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.lit(0), lambda s, p: s + hit(p))
    return centre_pairs(centres).select("c1", "c2", n.alias("n_similar"))


def chi_square(centres: DataFrame) -> DataFrame:
    """Pearson statistic of each ordered pair of centres, a centre with itself included, over the first half of the vector, observed rounded, expected rescaled to its total; p by the regularised gamma function."""
    import math

    def upper_gamma(a: float, x: float) -> float:
        """Regularised upper incomplete gamma function, by series or continued fraction."""
        if x <= 0 or a <= 0:
            return 1.0
        front = math.exp(-x + a * math.log(x) - math.lgamma(a))
        if x < a + 1:
            term = total = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-15:
                n += 1
                term *= x / n
                total += term
            return 1 - front * total
        b, c = x + 1 - a, 1e300
        d = 1 / b
        h = d
        for i in range(1, 500):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return front * h

    def run(batches):
        for pdf in batches:
            out = []
            for c1, a, c2, b in zip(pdf.c1, pdf.a, pdf.c2, pdf.b, strict=True):
                half = len(a) // 2
                o, e = np.rint(np.array(a[:half], float)), np.array(b[:half], float)
                ok = ~np.isnan(o) & ~np.isnan(e) & (e > 0) & (o >= 0)
                o, e = o[ok], e[ok]
                if len(e) < 2 or o.sum() <= 0:
                    out.append((c1, c2, None, None))
                    continue
                e = e * o.sum() / e.sum()
                stat = float(((o - e) ** 2 / e).sum())
                out.append((c1, c2, stat, upper_gamma((len(e) - 1) / 2, stat / 2)))
            yield pd.DataFrame(out, columns=["c1", "c2", "statistic", "p"])

    pairs = centre_pairs(centres, strict=False)
    both = pairs.union(pairs.where("c1 <> c2").select(F.col("c2"), F.col("b"), F.col("c1"), F.col("a")))
    return both.mapInPandas(run, "c1 int, c2 int, statistic double, p double")


def impute(cells_rows: DataFrame, centres: DataFrame, members: DataFrame, least: int = 10) -> DataFrame:
    """Missing entries take the centre's value where it is positive, in clusters of more than `least` rows."""
    big = large_clusters(members, least)
    joined = cells_rows.join(big, "row_id", "left").join(F.broadcast(centres), "cid", "left")
    filled = F.when(F.col("centre").isNotNull(), F.zip_with("features", "centre", lambda x, c: F.coalesce(x, F.when(c > 0, c)))).otherwise(F.col("features"))
    return joined.select("row_id", filled.alias("features"))


def impute_all(rows: DataFrame, first: int = 1280, last: int = 10, medians_from: int = 160) -> DataFrame:
    """Imputation by k-means with k halved from `first` to `last`, then by k-medians from `medians_from`, while entries are missing."""
    spark = rows.sparkSession
    for kind, k in [("means", first), ("medians", medians_from)]:
        while k >= last:
            n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.exists("features", lambda x: x.isNull()), 1).otherwise(0)).alias("m")).first()
            if not n.m:
                return rows
            if k <= n.n:
                centres = fit(rows, k, kind, [k], 15)
                members = assign(rows, centres, kind).select("row_id", "cid")
                rows = cut(impute(rows, centres_frame(spark, centres[0]), members))
            k //= 2
    return rows


#: Lanczos steps at most, and the residual at which they end.
STEPS = 200
RESIDUAL = 1e-9


def first_eigenvector(rows: DataFrame, values: DataFrame) -> DataFrame:
    """(row_id, value) of the eigenvector of the largest eigenvalue of the symmetric matrix (i, j, value), sign fixed so that its largest entry is positive.

    Lanczos with full orthogonalisation: the matrix stays a table, each step is one product with a vector, and
    only vectors (a number for each bin of a chromosome) are on the driver.  Null values count as 0."""
    spark = rows.sparkSession
    half = values.select("i", "j", F.when(F.isnan("value"), None).otherwise(F.col("value")).alias("value")).where("value is not null")
    both = cut(half.union(half.where("i <> j").select("j", "i", "value")))
    ids = np.array(sorted(r[0] for r in values.select("i").union(values.select("j")).distinct().collect()), np.int64)
    if not len(ids):
        return spark.createDataFrame([], "row_id long, value double")

    def times(v: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                s = np.bincount(np.searchsorted(ids, pdf.i), pdf.value * v[np.searchsorted(ids, pdf.j)], len(ids))
                at = np.flatnonzero(s)
                yield pd.DataFrame({"i": ids[at], "s": s[at]})

        out = np.zeros(len(ids))
        for r in both.mapInPandas(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
            out[np.searchsorted(ids, r.i)] = r.s
        return out

    return _lanczos(spark, ids, times)


#: Numbers that a task sums up for a product by patterns of missing entries; where there are more patterns, the product goes by blocks.
SUMS = 250_000


def first_eigenvector_of(rows: DataFrame, metric: str) -> DataFrame:
    """first_eigenvector of the cosine or correlation between all pairs of rows (row_id, features), whose values are never stored or shuffled.

    Where rows have few patterns of missing entries, a product with a vector takes rows times patterns, else all pairs are computed anew in each step."""
    if metric not in ("cosine", "correlation"):
        raise ValueError(f"unknown similarity {metric}")
    rows = cut(rows.where("row_id is not null").select("row_id", "features"))
    ids = np.sort(rows.select("row_id").toArrow()["row_id"].to_numpy().astype(np.int64))
    if not len(ids):
        return rows.sparkSession.createDataFrame([], "row_id long, value double")
    return _lanczos(rows.sparkSession, ids, _times_by_masks(rows, ids, metric) or _times_by_blocks(rows, ids, metric))


def _scaled(x: np.ndarray, masks: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows and patterns (1 where a value is there): the rows with 0 for missing entries, and the factors and means by which, over the columns shared with a
    pattern, the metric of two rows is the dot product of (row - mean) * factor.  A row that cannot be compared has the factor 0."""
    seen = ~np.isnan(x)
    x = np.where(seen, x, 0.0)
    if metric == "cosine":
        return x, 1 / np.sqrt((x * x) @ masks.T + 1e-100), np.zeros((len(x), len(masks)))
    x = _levelled(x, seen)
    total = x @ masks.T
    mean = total / np.maximum(seen @ masks.T, 1)
    spread = (x * x) @ masks.T - total * mean
    return x, np.where(spread > 1e-12, 1 / np.sqrt(np.where(spread > 1e-12, spread, 1.0)), 0.0), mean


def _times_by_masks(rows: DataFrame, ids: np.ndarray, metric: str) -> Callable[[np.ndarray], np.ndarray] | None:
    """Products of the matrix of all pairs with vectors, from rows stored by their pattern of missing entries; None if the patterns are too many.

    The rows of a pattern are summed up for each other pattern, scaled over the columns that both share, and each row is multiplied with these sums."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            table = pa.Table.from_batches(own).combine_chunks()
            row = table["row_id"].to_numpy().astype(np.int64)
            x = table["features"].chunk(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(row), -1)
            masks, which = np.unique(~np.isnan(x), axis=0, return_inverse=True)
            at = [np.flatnonzero(which.ravel() == m) for m in range(len(masks))]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.binary()) for z in ([m.tobytes() for m in masks], [row[p].tobytes() for p in at], [x[p].tobytes() for p in at])], names=["mask", "row_id", "features"])

    cores = prepare(rows.sparkSession).sparkContext.defaultParallelism
    parts = max(-(-len(ids) // PART), min(4 * cores, max(1, len(ids) // 256)))
    packed = cut(rows.repartition(parts, "row_id").mapInArrow(pack, "mask binary, row_id binary, features binary"))
    width = packed.select(F.octet_length("mask")).first()[0]
    most = int((SUMS / max(1, width)) ** 0.5)
    known = [bytes(r[0]) for r in packed.select("mask").distinct().limit(most + 1).collect()]
    if len(known) > most:
        return None
    packed, number = packed.coalesce(cores), {m: k for k, m in enumerate(sorted(known))}
    masks = np.array([np.frombuffer(m, bool) for m in number]).astype(float)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for k in range(batch.num_rows):
                i = array_of(batch, "row_id", k)
                yield number[batch.column("mask")[k].as_py()], i, *_scaled(array_of(batch, "features", k, float).reshape(len(i), -1), masks, metric)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"mask": pdf["mask"][:1], "s": [np.sum([np.frombuffer(s) for s in pdf.s], 0).tobytes()]})

    def times(v: np.ndarray) -> np.ndarray:
        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for m, i, x, factor, mean in blocks(batches):
                y = v[np.searchsorted(ids, i)][:, None] * factor
                held[m] = held.get(m, 0.0) + masks * masks[m] * (y.T @ x - (y * mean).sum(0)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([s.tobytes() for s in held.values()], pa.binary())], names=["mask", "s"])

        got = packed.mapInArrow(total, "mask int, s binary").groupBy("mask").applyInPandas(add, "mask int, s binary").collect()
        sums = np.zeros((len(masks), *masks.shape))
        for r in got:
            sums[r["mask"]] = np.frombuffer(r.s).reshape(masks.shape)

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for m, i, x, factor, mean in blocks(batches):
                s = (factor * (x @ sums[:, m].T - mean * sums[:, m].sum(1))).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(s)], names=["i", "s"])

        return _placed(packed.mapInArrow(product, "i long, s double"), ids)

    return times


def _placed(got: DataFrame, ids: np.ndarray) -> np.ndarray:
    """Numbers (i, s) in the order of the ids."""
    table, out = got.toArrow(), np.zeros(len(ids))
    out[np.searchsorted(ids, table["i"].to_numpy())] = table["s"].to_numpy()
    return out


def _times_by_blocks(rows: DataFrame, ids: np.ndarray, metric: str) -> Callable[[np.ndarray], np.ndarray]:
    """Products of the matrix of all pairs with vectors, from pairs of blocks whose values are computed anew each time."""
    blocks = Blocks(rows)
    units = blocks.units().coalesce(blocks.parts)  # a task takes a part of the rows against all, and gives a number for each of its rows

    def times(v: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for k in range(batch.num_rows):
                    i, x, j, y = unit_of(batch, k)
                    s = np.nan_to_num(pair_values(x, y, metric), nan=0.0) @ v[np.searchsorted(ids, j)]
                    b = batch.column("b1")[k].as_py()
                    total[b] = i, total[b][1] + s if b in total else s
            for i, s in total.values():
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(s)], names=["i", "s"])

        return _placed(units.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")), ids)

    return times


def _lanczos(spark: SparkSession, ids: np.ndarray, times: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(row_id, value) of the first eigenvector of the matrix that `times` multiplies vectors with."""
    v = np.random.default_rng(0).normal(size=len(ids))
    basis, alpha, beta = [v / np.linalg.norm(v)], [], []
    while True:
        w = times(basis[-1])
        alpha.append(float(w @ basis[-1]))
        q = np.array(basis)
        for _ in range(2):
            w -= q.T @ (q @ w)
        size = float(np.linalg.norm(w))
        t = np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1)
        value, vector = np.linalg.eigh(t)
        scale = max(1.0, abs(value[-1]))
        if size * abs(vector[-1, -1]) < RESIDUAL * scale or len(basis) >= min(len(ids), STEPS):
            break
        beta.append(size)
        basis.append(w / size)
    v = q.T @ vector[:, -1]
    v /= np.linalg.norm(v)
    if v[np.abs(v).argmax()] < 0:
        v = -v
    return spark.createDataFrame(pa.table({"row_id": ids, "value": v}))
