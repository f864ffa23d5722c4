"""Restarts, their cap, the sweep over k and the p of chi-square, against plain computations."""

import math

import numpy as np
import pytest

from contactloom.operators import cluster, metrics


def frame(spark, x):
    return spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")


@pytest.mark.parametrize("kind, metric", [("means", "euclidean"), ("medians", "manhattan")])
def test_best_restart_has_the_lowest_valid_sum(spark, kind, metric):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(60, 3))  # no clear groups, so restarts differ
    x[rng.random(x.shape) < 0.05] = np.nan
    rows, k, runs, seed = frame(spark, x).cache(), 4, [], 7
    while len(runs) < 3 and seed < 40:  # seeds in turn until three runs are valid
        centres = cluster.fit(rows, k, kind, [seed], 6)[0]
        distances = metrics.pair_values(x, centres, metric)
        closest = np.nan_to_num(distances, nan=np.inf).argmin(1)
        if np.bincount(closest, minlength=k).min() >= cluster.MIN_CLUSTER:
            runs.append((distances[np.arange(60), closest].sum() / k, seed, closest))
        seed += 1
    assert len(runs) == 3
    want = min(runs, key=lambda r: r[:2])[2]
    place = {c: n for n, c in enumerate(sorted(range(k), key=lambda c: (-(want == c).sum(), int(np.argmax(want == c)))))}
    members = cluster.best_of(rows, k, kind, 3, 7, 6)[1]
    assert {r.row_id: r.cid for r in members.collect()} == {i: place[c] for i, c in enumerate(want)}


def test_restarts_end_at_the_cap(spark, monkeypatch):
    tried = []
    fit = cluster.fit
    monkeypatch.setattr(cluster, "ATTEMPTS", 7)
    monkeypatch.setattr(cluster, "fit", lambda rows, k, kind, seeds, iterations: tried.append(list(seeds)) or fit(rows, k, kind, seeds, iterations))
    x = np.array([[0.0, 0.0]] * 12 + [[50.0, 50.0]] * 2)  # the second group is too small at every start
    with pytest.raises(ValueError, match="7 runs"):
        cluster.best_of(frame(spark, x), 2, "means", restarts=3, seed=40, iterations=2)
    assert tried == [[40, 41, 42], [43, 44, 45], [46]]


def test_sweep_is_the_best_of_every_k_and_kind(spark):
    rng = np.random.default_rng(22)
    x = np.repeat([[0.0, 0.0], [9.0, 0.0], [0.0, 9.0]], 10, axis=0) + rng.normal(size=(30, 2)) / 10
    rows = frame(spark, x).cache()
    got = [(k, kind, {r.row_id: r.cid for r in m.collect()}) for k, kind, m in cluster.sweep(rows, 2, 4, restarts=2, iterations=5)]
    assert [g[:2] for g in got] == [(2, "means"), (2, "medians"), (3, "means"), (3, "medians")]
    assert all(labels == {i: i // 10 for i in range(30)} for k, _, labels in got if k == 3)
    assert all(len({labels[i] for i in range(s, s + 10)}) == 1 for _, _, labels in got for s in (0, 10, 20))


def survival(x, degrees):
    """Chance of more than x in a chi-square distribution, by the finite sums for even and odd degrees."""
    half = x / 2
    if degrees % 2 == 0:
        return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(degrees // 2))
    return math.erfc(math.sqrt(half)) + math.exp(-half) * sum(half ** (i + 0.5) / math.gamma(i + 1.5) for i in range(degrees // 2))


def test_chi_square_equals_closed_forms(spark):
    rng = np.random.default_rng(23)
    for width in (6, 9, 40, 81):
        x = rng.uniform(1, 30, size=(3, width))
        x[rng.random(x.shape) < 0.1] = np.nan
        centres = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "cid int, centre array<double>")
        got = {(r.c1, r.c2): (r.statistic, r.p) for r in cluster.chi_square(centres).collect()}
        assert len(got) == 9
        for (i, j), (statistic, p) in got.items():
            o, e = np.rint(x[i, : width // 2]), x[j, : width // 2]
            o, e = o[~np.isnan(o + e)], e[~np.isnan(o + e)]
            if len(e) < 2:
                assert statistic is None and p is None
                continue
            e = e * o.sum() / e.sum()
            want = ((o - e) ** 2 / e).sum()
            assert math.isclose(statistic, want, rel_tol=1e-9) and math.isclose(p, survival(want, len(e) - 1), rel_tol=1e-8, abs_tol=1e-12)


def test_restarts_run_on_all_cores(spark, monkeypatch):
    parts = []
    fit = cluster.fit
    monkeypatch.setattr(cluster, "fit", lambda rows, *more: parts.append(rows.rdd.getNumPartitions()) or fit(rows, *more))
    x = np.random.default_rng(24).normal(size=(2000, 2)) + 20 * (np.arange(2000) % 2)[:, None]
    members = cluster.best_of(frame(spark, x).coalesce(1), 2, restarts=2, iterations=3)[1]
    assert parts == [spark.sparkContext.defaultParallelism] and len({(r.row_id % 2, r.cid) for r in members.collect()}) == 2


def test_medians_take_one_pass_a_step(spark, monkeypatch):
    rng = np.random.default_rng(25)
    x = np.repeat([[0.0] * 3, [2.0] * 3], 300, axis=0) + rng.normal(size=(600, 3))
    x[:, 2] = np.round(x[:, 2])  # many equal values
    x[rng.random(x.shape) < 0.1] = np.nan
    rows, passes, steps = frame(spark, x).repartition(4).cache(), [], []
    count, step = cluster._parted, cluster._step_medians
    monkeypatch.setattr(cluster, "_parted", lambda *args: passes.append(len(args[1])) or count(*args))
    monkeypatch.setattr(cluster, "_step_medians", lambda *args: steps.append(args[1]) or step(*args))
    monkeypatch.delattr(cluster, "_counts")  # no narrowing where few values are about the medians
    got = cluster.fit(rows, 2, "medians", [3, 4])
    assert len(steps) > 2 and len(passes) < 2 * len(steps) - 1  # the first step looks twice, later ones where centres move far
    assert len(cluster._step_medians(rows, got, cluster._edges(rows, cluster._bounds(rows, 3), 2))) == 2
    monkeypatch.undo()
    bounds = cluster._bounds(rows, 3)
    edges, wanted = cluster._edges(rows, bounds, 2), cluster._step_medians(rows, got, bounds)
    assert edges.shape[1] == 3 and np.array_equal(edges[[0, -1]], bounds) and (np.diff(edges, axis=0) >= 0).all()
    for gathered in (cluster.GATHERED, 0):  # by values in parts, and by narrowing
        monkeypatch.setattr(cluster, "GATHERED", gathered)
        assert np.array_equal(cluster._step_medians(rows, got, edges), wanted)
    for own, centres in zip(wanted, got, strict=True):
        near = np.nan_to_num(metrics.pair_values(x, centres, "manhattan"), nan=np.inf).argmin(1)
        assert np.array_equal(own, [np.nanmedian(x[near == c], 0) for c in (0, 1)])


def test_partial_sums_of_means_are_the_same_by_driver_and_spark(spark, monkeypatch):
    rng = np.random.default_rng(26)
    x = rng.normal(size=(200, 3))
    x[rng.random(x.shape) < 0.1] = np.nan
    rows, centres = frame(spark, x).repartition(4).cache(), rng.normal(size=(2, 3, 3))
    want = cluster._step_means(rows, centres, 4)
    monkeypatch.setattr(cluster, "NUMBERS", 1)
    assert np.allclose(cluster._step_means(rows, centres, 4), want, rtol=1e-13)
    for own, start in zip(want, centres, strict=True):
        near = np.nan_to_num(metrics.pair_values(x, start, "euclidean"), nan=np.inf).argmin(1)
        assert np.allclose(own, [np.nanmean(x[near == c], 0) for c in range(3)])


def test_sweep_takes_one_job_a_step_of_means(spark):
    rows, centres = frame(spark, np.random.default_rng(27).normal(size=(300, 2))).repartition(4).cache(), np.zeros((2, 3, 2))
    rows.count()
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    cluster._step_means(rows, centres, 4)
    assert len(tracker.getJobIdsForGroup(None)) == before + 1  # no shuffle of the sums
