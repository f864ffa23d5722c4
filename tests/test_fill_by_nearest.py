"""Filling by neighbours that are found anew in each chunk: none is stored, and labels are those of stored neighbours."""

import numpy as np
import pytest

from contactloom.operators import consensus, metrics
from contactloom.plans import queries


def table(spark, x):
    return spark.createDataFrame([(3 * i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")


def brute_force(x, labels, percent):
    """Labels by row number, each row after the other."""
    n = len(x)
    i, j = np.divmod(np.arange(n * n), n)
    value = metrics.values_of(x[i], x[j], "euclidean").reshape(n, n)
    np.fill_diagonal(value, np.nan)
    near = np.zeros((n, n), bool)
    for r in range(n):
        v = np.sort(value[r][~np.isnan(value[r])])
        if len(v):
            place = (len(v) + 1) * percent / 100
            low = max(1, min(int(place), len(v)))
            share = 0 if place < 1 or place >= len(v) else place - int(place)
            near[r] = value[r] < v[low - 1] + share * (v[min(low + 1, len(v)) - 1] - v[low - 1])
    known = np.array([r in labels for r in range(n)])
    out = dict(labels)
    for r in sorted(np.nonzero(~known)[0].tolist(), key=lambda r: ((near[r] & ~known).sum() / near[r].sum() if near[r].any() else 2, r)):
        seen = [out[o] for o in np.nonzero(near[r])[0].tolist() if o in out]
        out[r] = min(set(seen), key=lambda c: (-seen.count(c), c), default=0)
    return out


def test_labels_are_those_of_stored_neighbours(spark, monkeypatch):
    monkeypatch.setattr(consensus, "PIECE", 16)
    rng = np.random.default_rng(41)
    n = 300
    x = rng.normal(size=(n, 6))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[200:260] = x[0]  # copies tie
    x[7] = np.nan  # a row without distances
    known = {r: int(rng.integers(0, 4)) * 5 for r in range(n) if rng.random() < 0.2 and r != 7}
    rows, hubs = table(spark, x), spark.createDataFrame([(3 * r, c) for r, c in known.items()], "row_id long, cid int")
    want = {3 * r: c for r, c in brute_force(x, known, 10.0).items()}
    for block, chunk in ((32, 48), (20, 4096)):
        got = consensus.fill_by_nearest(rows, hubs, "euclidean", 10.0, block, chunk).collect()
        assert len(got) == n and {r.row_id: r.cid for r in got} == want
    stored = consensus.fill_by_neighbours(rows, hubs, metrics.nearest_rows(rows, "euclidean", 10.0, 32))
    assert {r.row_id: r.cid for r in stored.collect()} == want


def test_nothing_to_fill_and_no_hub(spark):
    rows = table(spark, np.random.default_rng(42).normal(size=(40, 3)))
    some = spark.createDataFrame([(3 * r, r % 3) for r in range(40)], "row_id long, cid int")
    assert {(r.row_id, r.cid) for r in consensus.fill_by_nearest(rows, some).collect()} == {(3 * r, r % 3) for r in range(40)}
    assert {(r.row_id, r.cid) for r in consensus.fill_by_nearest(rows, some.limit(0), percent=20.0).collect()} == {(3 * r, 0) for r in range(40)}
    assert consensus.fill_by_nearest(rows.limit(0), some.limit(0)).count() == 0


def test_the_query_stores_rows_not_neighbours(spark, monkeypatch):
    stored = []

    def counting(df, cut=consensus.cut):
        out = cut(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(consensus, "cut", counting)
    monkeypatch.setattr(metrics, "cut", counting)
    n = queries.QUERIES["m23_fill_by_neighbours"](spark, "/root/testdata/sf0.01").count()
    assert n == 500 and max(stored) <= 4 * n  # a row, or a row for each of 3 hubs and for no label; its neighbours are 49 a row


@pytest.mark.parametrize("metric", metrics.KERNELS[:2] + metrics.KERNELS[3:])
def test_values_near_limits_are_computed_pair_by_pair(metric):
    x = np.random.default_rng(43).normal(size=(50, 9))
    x[3, 2:5], x[40] = np.nan, x[0]
    value = metrics.pair_values(x, x[::-1].copy(), metric)
    i, j = np.divmod(np.arange(2500), 50)
    own = metrics.values_of(x[i], x[::-1][j], metric).reshape(50, 50)
    assert np.allclose(own, value, rtol=1e-12, atol=1e-12, equal_nan=True) and (own[0] == own[40]).all()
    limit = np.median(value, 1)
    noisy = value * (1 + 1e-11)  # as if of another block
    assert ((metrics.settled(noisy, x, x[::-1].copy(), metric, limit, limit) < limit[:, None]) == (own < limit[:, None])).all()


def test_manhattan_by_larger_values_equals_differences(spark):
    rng = np.random.default_rng(38)
    x = rng.normal(size=(70, 9)) * 10.0 ** rng.integers(-4, 5, (70, 1))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:20] = x[:20] * 1e-7 + 4e6  # nearly all cancels
    x[3], x[4], x[50] = np.nan, x[5], x[51]
    n = (~np.isnan(x[:, None] - x)).sum(2)
    with np.errstate(invalid="ignore"):
        want = np.where(n > 0, 9 * np.nansum(np.abs(x[:, None] - x), 2) / n, np.nan)
    got = metrics.pair_values(x, x, "manhattan")
    assert np.array_equal(np.isnan(got), np.isnan(want)) and np.allclose(got, want, rtol=1e-8, atol=0, equal_nan=True)
    assert (np.diag(got)[n.diagonal() > 0] == 0).all() and got[4, 5] == got[50, 51] == 0
    p, q = np.divmod(np.arange(4900), 70)
    assert np.allclose(metrics.values_of(x[p], x[q], "manhattan"), want.ravel(), rtol=1e-12, atol=0, equal_nan=True)
    limit = np.nanmedian(np.where(n > 0, want, np.nan)[5:50], 1)  # values near a limit are the same in any blocks
    assert np.array_equal(metrics.nearer(x[5:50], x, "manhattan", limit), np.concatenate([metrics.nearer(x[5:50], x[s : s + 7], "manhattan", limit) for s in range(0, 70, 7)], 1))
    x[60, 2] = np.inf
    assert metrics.pair_values(x[60:61], x[61:], "manhattan")[0].tolist() == [np.inf if not np.isnan(v) else metrics.pair_values(x[60:61], x[61:], "manhattan")[0, k] for k, v in enumerate(x[61:, 2])]


def test_neighbours_by_two_rules_equal_brute_force(spark):
    rng = np.random.default_rng(39)
    x = np.round(rng.normal(size=(150, 5)), 1)  # many equal distances
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")
    got = {(r.i, r.j) for r in metrics.Nearest(rows, ("euclidean", 10.0), ("manhattan", 20.0), block=16).pairs().collect()}
    one, two = ({(r.i, r.j) for r in metrics.nearest_rows(rows, m, p, 16).collect()} for m, p in (("euclidean", 10.0), ("manhattan", 20.0)))
    assert got == one & two and got
    value = metrics.values_of(np.repeat(x, 150, 0), np.tile(x, (150, 1)), "manhattan").reshape(150, 150)
    np.fill_diagonal(value, np.nan)
    for i in range(150):
        own = np.sort(value[i][~np.isnan(value[i])])
        place = (len(own) + 1) * 0.2
        k = int(place)
        limit = own[k - 1] + (place - k) * (own[k] - own[k - 1])
        assert {j for j in range(150) if value[i, j] < limit} == {j for a, j in two if a == i}
