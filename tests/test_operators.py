"""Closed-form and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.functions import vectors
from contactloom.operators import cluster, consensus, contacts, intervals, matrix, metrics, scoring, tracks
from contactloom.plans import commands
from contactloom.sources import bed

CHROMS = [(1, "chr1", 60_000_000), (2, "chr2", 50_000_000)]
LINES = [
    "chr1\t0\t2500000\tA1\t7\t.\t0\t2500000\t1,2,3", "chr1\t2500000\t3000000\ta1\t9\t.\t0\t0\t0,0,0", "chr1\t3000000\t4000000\tNA\t0\t.\t0\t0\t0,0,0", "chr1\t4000000\t5000000\tB1",
    "track name=x", "chrUnknown\t0\t1000000\tC1\t1\t.\t0\t0\t0,0,0", "chr1\t5000000\t999999999\tB1\t2\t.\t0\t0\t0,0,0", "chr1\t0\t2500000\tB1\t2\t.\t0\t0\t0,0,0",
]


def test_bed_edge_cases(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_no long, value string")
    chroms = spark.createDataFrame(CHROMS, "chr_idx int, name string, length long")
    got = {(r.x1, r.x2): (r.cluster_id, r.cluster_name) for r in bed.parse(lines, chroms).collect()}
    assert got == {(0, 2_500_000): (0, "A1"), (2_500_000, 3_000_000): (0, "A1"), (5_000_000, 60_000_000): (2, "B1")}


def test_split_then_collapse_and_empty_interval(spark):
    t = spark.createDataFrame([(1, 100, 1050, 3), (2, 5, 5, 1)], "chr_idx int, x1 int, x2 int, cluster_id int")
    pieces = intervals.split(t, 300)
    assert sorted((r.x1, r.x2) for r in pieces.collect()) == [(100, 400), (400, 700), (700, 1000), (1000, 1050)]
    assert [tuple(r) for r in intervals.collapse(pieces).collect()] == [(1, 100, 1050, 3)]
    assert intervals.to_bins(t.where("x1 = x2"), 5).count() == 0


def test_ari_of_a_track_with_itself_and_of_one_cluster(spark):
    t = spark.createDataFrame([(1, i, i + 1, i % 3) for i in range(12)], "chr_idx int, x1 int, x2 int, cluster_id int")
    assert tracks.adjusted_rand_index(tracks.contingency(t, t)).first().ari == 1.0
    one = t.withColumn("cluster_id", F.lit(0))
    assert tracks.adjusted_rand_index(tracks.contingency(one, one)).first().ari is None
    moved = t.withColumn("cluster_id", (F.col("cluster_id") + 1) % 3)
    assert tracks.accuracy(tracks.contingency(t, moved)).first().accuracy == 1.0


def test_twelve_hits_make_a_translocation(spark):
    rows = [(1, i, 2, i, 5.0) for i in range(11)] + [(1, i, 3, i, 5.0) for i in range(12)]
    c = spark.createDataFrame(rows, "chr1 int, bin1 int, chr2 int, bin2 int, cnt double")
    cut = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0)], "chr1 int, chr2 int, cutoff double")
    assert [(r.chr1, r.chr2) for r in contacts.translocations(c, cut).collect()] == [(1, 3)]


def test_coverage_norm_keeps_the_total_and_rows_need_four_cells(spark):
    cells = spark.createDataFrame([(i, j, float(i + j + 1) if i or j < 3 else None) for i in range(4) for j in range(5)], "row_id long, col_id int, v double")
    total = cells.agg(F.sum("v")).first()[0]
    assert abs(matrix.vanilla_coverage(cells).agg(F.sum("v")).first()[0] - total) < 1e-9
    assert sorted(r.row_id for r in matrix.good_rows(cells, 5).collect()) == [1, 2, 3]


def test_metrics_skip_missing_and_give_null_without_overlap(spark):
    df = spark.createDataFrame([([1.0, None, 3.0], [2.0, 5.0, 5.0]), ([1.0, None], [None, 2.0])], "a array<double>, b array<double>")
    got = df.select(vectors.euclidean("a", "b").alias("e"), vectors.manhattan("a", "b").alias("m"), vectors.correlation("a", "b").alias("c")).collect()
    assert abs(got[0].e - (3 * 5 / 2) ** 0.5) < 1e-12 and abs(got[0].m - 4.5) < 1e-12 and abs(got[0].c - 1) < 1e-12
    assert got[1].e is None and got[1].m is None and got[1].c is None


def test_all_pairs_equal_column_metrics(spark):
    rows = spark.createDataFrame([(i, [float((i * 7 + j * 3) % 5) if (i + j) % 4 else None for j in range(6)]) for i in range(9)], "row_id long, features array<double>")
    a = {(r.i, r.j): r.value for r in metrics.all_pairs(rows, "euclidean", block=4).collect()}
    other = rows.select(F.col("row_id").alias("j"), F.col("features").alias("g"))
    b = {(r.row_id, r.j): r.v for r in rows.join(other, F.col("row_id") <= F.col("j")).select("row_id", "j", vectors.euclidean("features", "g").alias("v")).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_kmeans_finds_planted_groups(spark):
    rows = spark.createDataFrame([(i, [float(10 * (i % 3)), float(i % 2) if i % 5 else None, float(-10 * (i % 3))]) for i in range(60)], "row_id long, features array<double>")
    _, members = cluster.best_of(rows, 3, restarts=3)
    groups = {r.row_id: r.cid for r in members.collect()}
    assert len({(i % 3, c) for i, c in groups.items()}) == 3


def test_first_centres_come_from_all_rows(spark):
    rng = np.random.default_rng(12)
    place = np.array([[0, 0], [5000, 0], [0, 5000], [5000, 5000]])
    x = np.concatenate([p + rng.normal(size=(n, 2)) for p, n in zip(place, (3000, 3000, 30, 3), strict=True)])
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, features array<double>").repartition(7)
    for kind in ("means", "medians"):
        centres = cluster.first_centres(rows, 4, [1, 2, 3], kind)
        assert centres.shape == (3, 4, 2)
        for own in centres:  # the smallest group has three of 6033 rows
            assert {int(np.abs(place - c).sum(1).argmin()) for c in own} == {0, 1, 2, 3}
        again = cluster.first_centres(rows.repartition(3), 4, [1, 2, 3], kind)
        assert np.array_equal(centres, again)
    few = spark.createDataFrame([(i, [1.0, None]) for i in range(5)], "row_id long, features array<double>")
    assert cluster.first_centres(few, 5, [1])[0].tolist() == [[1.0, 0.0]] * 5
    with pytest.raises(ValueError, match="5 rows cannot give 6"):
        cluster.first_centres(few, 6, [1])


def test_medians_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(21)
    x = np.column_stack([rng.normal(size=400), rng.integers(0, 3, 400), np.zeros(400), np.exp(rng.normal(size=400) * 9), np.full(400, np.nan), np.where(rng.random(400) < 0.7, 5.0, rng.normal(size=400))])
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>").repartition(5)
    centres = np.array([[[c * 0.7 - 1, c, 0, 10.0**c, 0, 5] for c in range(4)], [[9e9] * 6] * 4])  # the second restart has empty groups
    bounds = cluster._bounds(rows, 6)
    for numbers in (8_000_000, 1):  # together and one restart at a time
        monkeypatch.setattr(cluster, "NUMBERS", numbers)
        got = cluster._step_medians(rows, centres, bounds)
        for i in range(2):
            near = np.nan_to_num(metrics.pair_values(x, centres[i], "manhattan"), nan=np.inf).argmin(1)
            for c in range(4):
                for j in range(6):
                    own = x[near == c, j][~np.isnan(x[near == c, j])]
                    assert got[i, c, j] == (np.median(own) if len(own) else centres[i, c, j])


def test_lloyd_calls_its_listener(spark):
    rows = spark.createDataFrame([(i, [float(10 * (i % 3)), float(i % 2)]) for i in range(60)], "row_id long, features array<double>")
    seen = []
    cluster.fit(rows, 3, seeds=[1, 2], listener=lambda number, moved: seen.append((number, moved)))
    assert [n for n, _ in seen] == list(range(len(seen))) and all(m.shape == (2,) for _, m in seen)
    assert seen[0][1].max() > 0 and seen[-1][1].max() < 1e-9


def test_all_missing_entries_are_imputed(spark):
    rng = np.random.default_rng(13)
    group = np.arange(90) % 3
    x = np.array([[1.0, 8, 3, 6], [7, 2, 9, 1], [4, 4, 1, 9]])[group] + rng.random((90, 4)) / 10
    gone = rng.random(x.shape) < 0.15
    gone[:6] = False
    rows = spark.createDataFrame([(i, [None if g else float(v) for v, g in zip(r, m, strict=True)]) for i, (r, m) in enumerate(zip(x, gone, strict=True))], "row_id long, features array<double>")
    got = {r.row_id: r.features for r in cluster.impute_all(rows, first=1280, last=3, medians_from=12).collect()}  # k is halved until the rows can give it
    assert len(got) == 90 and not any(v is None for f in got.values() for v in f)
    assert all(abs(got[i][j] - x[i, j]) < 0.2 for i in range(90) for j in range(4))
    assert all(got[i][j] == x[i, j] for i in range(90) for j in range(4) if not gone[i, j])


def test_rows_are_filled_in_order(spark):
    n = 53  # a chain: each row sees the one before it; the last row has no neighbour
    rows = spark.createDataFrame([(i,) for i in range(n + 1)], "row_id long")
    near = spark.createDataFrame([(i, j) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "i long, j long")
    got = consensus.fill_by_neighbours(rows, spark.createDataFrame([(0, 2)], "row_id long, cid int"), near, chunk=20)
    assert {(r.row_id, r.cid) for r in got.collect()} == {(i, 2) for i in range(n)} | {(n, 0)}


def test_filling_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    n = 90
    near = {i: sorted(rng.choice(n, int(rng.integers(0, 7)), replace=False).tolist()) for i in range(n)}
    labels = {i: int(rng.integers(0, 4)) for i in range(n) if rng.random() < 0.3}
    hubs, links = list(labels.items()), [(i, j) for i, v in near.items() for j in v]
    order = sorted((i for i in range(n) if i not in labels), key=lambda i: (sum(j not in dict(hubs) for j in near[i]) / len(near[i]) if near[i] else 2, i))
    for i in order:
        seen = [labels[j] for j in near[i] if j in labels]
        labels[i] = min(set(seen), key=lambda c: (-seen.count(c), c), default=0)
    for chunk in (7, 1024):
        got = consensus.fill_by_neighbours(spark.range(n).withColumnRenamed("id", "row_id"), spark.createDataFrame(hubs, "row_id long, cid int"), spark.createDataFrame(links, "i long, j long"), chunk)
        assert {r.row_id: r.cid for r in got.collect()} == labels


def test_lloyd_steps_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 5))
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")
    for kind, metric, middle in (("means", "euclidean", np.nanmean), ("medians", "manhattan", np.nanmedian)):
        centres = cluster.first_centres(rows, 3, [5], kind)[0]
        for _ in range(4):
            near = np.nan_to_num(metrics.pair_values(x, centres, metric), nan=np.inf).argmin(1)
            centres = np.array([[middle(x[near == c, j]) if (~np.isnan(x[near == c, j])).any() else centres[c, j] for j in range(5)] for c in range(3)])
        assert np.allclose(cluster.fit(rows, 3, kind, [5], 4)[0], centres)


def test_first_eigenvector_equals_numpy(spark):
    rng = np.random.default_rng(8)
    m = np.corrcoef(rng.normal(size=(30, 40)) + rng.normal(size=40) * rng.normal(size=(30, 1)))
    values = spark.createDataFrame([(100 + i, 100 + j, float(m[i, j])) for i in range(30) for j in range(i, 30)], "i long, j long, value double")
    got = {r.row_id: r.value for r in cluster.first_eigenvector(values, values).collect()}
    want = np.linalg.eigh(m)[1][:, -1]
    want *= np.sign(want[np.abs(want).argmax()])
    assert np.allclose([got[100 + i] for i in range(30)], want, atol=1e-6)


def test_settings_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    inter, intra, w = rng.integers(0, 9, (12, 6)).astype(float), rng.normal(size=(12, 6)), np.array([3, 1, 4, 1, 5, 9])
    cells = lambda x: spark.createDataFrame([(i, j, float(x[i, j])) for i in range(12) for j in range(6)], "row_id long, col_id int, v double")
    weights = spark.createDataFrame([(j, int(v)) for j, v in enumerate(w)], "col_id int, w long")
    seen = 0
    for (post, scaled, log, appended), got, own in commands.configured(cells(inter), cells(intra), (cells(inter + 1), cells(intra - 1)), weights, 6):
        x, behind = (inter, intra) if post else (inter + 1, intra - 1)
        if post:
            pos = np.where(x > 0, x, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                y = np.where(x > 0, pos / pos.sum(1, keepdims=True) / pos.sum(0), np.nan)
            y *= pos.sum() / np.nansum(y)
        else:
            y = x / w
        y = np.log(y + 1) if log else y
        for j in range(6):
            z = y[y[:, j] > 0, j]
            y[:, j] = np.where(y[:, j] > 0, np.clip((y[:, j] - z.mean()) / z.std(ddof=1), -3, 3), y[:, j])
        y, v = (np.hstack([y, behind]), np.hstack([w, w])) if appended else (y, w)
        if scaled:
            got, y = matrix.scale_by_root_weights(got, own), y * np.sqrt(v)
        kept = (~np.isnan(y)).sum(1)
        want = {(i, j): y[i, j] for i in range(12) for j in range(y.shape[1]) if not np.isnan(y[i, j]) and kept[i] > matrix.MIN_GOOD and kept[i] >= matrix.ROW_SHARE * y.shape[1]}
        mine = {(r.row_id, r.col_id): r.v for r in got.collect() if r.v is not None}
        assert mine.keys() == want.keys() and all(abs(mine[k] - want[k]) < 1e-9 for k in want)
        seen += 1
    assert seen == 16


def test_one_cluster_scores_one(spark):
    bins = spark.createDataFrame([(c, b, 0) for c in (1, 2) for b in range(16)], "chr_idx int, bin int, cluster_id int")
    c = spark.createDataFrame([(1, i, 2, j, float(i * j % 7 + 1)) for i in range(16) for j in range(16)], "chr1 int, bin1 int, chr2 int, bin2 int, cnt double")
    chroms = spark.createDataFrame(CHROMS, "chr_idx int, name string, length long")
    for r in scoring.run(c, bins, chroms, ("ODDS_VS_EVENS",), 4, 3).collect():
        assert abs(r.ratio - 1) < 1e-9


def chosen(cells):
    """Cells one by one, the largest first, none that shares an id with one before."""
    out = []
    for *ids, n in sorted(cells, key=lambda c: (-c[-1], c[:-1])):
        if n > 0 and not any(a == b for o in out for a, b in zip(o, ids)):
            out.append((*ids, n))
    return out


def test_greedy_rounds_equal_the_choice_one_by_one(spark):
    rng = np.random.default_rng(12)
    tables = {
        0: [(i, j, int(rng.integers(0, 5))) for i in range(9) for j in range(7)],  # many ties
        1: [(i, j, 3) for i in range(5) for j in range(6)],  # nothing but ties: a chain of rounds
        2: [(i, j, 1000 - 10 * i - j) for i in range(6) for j in range(6) if rng.random() < 0.6],
        3: [(0, 0, 0), (1, 1, -2)],
        4: [(-1, 7, 4), (2, 7, 4), (2, 8, 4)],
    }
    rows = spark.createDataFrame([(g, *c) for g, t in tables.items() for c in t], "g int, id1 int, id2 int, n long")
    got = tracks.greedy_cells(rows, ("g",)).collect()
    want = {g: chosen(t) for g, t in tables.items()}
    assert {(r.g, r.id1, r.id2, r.n) for r in got} == {(g, *c) for g, t in want.items() for c in t} and len(got) == sum(map(len, want.values()))
    shares = {r.g: (r.matched, r.total, r.accuracy) for r in tracks.accuracy(rows, ("g",)).collect()}
    assert shares[3] == (0, -2, 0.0) and all(shares[g][:2] == (sum(c[-1] for c in want[g]), sum(c[-1] for c in tables[g])) for g in tables)
    alone = tracks.accuracy(rows.where("g = 0").drop("g")).first()
    assert (alone.matched, alone.total) == shares[0][:2]
    assert tracks.accuracy(rows.where("g = 9").drop("g")).count() == 0


def test_hubs_of_three_assignments_equal_the_choice_one_by_one(spark):
    rng = np.random.default_rng(13)
    ids = [tuple(int(v) for v in rng.integers(0, 4, 3)) for _ in range(300)]
    one, two, three = (spark.createDataFrame([(i, t[s]) for i, t in enumerate(ids)], "row_id long, cid int") for s in range(3))
    hubs = {c[:3]: h for h, c in enumerate(chosen([(*t, ids.count(t)) for t in set(ids)])[:3])}
    assert {(r.row_id, r.cid) for r in consensus.three_way_hubs(one, two, three, 3).collect()} == {(i, hubs[t]) for i, t in enumerate(ids) if t in hubs}
    pairs = [t[:2] for t in ids]
    hubs = {c[:2]: h for h, c in enumerate(chosen([(*t, pairs.count(t)) for t in set(pairs)])[:3])}
    assert {(r.row_id, r.cid) for r in consensus.two_way_hubs(one, two, 3).collect()} == {(i, hubs[t]) for i, t in enumerate(pairs) if t in hubs}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "correlation"])
@pytest.mark.parametrize("percent", [0.5, 7.0, 100.0])
def test_neighbours_of_rows_equal_brute_force(spark, metric, percent):
    rng = np.random.default_rng(14)
    x = rng.integers(-2, 3, size=(70, 6)).astype(float)  # repeated rows and equal distances
    x[rng.random(x.shape) < 0.2] = np.nan
    x[5] = np.nan  # nothing to compare
    rows = spark.createDataFrame([(3 * i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")
    blocks = [x[s : s + 6] for s in range(0, 70, 6)]  # by blocks of 18 ids, as the operator computes them
    values = np.vstack([np.hstack([metrics.pair_values(a, b, metric) if p <= q else metrics.pair_values(b, a, metric).T for q, b in enumerate(blocks)]) for p, a in enumerate(blocks)])
    upper = np.triu(values, 1)
    values = upper + upper.T
    np.fill_diagonal(values, np.nan)
    want = set()
    for i in range(70):
        v = np.sort(values[i][~np.isnan(values[i])])
        if len(v):
            place = (len(v) + 1) * percent / 100
            low = max(1, min(int(place), len(v)))
            share = 0 if place < 1 or place >= len(v) else place - int(place)
            cut = v[low - 1] + share * (v[min(low + 1, len(v)) - 1] - v[low - 1])
            want |= {(3 * i, 3 * j) for j in range(70) if values[i, j] < cut}
    assert {(r.i, r.j) for r in metrics.nearest_rows(rows, metric, percent, 18).collect()} == want
    assert {(r.i, r.j) for r in metrics.nearest(metrics.all_pairs(rows, metric, block=18), percent).collect()} == want
    assert metrics.nearest_rows(rows.limit(0), metric, percent).count() == 0


def test_bins_keep_the_order_of_values():
    v = np.sort(np.r_[-np.inf, -1e300, -1.0, -1e-300, -0.0, 0.0, 1e-300, np.random.default_rng(1).normal(size=200), 1e300, np.inf])
    assert (np.diff(metrics.value_bins(v)) >= 0).all() and metrics.value_bins(np.array([-0.0]))[0] == metrics.value_bins(np.array([0.0]))[0]


@pytest.mark.parametrize("n, block", [(700, 256), (23, 4)])
def test_all_pairs_shuffle_and_store_rows_not_pairs(spark, n, block):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(n, 8))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[3], x[n - 1] = np.nan, x[0]
    ids = rng.permutation(n) * 5 - 40
    rows = spark.createDataFrame([(int(i), [None if np.isnan(v) else float(v) for v in r]) for i, r in zip(ids, x, strict=True)] + [(None, [1.0] * 8)], "row_id long, features array<double>")
    pairs = metrics.all_pairs(rows, "euclidean", block=block)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    at, value = {int(i): p for p, i in enumerate(ids)}, metrics.pair_values(x, x, "euclidean")
    got = pairs.collect()
    assert len(got) == n * (n + 1) // 2 == len({(r.i, r.j) for r in got}) and all(r.i <= r.j for r in got)
    assert all((r.value is None) == bool(np.isnan(value[at[r.i], at[r.j]])) and (r.value is None or abs(r.value - value[at[r.i], at[r.j]]) < 1e-9) for r in got)
    both = metrics.mirrored(pairs)
    assert both._jdf.queryExecution().executedPlan().toString().count("CartesianProduct") == 1 and both.count() == n * n
    np.fill_diagonal(value, np.nan)
    assert abs(metrics.largest(rows, "euclidean", block).first().value - np.nanmax(value)) < 1e-9
    assert metrics.largest(rows.limit(0)).first().value is None


def test_copies_have_no_distance():
    x = np.random.default_rng(32).normal(size=(40, 64)) * 1e4
    y = x + 1e-3
    assert (np.diag(metrics.pair_values(x, x.copy(), "euclidean")) == 0).all()
    assert np.allclose(np.diag(metrics.pair_values(x, y, "euclidean")), np.sqrt(((x - y) ** 2).sum(1)), rtol=1e-12)


def test_neighbours_and_votes_shuffle_no_pairs(spark):
    rng = np.random.default_rng(33)
    n = 1500
    x = rng.normal(size=(n, 4))
    x[:400] = x[0]  # one large group of copies
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")
    labels = spark.createDataFrame([(i, i % 3) for i in range(0, n, 2)], "row_id long, cid int")
    found = metrics.Nearest(rows, ("euclidean", 10.0), ("manhattan", 20.0), block=64, labels=labels)
    plan = found.pairs()._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    near = True
    for metric, percent in (("euclidean", 10), ("manhattan", 20)):
        value = metrics.pair_values(x, x, metric)
        np.fill_diagonal(value, np.nan)
        place = n * percent / 100  # of n - 1 others
        v = np.sort(value, 1)[:, int(place) - 1 : int(place) + 1]
        near &= value < (v[:, 0] + (place - int(place)) * (v[:, 1] - v[:, 0]))[:, None]
    assert {(r.i, r.j) for r in found.pairs().collect()} == set(zip(*(z.tolist() for z in np.nonzero(near)), strict=True))
    cid = np.where(np.arange(n) % 2 == 0, np.arange(n) % 3, -1)
    assert {(r.i, r.cid): r.n for r in found.votes().collect()} == {(i, c): int(k) for i in range(n) for c, k in zip(*np.unique(cid[near[i]], return_counts=True), strict=True)}


@pytest.mark.parametrize("metric", ["correlation", "euclidean", "mean_square", "manhattan", "cosine"])
def test_rows_against_queries_go_by_blocks_and_equal_column_metrics(spark, metric):
    rng = np.random.default_rng(34)
    x = rng.normal(size=(90, 7)) * 1e-7
    x[30:60] = x[30:60] * 1e7 + 3e5  # small values, and large ones far from 0
    x[rng.random(x.shape) < 0.2] = np.nan
    x[7], x[8], x[50] = np.nan, 4.0, x[51]
    rows = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")
    found = metrics.against(rows, rows.where("row_id % 5 = 0"), metric, 16)
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.i, r.j): r.value for r in found.collect()}
    other = rows.where("row_id % 5 = 0").select(F.col("row_id").alias("j"), F.col("features").alias("g"))
    want = {(r.row_id, r.j): r.v for r in rows.crossJoin(other).select("row_id", "j", vectors.METRICS[metric]("features", "g").alias("v")).collect()}
    assert got.keys() == want.keys() and len(got) == 90 * 18
    assert all(got[k] is None if want[k] is None else got[k] is not None and abs(got[k] - want[k]) <= 1e-6 * max(1, abs(want[k])) for k in got)


@pytest.mark.parametrize("metric", ["correlation", "cosine"])
def test_first_eigenvector_of_rows_stores_no_pairs(spark, metric, monkeypatch):
    stored = []
    keep = metrics.cut
    for module in (cluster, metrics):
        monkeypatch.setattr(module, "cut", lambda df: stored.append(keep(df)) or stored[-1])
    rng = np.random.default_rng(35)
    x = rng.normal(size=(600, 9)) + rng.normal(size=9) * rng.normal(size=(600, 1))
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = spark.createDataFrame([(7 * i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")
    got = {r.row_id: r.value for r in cluster.first_eigenvector_of(rows, metric).collect()}
    want = np.linalg.eigh(np.nan_to_num(metrics.pair_values(x, x, metric)))[1][:, -1]
    want *= np.sign(want[np.abs(want).argmax()])
    assert np.allclose([got[7 * i] for i in range(600)], want, atol=1e-7)
    assert all(df.count() <= 600 for df in stored)


@pytest.mark.parametrize("metric", ["correlation", "cosine"])
def test_first_eigenvector_of_few_patterns_meets_no_pairs(spark, metric, monkeypatch):
    rng = np.random.default_rng(36)
    x = rng.normal(size=(300, 9)) * 10.0 ** rng.integers(-3, 4, (300, 1)) + rng.normal(size=9) * rng.normal(size=(300, 1))
    for i in range(300):
        x[i, [(i % 7), (i % 7 + 3) % 9]] = np.nan
    x[5], x[6, 1:], x[12, 4:], x[13, :7], x[20] = np.nan, np.nan, np.nan, np.nan, np.where(np.isnan(x[20]), np.nan, 4.0)  # nothing shared, one column, no spread
    rows = spark.createDataFrame([(7 * i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")
    want = np.linalg.eigh(np.nan_to_num(metrics.pair_values(x, x, metric)))[1][:, -1]
    want *= np.sign(want[np.abs(want).argmax()])
    same = lambda got: np.allclose([got[7 * i] for i in range(300)], want, atol=1e-7)
    monkeypatch.setattr(cluster, "SUMS", 50)  # too many patterns: by blocks
    assert same({r.row_id: r.value for r in cluster.first_eigenvector_of(rows, metric).collect()})
    monkeypatch.undo()
    monkeypatch.delattr(cluster, "Blocks")  # products by patterns make no pairs of blocks
    assert same({r.row_id: r.value for r in cluster.first_eigenvector_of(rows, metric).collect()})


def test_eigen_types_meet_no_pairs(spark, monkeypatch):
    from contactloom.plans import queries

    monkeypatch.delattr(cluster, "Blocks")
    path = "/root/testdata/sf0.001"
    got = {r.row_id: r.value for r in queries.QUERIES["m34_eigen_types"](spark, path).collect()}
    pdf = queries.rows(queries.Relations(spark, path)).orderBy("row_id").toPandas()
    x = metrics.matrix_of(pdf.features)
    want = np.linalg.eigh(np.nan_to_num(metrics.pair_values(x, x, "cosine")))[1][:, -1]
    want *= np.sign(want[np.abs(want).argmax()])
    assert np.isnan(x).any() and len(got) == len(x) and np.allclose([got[i] for i in pdf.row_id], want, atol=2e-6)
