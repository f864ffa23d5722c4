"""Arrays written by tasks at their offsets, and read back."""

import os

import numpy as np
import pytest

from contactloom.sources import array_file


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, col_id int, v double")


@pytest.mark.parametrize("stripe", [1, 7, 64, 1 << 20])
def test_any_stripes_give_the_same_file(spark, tmp_path, stripe):
    rng = np.random.default_rng(3)
    want = np.full((37, 11), np.nan)
    rows = [(int(i), int(j), float(rng.normal())) for i in range(37) for j in range(11) if rng.random() < 0.3] + [(36, 10, 2.5)]
    for i, j, v in rows:
        want[i, j] = max(want[i, j], v) if (i, j) == (36, 10) and not np.isnan(want[i, j]) else v
    path = str(tmp_path / "m.npy")
    assert array_file.save(frame(spark, rows).repartition(5), path, stripe) == (37, 11)
    np.testing.assert_array_equal(np.load(path), want)
    assert os.listdir(tmp_path) == ["m.npy"]  # nothing hidden is left
    back = array_file.load(spark, path, stripe)
    assert back.rdd.getNumPartitions() == -(-37 * 11 // stripe)
    got = {(r.row_id, r.col_id): r.v for r in back.collect()}
    assert len(got) == 37 * 11 and all((v is None) == bool(np.isnan(want[k])) and (v is None or v == want[k]) for k, v in got.items())


def test_edges(spark, tmp_path):
    path = str(tmp_path / "m.npy")
    assert array_file.save(frame(spark, []), path) == (0, 0) and np.load(path).shape == (0, 0)
    assert array_file.load(spark, path).count() == 0
    odd = frame(spark, [(None, 1, 1.0), (1, None, 1.0), (2, 1, None), (0, 0, 4.0), (0, 0, 5.0), (0, 0, None), (1, 0, float("nan"))])
    assert array_file.save(odd, path) == (3, 2)  # replaces the file
    np.testing.assert_array_equal(np.load(path), [[5.0, np.nan], [np.nan, np.nan], [np.nan, np.nan]])
    with pytest.raises(ValueError, match="negative"):
        array_file.save(frame(spark, [(-1, 0, 1.0)]), path)
    assert np.load(path).shape == (3, 2) and os.listdir(tmp_path) == ["m.npy"]
    with pytest.raises(Exception, match="seeks"):
        array_file.save(frame(spark, [(0, 0, 1.0)]), "s3://bucket/m.npy")


def test_repeated_attempts_and_missing_stripes(tmp_path):
    import pyarrow as pa

    def batch(stripe, v):
        return pa.record_batch([pa.array([stripe]), pa.array([stripe * 2]), pa.array([v])], names=["stripe", "place", "v"])

    w = array_file.ArrayWriter(str(tmp_path / "m.npy"), 2, 2, 2)
    one, two = w.write(iter([batch(0, 1.0)])), w.write(iter([batch(1, 2.0)]))
    w.write(iter([batch(0, 1.0)]))  # a second attempt, whose message Spark drops
    w.commit([one, two])
    np.testing.assert_array_equal(np.load(tmp_path / "m.npy"), [[1, np.nan], [2, np.nan]])
    w = array_file.ArrayWriter(str(tmp_path / "n.npy"), 2, 2, 2)
    with pytest.raises(ValueError, match="1 of 2"):
        w.commit([w.write(iter([batch(0, 1.0)])), None])
    assert os.listdir(tmp_path) == ["m.npy"]


def test_other_arrays_are_read(spark, tmp_path):
    path = str(tmp_path / "x.npy")
    for want in (np.arange(6, dtype="<f4").reshape(2, 3), np.asfortranarray(np.arange(6).reshape(3, 2)), np.array([1.5, np.nan])):
        np.save(path, want)
        got = {(r.row_id, r.col_id): r.v for r in array_file.load(spark, path, 4).collect()}
        grid = want.reshape(len(want), -1)
        assert got == {(i, j): None if np.isnan(grid[i, j]) else float(grid[i, j]) for i in range(grid.shape[0]) for j in range(grid.shape[1])}
    np.save(path, np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="no matrix"):
        array_file.load(spark, path).count()
