"""Exports round trip."""

import zlib

import numpy as np
import pytest

from contactloom.operators import matrix
from contactloom.sources import exports


def test_arrays_text_and_pictures(spark, tmp_path):
    cells = spark.createDataFrame([(i, j, float(i * 3 + j) if i != j else None) for i in range(4) for j in range(3)], "row_id long, col_id int, v double")
    exports.save_array(cells, str(tmp_path / "m.npy"))
    m = np.load(tmp_path / "m.npy")
    assert m.shape == (4, 3) and np.isnan(m[1, 1]) and m[3, 2] == 11
    assert [r.value for r in exports.text_matrix(matrix.wide(cells)).collect()][1] == "3.0 NaN 5.0"
    exports.heat_map(cells, str(tmp_path / "m.png"), log=True)
    data = (tmp_path / "m.png").read_bytes()
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")])
    assert len(raw) == 200 * (1 + 150 * 3)
    with pytest.raises(ValueError):
        exports.dense(cells, most=5)


def test_cluster_statistics(spark):
    centres = spark.createDataFrame([(0, [1.0, 5.0, 9.0, 2.0]), (1, [2.0, 5.0, 8.0, 1.0])], "cid int, centre array<double>")
    members = spark.createDataFrame([(i, i % 2) for i in range(7)], "row_id long, cid int")
    r = exports.cluster_statistics(members, centres).first()
    assert (r.n1, r.n2, r.n_similar) == (4, 3, 1) and r.statistic > 0 and 0 < r.p < 1
