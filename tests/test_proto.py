"""Proto clusters by tiles against the same steps on whole maps in numpy."""

import numpy as np
import pytest

from contactloom.operators import proto
from contactloom.operators.metrics import pair_values

R = 1_000_000


def whole_map(m, k, least, good=0.7):
    """(bin, group) of one chromosome, on the square map."""
    kept = np.flatnonzero(np.isnan(m).mean(1) < good)
    if len(kept) <= k:
        return []
    x = pair_values(m[kept], m[kept], "cosine")
    centres = x[np.random.default_rng(proto.SEED).choice(len(x), k, replace=False)]
    for _ in range(20):
        cid = pair_values(x, centres, "euclidean").argmin(1)
        centres = np.array([x[cid == c].mean(0) if (cid == c).any() else centres[c] for c in range(k)])
    with np.errstate(all="ignore"):
        own = [np.nanmean(m[kept][cid == c], 0) for c in range(k) if (cid == c).sum() > least]
    if not own:
        return []
    r = np.nan_to_num(pair_values(m[kept], np.array(own), "correlation"), nan=-2)
    return [(int(b), int(v.argmax())) for b, v in zip(kept, r, strict=True) if v.max() > 0.3]


@pytest.mark.parametrize("block", [7, 256])
def test_tiles_equal_the_whole_map(spark, monkeypatch, block):
    monkeypatch.setattr(proto, "BLOCK", block)
    rng = np.random.default_rng(3)
    chroms, cells, want, behind = [], [], [], 0
    for c, n in ((1, 60), (2, 75), (3, 4), (4, 50)):
        kinds = rng.integers(0, 3, n)
        m = 1 + 2.0 * (kinds[:, None] == kinds[None, :]) + rng.random((n, n)) / 5
        m = (m + m.T) / 2
        gone = rng.random((n, n)) < 0.1
        m[gone | gone.T] = np.nan
        m[5 : 5 + c] = np.nan  # rows that miss everything
        m[:, 5 : 5 + c] = np.nan
        if c == 4:
            m[:40] = np.nan  # ten rows left, of which groups are too small
        length = n * R - 1
        chroms.append((c, f"chr{c}", length))
        cells += [(c, i, j, float(m[i, j])) for i in range(n) for j in range(n) if not np.isnan(m[i, j])]
        found = whole_map(m, length // proto.CENTRE_BP + 5, 5)
        want += [(c, b, p + behind) for b, p in found]
        behind += max((p for _, p in found), default=-1) + 1
    oe = spark.createDataFrame(cells, "chr_idx int, bin1 int, bin2 int, v double").repartition(5)
    got = proto.discover(oe, spark.createDataFrame(chroms, "chr_idx int, name string, length long"), R, least=5)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({w[0] for w in want}) == 2
    assert proto.discover(oe.limit(0), spark.createDataFrame(chroms, "chr_idx int, name string, length long"), R).count() == 0
