"""Scores of sparse maps against the same scores of the full grid."""

import math
import random

import pytest
from pyspark.sql import functions as F

from contactloom.operators import scoring as S


@pytest.fixture(scope="module")
def maps(spark):
    """A map with unseen regions, one without any contact, one whose cells are all seen."""
    rng = random.Random(3)
    blocks, means = [], []
    for kind, share in (("some", 0.3), ("none", 0.0), ("all", 1.1)):
        a, b = [[(i, rng.randrange(3)) for i in range(n)] for n in (9, 7)]
        for side, own in (("A", a), ("B", b)):
            blocks += [(kind, side, r, 1, i, c, i) for r in (0, 1) for i, c in own]
        means += [(kind, i, j, rng.random() * 5 + 0.1) for i, c in a for j, d in b if rng.random() < share and (kind == "all" or c != 0 or d != 1)]
    blocks = spark.createDataFrame(blocks, "map_type string, side string, round int, chr_idx int, bin int, cluster_id int, block int")
    return blocks, spark.createDataFrame(means, "map_type string, brow int, bcol int, v double")


def near(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


@pytest.mark.parametrize("symmetric", [False, True])
def test_sparse_scores_equal_those_of_the_grid(maps, symmetric):
    m, full = S.block_map(*maps), S.grid(*maps)
    for regional in (False, True):
        sparse = {r.map_type: r for r in S.map_scores(m, regional, symmetric).collect()}
        strict = {r.map_type: r.kl for r in S.map_scores(m, regional, symmetric, strict=True).collect()}
        for name, score in S.SCORES.items():
            dense = {r.map_type: r.score for r in score(full, regional, symmetric).collect()}
            assert set(sparse) == set(dense) == {"some", "none", "all"}
            assert all(near(sparse[k][name], dense[k]) for k in dense), (name, regional)
        dense = {r.map_type: r.score for r in S.divergence_score(full, regional, symmetric, strict=True).collect()}
        assert all(near(strict[k], dense[k]) for k in dense) and strict["some"] is None and strict["all"] is not None
    want = {(r.map_type, r.r1, r.r2): (r.s, r.n) for r in S.regions(full, symmetric).collect()}
    got = {(r.map_type, r.r1, r.r2): (r.s, r.n) for r in S.map_regions(m, symmetric=symmetric).collect()}
    assert set(got) == set(want) and all(near(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)
    want = {(r.map_type, r.score_type): r.ratio for r in S.ratios(full, symmetric).collect()}
    got = {(r.map_type, r.score_type): r.ratio for r in S.map_ratios(m, symmetric).collect()}
    assert set(got) == set(want) and all(near(got[k], want[k]) for k in want)


def test_no_pairs_of_blocks_are_listed(maps):
    plan = S.map_ratios(S.block_map(*maps))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert S.map_scores(S.BlockMap(*(f.where(F.lit(False)) for f in (S.block_map(*maps).cells, S.block_map(*maps).sizes)))).count() == 0
