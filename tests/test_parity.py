"""Registered queries against the same relation in DuckDB, on the smallest tables that fill them."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.01"
#: One query of each kind; the driver compares all of them.
NAMES = (
    "s3_normalised", "s11_bed_track", "k1_bed9", "p2_label_ids", "p5_valid_distances", "p7_bad_bins", "p13_bad_rows_columns", "i1_split", "i2_collapse", "i6_to_bins", "j3_join_tracks",
    "j4_common_loci", "s1_raw_contacts", "s2_raw_block", "s8_chromosomes", "a1_streamed", "a3_streamed", "a11_streamed", "a15_streamed", "m20_block_scores", "a15_densities", "j6_all_pairs_cosine", "j11_best_centre", "a2_guarded_mean", "a5_column_z", "a9_vanilla_coverage", "a13_marginals", "a16_variation", "a24_score_ratios", "a29_accuracy",
    "a30_ari", "m9_global_rows", "m11_matrix_build", "m17_shuffled_index", "m18_partitions", "f5_correlation", "f9_arctanh", "o6_common_neighbours", "j10_nearest", "a34_majority", "m23_two_way_hubs", "m24_three_way_hubs", "m29_statistic", "cmd_compare",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def close(x, y):
    return x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda r: tuple((v is None, v) for v in r)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    theirs = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    theirs = sorted(theirs.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall(), key=key)
    assert ours and len(ours) == len(theirs)
    assert all(all(map(close, a, b)) for a, b in zip(ours, theirs, strict=True))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
