"""Row numbers over whole tables without a task that holds them all."""

from pyspark.sql import functions as F

from contactloom.operators import matrix
from contactloom.runtime import numbered


def test_numbers_follow_the_order_over_parts(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("id"), (F.col("id") % 7).alias("group by"), F.lit(None).cast("int").alias("n")).repartition(6)
    got = numbered(df, F.desc("group by"), "id", first=0).collect()
    want = sorted(((r["group by"], r.id) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    assert [(r["group by"], r.id) for r in sorted(got, key=lambda r: r.place)] == want
    assert sorted(r.place for r in got) == list(range(1000)) and got[0].asDict().keys() == {"id", "group by", "n", "place"}


def test_numbers_of_ties_nulls_and_no_rows(spark):
    ties = spark.createDataFrame([(1,), (1,), (None,), (None,), (0,)], "v int")
    assert sorted((r.k, r.v) for r in numbered(ties, "v", name="k").collect()) == [(1, None), (2, None), (3, 0), (4, 1), (5, 1)]
    assert numbered(ties.limit(0), "v").count() == 0


def test_small_matrix_operators(spark):
    cells = spark.createDataFrame([(0, 0, 5.0), (0, 1, None), (1, 0, -5.0)], "row_id long, col_id int, v double")
    get = lambda df: {(r.row_id, r.col_id): r.v for r in df.collect()}
    assert get(matrix.clamp(cells, -1.0, 2.0)) == {(0, 0): 2.0, (0, 1): None, (1, 0): -1.0}
    assert get(matrix.combined([cells, cells.where("row_id = 0")], 2)) == {(0, 0): 5.0, (0, 1): None, (1, 0): -2.5}
    assert get(matrix.long(matrix.concat(matrix.wide(cells), matrix.wide(cells.where("row_id = 1"))))) == {(1, 0): -5.0, (1, 1): None, (1, 2): -5.0}
