"""Work that is run side by side comes back in order, and does not change annotations."""

import time

import pytest

from contactloom.runtime import side_by_side


def test_order_and_errors(spark):
    def run(i):
        time.sleep(0.05 * (3 - i % 4))
        return spark.range(i).count()

    assert list(side_by_side(spark, run, (i for i in range(9)), 4)) == list(range(9))
    assert list(side_by_side(spark, run, [])) == []
    with pytest.raises(ZeroDivisionError):
        list(side_by_side(spark, lambda i: 1 // i, [1, 0, 2], 2))


def test_threads_keep_the_callers_job_settings(spark):
    sc = spark.sparkContext
    sc.setLocalProperty("spark.job.description", "mine")
    try:
        assert set(side_by_side(spark, lambda _: sc.getLocalProperty("spark.job.description"), range(6), 3)) == {"mine"}
    finally:
        sc.setLocalProperty("spark.job.description", None)
