"""Streaming upkeep: replayed and split input gives the rows of the batch operators."""

import random

import pytest

from contactloom.operators import contacts as C
from contactloom.operators import matrix as M
from contactloom.operators import tracks as T
from contactloom.streaming import upkeep


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    cells = {(a, rng.randrange(12), b, rng.randrange(12)) for _ in range(600) for a in (1, 2) for b in (a, 2, 3) if a <= b}
    contacts = spark.createDataFrame([(*c, float(rng.randrange(6))) for c in sorted(cells)], "chr1 int, bin1 int, chr2 int, bin2 int, cnt double")
    labels = spark.createDataFrame([(c, b, rng.randrange(3)) for c in (1, 2, 3) for b in range(10)], "chr_idx int, bin int, cluster_id int")
    tracks = [(t, c, 10 * s, 10 * s + rng.choice([5, 9]), rng.randrange(3)) for t in ("a", "b", "other") for c in (1, 2) for s in range(30) for _ in range(2)]
    return contacts, labels, spark.createDataFrame(tracks, "track_id string, chr_idx int, x1 int, x2 int, cluster_id int")


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())


def kept_of(spark, data, folder, name):
    contacts, labels, tracks = data
    mapping = M.bed_mapping(labels)
    a, b = (tracks.where(f"track_id = '{t}'").drop("track_id") for t in "ab")
    return {
        "a1": (upkeep.scatter_sums(spark, folder, mapping), contacts, M.inter_sums(contacts, mapping)),
        "a3": (upkeep.distance_counts(spark, folder), contacts, C.distance_counts(contacts)),
        "a11": (upkeep.contingency(spark, folder, "a", "b"), tracks, T.contingency(a, b)),
        "a15": (upkeep.densities(spark, folder, labels), contacts, C.densities(contacts, labels)),
    }[name]


@pytest.mark.parametrize("name", ["a1", "a3", "a11", "a15"])
def test_split_and_replayed_batches_give_the_batch_rows(spark, data, tmp_path, name):
    kept, source, batch = kept_of(spark, data, str(tmp_path / "state"), name)
    kept.every = 3
    want = rows_of(batch)
    parts = source.randomSplit([1.0] * 5, 7)
    for i in (0, 1, 1, 2, 0, 3, 2, 3, 4, 4):  # 0 to 2 are in a snapshot when 0 and 2 come again
        kept.apply(parts[i], i)
    assert rows_of(kept.current()) == want and want
    kept.apply(source.limit(0), 5)
    kept.compact()
    kept.compact()
    assert rows_of(kept.current()) == want and not kept._complete("deltas")
    kept.apply(parts[4], 5)  # held by the snapshot
    assert rows_of(kept.current()) == want


def test_a_broken_batch_is_not_counted(spark, data, tmp_path):
    kept, source, _ = kept_of(spark, data, str(tmp_path / "state"), "a3")
    assert kept.current().count() == 0
    kept.apply(source, 0)
    want = rows_of(kept.current())
    kept.apply(source, 1)
    (tmp_path / "state" / "deltas" / "1" / "_SUCCESS").unlink()
    assert rows_of(kept.current()) == want
    kept.apply(source.limit(0), 1)
    assert rows_of(kept.current()) == want


def test_a_stream_goes_on_from_its_checkpoint(spark, data, tmp_path):
    kept, source, batch = kept_of(spark, data, str(tmp_path / "state"), "a1")
    one, two = source.randomSplit([0.5, 0.5], 3)
    one.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept.start(stream()).awaitTermination()
    two.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
    kept.start(stream()).awaitTermination()
    kept.start(stream()).awaitTermination()
    assert rows_of(kept.current()) == rows_of(batch) and len(kept._complete("deltas")) == 5
