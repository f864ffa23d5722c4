"""Raw contact files: round trips, blocks of every kind, pushed filters."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.sources import raw_contacts as raw

CHROMS = [("chr1", 90_000_000), ("chr2", 60_000_000), ("chr3", 30_000_000)]


def table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for a in (1, 2, 3):
        for b in range(a, 4):
            for width in (1_000_000, 500_000):
                cells = {(int(x), int(y)) for x, y in rng.integers(0, 2500, (400, 2))}
                rows += [(width, a, x, b, y, float(rng.integers(1, 90)) / 2) for x, y in cells]
    return spark.createDataFrame(rows, "resolution int, chr1 int, bin1 int, chr2 int, bin2 int, cnt float")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def exported(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("raw") / "files")
    data = table(spark)
    chroms = spark.createDataFrame([(i + 1, *c) for i, c in enumerate(CHROMS)], "chr_idx int, name string, length long")
    assert raw.export(data, chroms, folder) == 6
    return folder, rows_of(data), chroms


def test_exported_files_come_back(spark, exported, monkeypatch):
    folder, want, chroms = exported
    assert rows_of(raw.contacts(spark, folder)) == want
    assert rows_of(raw.contacts(spark, f"file://{folder}")) == want
    assert rows_of(raw.contacts(spark, f"{folder}/1_2.contacts, {folder}/3_3.contacts")) == [r for r in want if (r[1], r[3]) in {(1, 2), (3, 3)}]
    assert rows_of(raw.chromosomes(spark, folder)) == rows_of(chroms)
    assert {r[0] for r in raw.resolutions(spark, folder).collect()} == {1_000_000, 500_000}


def test_filters_reach_the_index(spark, exported, tmp_path):
    folder, want, _ = exported
    asked = raw.contacts(spark, folder).where("chr1 = 1 and chr2 in (2, 3) and resolution = 500000 and cnt > 20")
    assert rows_of(asked) == [r for r in want if r[0] == 500_000 and r[1] == 1 and r[3] in (2, 3) and r[5] > 20]
    assert asked.rdd.getNumPartitions() == 2
    assert raw.contacts(spark, folder).where("chr1 = 1 and chr1 = 2").count() == 0 and raw.contacts(spark, folder).where("chr2 = 9").count() == 0
    # blocks of pairs that are not asked for may be unreadable
    data = open(f"{folder}/1_2.contacts", "rb").read()
    with open(f"{folder}/1_2.contacts", "rb") as f:
        import pyarrow as pa

        handle = pa.PythonFile(f)
        at = raw.header(handle).pairs[1, 2]
        blocks = raw.index(handle, at)
    broken = bytearray(data)
    for b in blocks[500_000]:
        broken[b["at"] : b["at"] + b["size"]] = b"\0" * int(b["size"])
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1_2.contacts").write_bytes(bytes(broken))
    (tmp_path / "x" / "_SUCCESS").write_bytes(b"")
    got = raw.contacts(spark, str(tmp_path / "x")).where("resolution = 1000000")
    assert rows_of(got) == [r for r in want if (r[0], r[1], r[3]) == (1_000_000, 1, 2)]
    with pytest.raises(Exception, match="incorrect header check|Error -3"):
        raw.contacts(spark, str(tmp_path / "x")).collect()


def test_large_pairs_are_split(exported, monkeypatch):
    folder, want, _ = exported
    monkeypatch.setattr(raw, "PARTITION_BYTES", 2000)
    reader = raw.ContactReader(folder, False)
    parts = reader.partitions()
    assert len(parts) > 12 and sum(len(p.blocks) for p in parts) == len({b for p in parts for b in [(p.path, *x) for x in p.blocks]})
    got = [r for p in parts for batch in reader.read(p) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    assert sorted(got) == want


def test_blocks_of_every_kind_and_version():
    x, y, v = np.array([7, 9, 7]), np.array([3, 3, 5]), np.array([1.5, 2, 4], np.float32)
    for version in raw.VERSIONS:
        assert [a.tolist() for a in raw.cells(raw.encoded(x, y, v, version), version)] == [[7, 9, 7], [3, 3, 5], [1.5, 2, 4]]
    dense = np.array([[1, -32768, 3], [-32768, 5, 6]], "<i2")
    block = zlib.compress(struct.pack("<iiibb", 4, 10, 20, 0, 2) + struct.pack("<ih", 6, 3) + dense.tobytes())
    assert [a.tolist() for a in raw.cells(block, 8)] == [[10, 12, 11, 12], [20, 20, 21, 21], [1, 3, 5, 6]]
    floats = np.array([[0.5, np.nan]], "<f4")
    block = zlib.compress(struct.pack("<iiib", 1, 0, 0, 1) + b"\1\1\2" + struct.pack("<ih", 2, 2) + floats.tobytes())
    assert [a.tolist() for a in raw.cells(block, 9)] == [[0], [0], [0.5]]


def test_version_8_files_and_faults(spark, tmp_path):
    data = raw.file_of(1, 2, {1_000_000: (np.array([4]), np.array([5]), np.array([2.0], np.float32))}, CHROMS, 8)
    (tmp_path / "a.contacts").write_bytes(data)
    assert rows_of(raw.contacts(spark, str(tmp_path / "a.contacts"))) == [(1_000_000, 1, 4, 2, 5, 2.0)]
    (tmp_path / "b.contacts").write_bytes(b"something else")
    with pytest.raises(Exception, match="not a contact file"):
        raw.contacts(spark, str(tmp_path / "b.contacts")).collect()
    with pytest.raises(Exception, match="version 7"):
        (tmp_path / "c.contacts").write_bytes(raw.MAGIC + struct.pack("<iq", 7, 0))
        raw.contacts(spark, str(tmp_path / "c.contacts")).collect()
    (tmp_path / "empty").mkdir()
    assert raw.contacts(spark, str(tmp_path / "empty")).count() == 0
    assert raw.contacts(spark, str(tmp_path / "empty")).select(F.col("cnt")).columns == ["cnt"]
