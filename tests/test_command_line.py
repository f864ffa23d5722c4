"""The command line on small files, against the same commands on DataFrames."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.__main__ import command_of, main
from contactloom.operators import matrix, metrics
from contactloom.plans import commands
from contactloom.sources import bed, raw_contacts

R = 1_000_000
CHROMS = [(i, f"chr{i}", 12 * R - 1) for i in (1, 2, 3, 4)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Contacts as raw files and as a table, and two annotations."""
    top, rng = tmp_path_factory.mktemp("line"), random.Random(5)
    rows = [(R, a, i, b, j, float(rng.randrange(1, 9) + 20 * (i % 2 == j % 2))) for a in range(1, 5) for b in range(a, 5) for i in range(12) for j in range(12) if rng.random() < 0.8]
    table = spark.createDataFrame(rows, "resolution int, chr1 int, bin1 int, chr2 int, bin2 int, cnt float")
    chroms = spark.createDataFrame(CHROMS, "chr_idx int, name string, length long")
    raw_contacts.export(table, chroms, str(top / "raw"))
    table.write.parquet(str(top / "table"))
    (top / "sizes").write_text("".join(f"{n}\t{length}\n" for _, n, length in CHROMS))
    for name, of in (("a", lambda c, i: i % 2), ("b", lambda c, i: (i + c) % 3)):
        (top / name).write_text("".join(f"chr{c}\t{i * R}\t{(i + 1) * R}\tL{of(c, i)}\t0\n" for c in range(1, 5) for i in range(11)))
    return top


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())


def test_commands_are_known_by_their_beginning():
    known = {"slice": "slice", "SLICE2": "slice", "direct-slice": "direct", "directslice": "direct", "direct": None, "compare": "compare", "ari-all": "compare", "Shuffle": "shuffle", "cvs": "cvs", "what": None}
    assert {w: command_of(w) for w in known} == known
    for argv, code in ((["what"], 12), (["slice", "x"], 5), (["direct-slice", "x"], 7), (["compare", "a", "b", "c"], 51), (["cvs", "x"], 51), (["shuffle", "x"], 51)):
        with pytest.raises(SystemExit) as e:
            main(argv)
        assert e.value.code == code
    with pytest.raises(SystemExit) as e:
        main(["-V"])
    assert e.value.code == 0


def test_ari_of_files(spark, folder):
    main(["-r", "1000000,500000", "ari", str(folder / "sizes"), str(folder / "ari"), str(folder / "a"), str(folder / "a"), str(folder / "b")])
    got = spark.read.parquet(str(folder / "ari")).collect()
    assert any(abs(r.ari - 1) < 1e-9 for r in got) and all(-1 <= r.ari <= 1 for r in got)


def test_shuffle_writes_scores_and_a_report(spark, folder):
    out = str(folder / "shuffle")
    main(["-r", str(R), "-w", "2", "--seed", "1,7", "shuffle", str(folder / "raw"), f"{folder}/a,{folder}/b", out, "one,two"])
    chroms = spark.createDataFrame(CHROMS, "chr_idx int, name string, length long")
    many = bed.read_many(spark, {"one": f"{folder}/a", "two": f"{folder}/b"}, chroms, R)
    scores, means = commands.block_scores(spark.read.parquet(str(folder / "table")), many, chroms, R, compression=2, seed=7)
    assert rows_of(spark.read.parquet(f"{out}/scores")) == rows_of(scores)
    assert rows_of(spark.read.parquet(f"{out}/means")) == rows_of(means)
    scores, means = scores.collect(), {(r.track_id, r.score_type): r.geometric_mean for r in means.collect()}
    for name in ("one", "two"):
        lines = [r.value for r in spark.read.text(f"{out}/report_{name}").collect()]
        own = {(r.map_type, r.score_type): r for r in scores if r.track_id == name and r.ratio is not None}
        assert len(lines) == len(own) + 2 and own
        for line in lines:
            kind, score, *rest = line.split("\t")
            numbers = [float(re.search(r"[-\d.e+]+$", x)[0]) for x in rest]
            if kind == "geometric mean":
                want = [math.exp(sum(math.log(r.ratio) for (_, s), r in own.items() if s == score) / sum(s == score for _, s in own))]
                assert math.isclose(means[name, score], want[0], rel_tol=1e-9)
            else:
                r = own[kind, score]
                want = [r.shuffled, r.baseline, r.ratio]
            assert all(math.isclose(x, y, rel_tol=1e-5) for x, y in zip(numbers, want, strict=True))


def test_cvs_and_direct_slice(spark, folder):
    main(["-r", str(R), "--genome", str(folder / "sizes"), "cvs", str(folder / "table"), str(folder / "cvs"), f"{folder}/a,{folder}/b", "one,two"])
    chroms = spark.createDataFrame(CHROMS, "chr_idx int, name string, length long")
    track = bed.read(spark, f"{folder}/a", chroms, R)
    table = spark.read.parquet(str(folder / "table"))
    rows, spread = commands.cvs(table, track, R)
    assert rows_of(spark.read.parquet(str(folder / "cvs/one"))) == rows_of(rows) and rows.count()
    assert rows_of(spark.read.parquet(str(folder / "cvs/one_deviation"))) == rows_of(spread)
    with pytest.raises(SystemExit) as e:
        main(["-r", str(R), "cvs", str(folder / "raw"), str(folder / "x"), f"{folder}/a,{folder}/b", "one"])
    assert e.value.code == 53
    main(["-r", str(R), "direct-slice", str(folder / "raw"), str(folder / "a"), str(folder / "direct")])
    got = {(r.i, r.j): (r.l1, r.cosine) for r in spark.read.parquet(str(folder / "direct")).collect()}
    # brute force: sums by row and cluster, coverage, columns and rows with too many gaps dropped, ln(1 + v)
    number = {(c, i): (c - 1) * 11 + i for c in range(1, 5) for i in range(11)}
    x = np.full((44, 8), np.nan)
    for r in table.where("chr1 <> chr2").collect():
        for (c, i), (d, j) in (((r.chr1, r.bin1), (r.chr2, r.bin2)), ((r.chr2, r.bin2), (r.chr1, r.bin1))):
            if (c, i) in number and (d, j) in number:
                col = (d - 1) * 2 + j % 2
                x[number[c, i], col] = np.nan_to_num(x[number[c, i], col]) + r.cnt
    pos = np.nan_to_num(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        y = pos / pos.sum(1, keepdims=True) / pos.sum(0)
    y *= pos.sum() / y.sum()
    y = np.log1p(np.where(pos > 0, y, np.nan))
    l1, cosine = (metrics.pair_values(y, y, m) for m in ("manhattan", "cosine"))
    assert len(got) == 44 * 45 // 2
    assert all(math.isclose(got[i, j][0], l1[i, j], rel_tol=1e-6, abs_tol=1e-9) and math.isclose(got[i, j][1], cosine[i, j], rel_tol=1e-6) for i, j in got)


def test_eigen_tracks_equal_numpy(spark, folder):
    chroms = spark.createDataFrame(CHROMS, "chr_idx int, name string, length long")
    table = spark.read.parquet(str(folder / "table"))
    mapping = matrix.bed_mapping(spark.createDataFrame([(c, i, i % 3) for c in range(1, 5) for i in range(12)], "chr_idx int, bin int, cluster_id int"))
    vectors = spark.createDataFrame([(c, i, 1.0 + (i + c) % 3) for c in range(1, 5) for i in range(12)], "chr_idx int, bin int, value double")
    one = (True, True, True, False)
    where, each = commands.feature_rows(table, vectors, chroms, R, settings=(one,), mapping=mapping)
    rows = [r for _, kind, r in each if kind == "means"][0]
    got = dict(commands.eigen_tracks(table, vectors, chroms, R, settings=(one,), mapping=mapping))
    assert set(got) == {"raw_scaled_log", "raw_scaled_log_twice"}
    value = {(r.chr_idx, r.x1): r.value for r in got["raw_scaled_log"].collect()}
    place = {r.row_id: (r.chr_idx, r.x1) for r in where.collect()}
    x = {r.row_id: [np.nan if v is None else v for v in r.features] for r in rows.collect()}
    ids = sorted(x)
    m = np.nan_to_num(metrics.pair_values(*[np.array([x[i] for i in ids])] * 2, "correlation"))
    want = np.linalg.eigh((m + m.T) / 2)[1][:, -1]
    want *= np.sign(want[np.abs(want).argmax()])
    assert len(value) == len(ids) and np.allclose([value[place[i]] for i in ids], want, atol=1e-6)
    assert got["raw_scaled_log"].where(F.col("value").isNull()).count() == 0
