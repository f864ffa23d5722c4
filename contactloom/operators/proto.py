"""M8: proto clusters of each chromosome, from its observed-over-expected map.

Rows of the map that miss too much are left out, rows are compared by cosine, the rows of that
similarity are clustered in length / 50 Mb + 5 groups, small groups go, and every row joins the centre of
map rows that it correlates with most, above 0.3.

Nothing square in the bins of a chromosome is held by a task: rows travel as their present entries, similarities are made tile by
tile (two blocks of rows a task), and Lloyd's iterations pass over rows of similarities for all
chromosomes at once, with only the centres (groups x bins for each chromosome) on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut, prepare
from .metrics import pair_values

CENTRE_BP = 50_000_000
CORRELATION = 0.3
SEED = 93824
ITERATIONS = 20
#: Rows of a block; a task holds two blocks.
BLOCK = 256
Centres = dict[int, np.ndarray]


def map_rows(oe: DataFrame, chroms: DataFrame, resolution: int, good: float) -> DataFrame:
    """(chr_idx, bin, place, width, columns, values) of the rows of the map (chr_idx, bin1, bin2, v) that miss less than the share; place numbers them by chromosome."""
    rows = oe.where("v is not null").groupBy("chr_idx", F.col("bin1").alias("bin")).agg(F.sort_array(F.collect_list(F.struct("bin2", F.col("v").cast("double").alias("v")))).alias("cells"))
    rows = rows.join(F.broadcast(chroms.select("chr_idx", F.expr(f"cast(length div {resolution} + 1 as int)").alias("width"))), "chr_idx")  # a row for each chromosome
    rows = rows.where(1 - F.size("cells") / F.col("width") < good)
    place = (F.row_number().over(Window.partitionBy("chr_idx").orderBy("bin")) - 1).cast("int")
    return rows.select("chr_idx", "bin", place.alias("place"), "width", F.col("cells.bin2").alias("columns"), F.col("cells.v").alias("values"))


def dense(columns: pd.Series, values: pd.Series, width: int) -> np.ndarray:
    out = np.full((len(columns), width), np.nan)
    for i, (c, v) in enumerate(zip(columns, values, strict=True)):
        out[i, np.asarray(c, int)] = v
    return out


def similarities(rows: DataFrame) -> DataFrame:
    """(chr_idx, place, features): cosine of each row with all rows of its chromosome, by place."""
    member = F.struct("place", "columns", "values")
    packed = rows.groupBy("chr_idx", F.expr(f"place div {BLOCK}").alias("b"), "width").agg(F.sort_array(F.collect_list(member)).alias("rows"))
    a = packed.select("chr_idx", "width", F.col("b").alias("b1"), F.col("rows").alias("r1"))
    b = packed.select("chr_idx", F.col("b").alias("b2"), F.col("rows").alias("r2"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chr_idx, width, b1, r1, b2, r2 in pdf[["chr_idx", "width", "b1", "r1", "b2", "r2"]].itertuples(index=False):
                one, two = (dense([r["columns"] for r in side], [r["values"] for r in side], width) for side in (r1, r2))
                tile = pair_values(one, two, "cosine")
                yield pd.DataFrame({"chr_idx": chr_idx, "place": [r["place"] for r in r1], "b": b2, "piece": list(tile)})
                if b1 != b2:
                    yield pd.DataFrame({"chr_idx": chr_idx, "place": [r["place"] for r in r2], "b": b1, "piece": list(tile.T)})

    units = a.join(b, "chr_idx").where("b1 <= b2").repartition("chr_idx", "b1", "b2")
    tiles = units.mapInPandas(run, "chr_idx int, place int, b long, piece array<double>")
    return tiles.groupBy("chr_idx", "place").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("b", "piece"))), lambda x: x["piece"])).alias("features"))


def _assigned(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = pair_values(x, centres, "euclidean")
    return np.where(np.isnan(d), np.inf, d).argmin(1)


def _stacked(features: pd.Series) -> np.ndarray:
    return np.array([np.asarray(f, float) for f in features])


def group_means(rows: DataFrame, of: str, centres: Centres) -> tuple[Centres, dict[int, np.ndarray]]:
    """Means (NaN where no row has an entry) and sizes of the groups of every chromosome.

    `of` says how a row (chr_idx, ...) gives its group and vector: "nearest" takes features and the nearest centre, "given"
    map rows with their group cid.  A task adds up its rows, so one row a task, chromosome and group travels."""
    groups = {c: len(v) for c, v in centres.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for chr_idx, part in pdf.groupby("chr_idx"):
                x = _stacked(part.features) if of == "nearest" else dense(part["columns"], part["values"], int(part["width"].iloc[0]))
                cid = _assigned(x, centres[chr_idx]) if of == "nearest" else part.cid.to_numpy()
                k = groups[chr_idx]
                s, n, size = held.setdefault(chr_idx, (np.zeros((k, x.shape[1])), np.zeros((k, x.shape[1])), np.zeros(k)))
                np.add.at(s, cid, np.nan_to_num(x))
                np.add.at(n, cid, ~np.isnan(x))
                np.add.at(size, cid, 1)
        out = [(c, i, s[i].tolist(), n[i].tolist(), size[i]) for c, (s, n, size) in held.items() for i in range(len(size)) if size[i]]
        yield pd.DataFrame(out, columns=["chr_idx", "cid", "s", "n", "size"])

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, _stacked(part.s).sum(0).tolist(), _stacked(part.n).sum(0).tolist(), part["size"].sum())], columns=["chr_idx", "cid", "s", "n", "size"])

    kind = "chr_idx int, cid int, s array<double>, n array<double>, size double"
    taken = rows.select("chr_idx", "features") if of == "nearest" else rows.select("chr_idx", "cid", "width", "columns", "values")
    means: Centres = {}
    sizes = {c: np.zeros(k, int) for c, k in groups.items()}
    for r in taken.mapInPandas(run, kind).groupBy("chr_idx", "cid").applyInPandas(add, kind).collect():  # a row for each group
        s, n = np.array(r.s), np.array(r.n)
        own = means.setdefault(r.chr_idx, np.full((groups[r.chr_idx], len(s)), np.nan))
        own[r.cid] = np.divide(s, n, out=np.full(len(s), np.nan), where=n > 0)
        sizes[r.chr_idx][r.cid] = int(r["size"])
    return means, sizes


def discover(oe: DataFrame, chroms: DataFrame, resolution: int, least: int = 10, good: float = 0.7) -> DataFrame:
    """(chr_idx, bin, proto) from (chr_idx, bin1, bin2, v).  Unmatched bins stay unmapped; a chromosome with too few rows has none."""
    spark = prepare(oe.sparkSession)
    rows = cut(map_rows(oe, chroms, resolution, good))
    counts = {r.chr_idx: r.n for r in rows.groupBy("chr_idx").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = {r.chr_idx: int(r.length) // CENTRE_BP + 5 for r in chroms.collect()}
    groups = {c: k for c, k in groups.items() if counts.get(c, 0) > k}
    nothing = spark.createDataFrame([], "chr_idx int, bin int, proto int")
    if not groups:
        return nothing
    rows = rows.where(F.col("chr_idx").isin(*groups))
    x = cut(similarities(rows))
    first = {c: np.random.default_rng(SEED).choice(counts[c], k, replace=False).tolist() for c, k in groups.items()}
    wanted = spark.createDataFrame([(c, p) for c, places in first.items() for p in places], "chr_idx int, place int")
    found = {(r.chr_idx, r.place): r.features for r in x.join(F.broadcast(wanted), ["chr_idx", "place"]).collect()}  # a row for each group
    centres = {c: np.array([found[c, p] for p in places], float) for c, places in first.items()}
    for _ in range(ITERATIONS - 1):
        means, sizes = group_means(x, "nearest", centres)
        centres = {c: np.where((sizes[c] > 0)[:, None], means[c], own) for c, own in centres.items()}

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chr_idx, part in pdf.groupby("chr_idx"):
                yield pd.DataFrame({"chr_idx": chr_idx, "place": part.place, "cid": _assigned(_stacked(part.features), centres[chr_idx])})

    members = cut(x.mapInPandas(nearest, "chr_idx int, place int, cid int"))
    means, sizes = group_means(rows.join(members, ["chr_idx", "place"]), "given", centres)
    own = {c: m[sizes[c] > least] for c, m in means.items() if (sizes[c] > least).any()}
    if not own:
        return nothing

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chr_idx, part in pdf.groupby("chr_idx"):
                r = pair_values(dense(part["columns"], part["values"], int(part["width"].iloc[0])), own[chr_idx], "correlation")
                r = np.where(np.isnan(r), -2, r)
                hit = r.max(1) > CORRELATION
                yield pd.DataFrame({"chr_idx": chr_idx, "bin": part.bin[hit], "proto": r.argmax(1)[hit]})

    return offset(cut(rows.where(F.col("chr_idx").isin(*own)).mapInPandas(matched, "chr_idx int, bin int, proto int")))


def offset(local: DataFrame) -> DataFrame:
    """Ids of a chromosome stand behind those of the chromosomes before it."""
    tops = local.groupBy("chr_idx").agg((F.max("proto") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("chr_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(F.broadcast(tops.select("chr_idx", before.alias("_b"))), "chr_idx").select("chr_idx", "bin", (F.col("proto") + F.col("_b")).cast("int").alias("proto"))
