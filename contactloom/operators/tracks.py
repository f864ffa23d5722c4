"""Comparing annotations: shared loci, contingency tables, overlap accuracy and the adjusted Rand index."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut
from .intervals import label_at_start, to_bins


def join_tracks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Loci of both tracks by chromosome and start, ids of 0 and above."""
    left = label_at_start(a).where("cluster_id >= 0").withColumnRenamed("cluster_id", "id1")
    right = label_at_start(b).where("cluster_id >= 0").withColumnRenamed("cluster_id", "id2")
    return left.join(right, ["chr_idx", "x1"])


def common_loci(tracks: DataFrame, resolution: int, n_tracks: int) -> DataFrame:
    """Intervals of a multi-track relation (track_id, ...) whose start bin occurs exactly n_tracks times over all."""
    keyed = tracks.withColumn("_bin", F.expr(f"x1 div {resolution}"))
    shared = keyed.groupBy("chr_idx", "_bin").count().where(F.col("count") == n_tracks)
    return keyed.join(shared, ["chr_idx", "_bin"], "left_semi").drop("_bin")


def contingency(a: DataFrame, b: DataFrame, per_chromosome: bool = False) -> DataFrame:
    """Loci by pair of ids."""
    keys = (["chr_idx"] if per_chromosome else []) + ["id1", "id2"]
    return join_tracks(a, b).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def marginals(table: DataFrame) -> DataFrame:
    """Row sums, column sums and the total of a contingency table; side is 1, 2 or 0."""
    g = table.groupingSets([["id1"], ["id2"], []], "id1", "id2").agg(F.sum("n").alias("n"), F.grouping("id1").alias("_g1"), F.grouping("id2").alias("_g2"))
    return g.select(F.when(F.col("_g1") == 0, 1).when(F.col("_g2") == 0, 2).otherwise(0).alias("side"), F.coalesce("id1", "id2").alias("id"), "n")


def top_cell(table: DataFrame) -> DataFrame:
    """The cell with most loci; ties go to smaller ids."""
    return table.orderBy(F.desc("n"), "id1", "id2").limit(1)


def ids(track: DataFrame) -> DataFrame:
    """The ids that occur."""
    return track.select("cluster_id").distinct()


def max_id(track: DataFrame) -> DataFrame:
    """A14."""
    return track.agg(F.max("cluster_id").alias("max_id"))


def choose_two(n):
    """n (n - 1) / 2."""
    return n * (n - 1) / 2.0


def adjusted_rand_index(table: DataFrame) -> DataFrame:
    """One row with the index of a contingency table (id1, id2, n); NULL where it is 0 / 0."""
    cells = table.agg(F.sum(choose_two(F.col("n"))).alias("s"))
    sides = marginals(table).agg(
        F.sum(F.when(F.col("side") == 1, choose_two(F.col("n")))).alias("a"), F.sum(F.when(F.col("side") == 2, choose_two(F.col("n")))).alias("b"),
        F.max(F.when(F.col("side") == 0, F.col("n"))).alias("total"),
    )
    expected = F.try_divide(F.col("a") * F.col("b"), choose_two(F.col("total")))
    # one row against one row
    return cells.join(F.broadcast(sides)).select(F.try_divide(F.col("s") - expected, (F.col("a") + F.col("b")) / 2 - expected).alias("ari"))


def greedy_cells(table: DataFrame, keys: tuple[str, ...] = (), ids: tuple[str, ...] = ("id1", "id2")) -> DataFrame:
    """Cells (keys, ids, n) that are taken by repeatedly choosing the largest one and striking all that share an id with it; ties go to the lowest ids.

    Done in rounds: a cell that comes first among all that share one of its ids is taken whatever happens elsewhere, so all such cells
    of all groups go at once, and what shares an id with them is struck.  The order is total, so this gives the cells of the one-by-one
    choice.  A round takes at least one cell of each group that has any; cells of 0 and below are never taken.  There are at most as many
    rounds as ids of the side with the fewest, which happens where ties chain the cells; counts of loci settle in a few."""
    order = F.struct("n", *[-F.col(i) for i in ids])
    sharing = [Window.partitionBy(*keys, i) for i in ids]
    open_, taken = table.where("n > 0").select(*keys, *ids, "n"), None
    while True:
        marked = open_.withColumn("_first", reduce(and_, [F.max(order).over(w) == order for w in sharing]))
        marked = cut(marked.withColumn("_struck", reduce(or_, [F.max("_first").over(w) for w in sharing])))
        first = marked.where("_first").select(*keys, *ids, "n")
        taken = first if taken is None else taken.union(first)
        open_ = marked.where("not _struck").select(*keys, *ids, "n")
        if open_.isEmpty():
            return taken


def accuracy(table: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of loci on greedily matched ids, for each value of keys (a chromosome, a pair of tracks); a table without rows gives none."""
    table, by = cut(table), keys or (F.lit(0).alias("_all"),)
    parts = table.select(*keys, F.lit(0).alias("m"), "n").union(greedy_cells(table, keys).select(*keys, F.col("n").alias("m"), F.lit(0)))
    sums = parts.groupBy(*by).agg(F.sum("m").cast("long").alias("matched"), F.sum("n").cast("long").alias("total"))
    return sums.select(*keys, "matched", "total", F.try_divide("matched", "total").alias("accuracy"))


def track_pairs(tracks: DataFrame, per_chromosome: bool = False) -> DataFrame:
    """Contingency tables of all pairs i <= j of the tracks in one job."""
    one = label_by_track(tracks)
    a = one.select(F.col("track_id").alias("track1"), "chr_idx", "x1", F.col("cluster_id").alias("id1"))
    b = one.select(F.col("track_id").alias("track2"), "chr_idx", "x1", F.col("cluster_id").alias("id2"))
    keys = ["track1", "track2", *(["chr_idx"] if per_chromosome else []), "id1", "id2"]
    return a.join(b, ["chr_idx", "x1"]).where("track1 <= track2").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def label_by_track(tracks: DataFrame) -> DataFrame:
    last = F.max_by("cluster_id", F.struct("x2", "cluster_id")).alias("cluster_id")
    return tracks.groupBy("track_id", "chr_idx", "x1").agg(last).where("cluster_id >= 0")


def pairwise_accuracy(tracks: DataFrame) -> DataFrame:
    """Accuracy of every pair of tracks, both ways round."""
    half = accuracy(track_pairs(tracks), ("track1", "track2"))
    other = half.where("track1 <> track2").select(F.col("track2").alias("track1"), F.col("track1").alias("track2"), "matched", "total", "accuracy")
    return half.union(other)


def pairwise_ari(tracks: DataFrame) -> DataFrame:
    """Adjusted Rand index of every pair of tracks, both ways round, as one grouped job."""
    t = track_pairs(tracks)
    keys = ["track1", "track2"]
    rows = t.groupBy(*keys, "id1").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(choose_two(F.col("n"))).alias("a"))
    columns = t.groupBy(*keys, "id2").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(choose_two(F.col("n"))).alias("b"))
    cells = t.groupBy(*keys).agg(F.sum(choose_two(F.col("n"))).alias("s"), F.sum("n").alias("total"))
    all_ = cells.join(rows, keys).join(columns, keys)
    expected = F.try_divide(F.col("a") * F.col("b"), choose_two(F.col("total")))
    half = all_.select(*keys, F.try_divide(F.col("s") - expected, (F.col("a") + F.col("b")) / 2 - expected).alias("ari"))
    return half.union(half.where("track1 <> track2").select(F.col("track2").alias("track1"), F.col("track1").alias("track2"), "ari"))


def bins_of(track: DataFrame, resolution: int) -> DataFrame:
    """Cluster of each bin of a track: (chr_idx, bin, cluster_id); the last interval wins."""
    return to_bins(track, resolution).groupBy("chr_idx", "bin").agg(F.max_by("cluster_id", F.struct("x1", "x2", "cluster_id")).alias("cluster_id"))


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))
