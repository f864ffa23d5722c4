"""Interval operators on tracks (chr_idx, x1, x2, cluster_id, ...); intervals are half open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def steps(first: Column, past: Column, width: int) -> Column:
    """first, first + width, ... below past; empty where first >= past (sequence alone would run downwards)."""
    return F.when(first < past, F.sequence(first, past - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))


def split(track: DataFrame, width: int) -> DataFrame:
    """Pieces of `width` from each interval's own start; the last one is clipped."""
    piece = F.explode(steps(F.col("x1"), F.col("x2"), width)).alias("_s")
    out = track.select(*track.columns, piece).withColumn("x2", F.least(F.col("_s") + width, F.col("x2")))
    return out.withColumn("x1", F.col("_s")).drop("_s")


def collapse(track: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adjacent intervals of one cluster become one; a gap, an overlap or another cluster starts anew."""
    keys = [*by, "chr_idx"]
    w = Window.partitionBy(*keys).orderBy("x1", "x2")
    joins = (F.lag("x2").over(w) == F.col("x1")) & (F.lag("cluster_id").over(w) == F.col("cluster_id"))
    island = F.sum(F.when(joins, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return track.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("cluster_id").alias("cluster_id")).drop("_i")


def clip(track: DataFrame, chroms: DataFrame) -> DataFrame:
    """Ends stop at the chromosome's length."""
    length = chroms.select("chr_idx", "length")
    return track.join(length, "chr_idx").withColumn("x2", F.least(F.col("x2").cast("long"), "length").cast("int")).select(*track.columns)


def deduplicate(track: DataFrame, order: str = "line_no", by: tuple[str, ...] = ()) -> DataFrame:
    """I4: of equal intervals the first one in file order stays, whatever its cluster."""
    first = F.min_by(F.struct(*[c for c in track.columns if c not in (*by, "chr_idx", "x1", "x2")]), order).alias("_f")
    return track.groupBy(*by, "chr_idx", "x1", "x2").agg(first).select(*by, "chr_idx", "x1", "x2", "_f.*").select(*track.columns)


def ordered(track: DataFrame) -> DataFrame:
    """Chromosome, start, end."""
    return track.orderBy("chr_idx", "x1", "x2")


def to_bins(track: DataFrame, resolution: int) -> DataFrame:
    """Bins x1 div r to x2 div r, the last one excluded, so a clipped last partial bin gives none."""
    first, past = F.expr(f"cast(x1 div {resolution} as int)"), F.expr(f"cast(x2 div {resolution} as int)")
    return track.withColumn("bin", F.explode(steps(first, past, 1)))


def to_intervals(bins: DataFrame, chroms: DataFrame, resolution: int) -> DataFrame:
    """The interval of each bin (chr_idx, bin), clipped to the chromosome."""
    x1 = (F.col("bin") * resolution).cast("int")
    return bins.join(chroms.select("chr_idx", "length"), "chr_idx").withColumn("x1", x1).withColumn("x2", F.least(F.col("x1").cast("long") + resolution, "length").cast("int")).drop("length")


def relabel(track: DataFrame, names: DataFrame) -> DataFrame:
    """I8: cluster ids and names by a mapping (cluster_id, new_id, new_name); unmapped rows keep theirs."""
    out = track.join(names, "cluster_id", "left")
    return out.withColumn("cluster_name", F.coalesce("new_name", F.col("cluster_id").cast("string"))).withColumn("cluster_id", F.coalesce("new_id", "cluster_id")).drop("new_id", "new_name")


def width_in_bins(track: DataFrame, resolution: int) -> DataFrame:
    """I9."""
    return track.withColumn("width", F.expr(f"cast((x2 - x1) div {resolution} as int)"))


def label_at_start(track: DataFrame) -> DataFrame:
    """One label for each start; of several the last in interval order wins."""
    return track.groupBy("chr_idx", "x1").agg(F.max_by("cluster_id", F.struct("x2", "cluster_id")).alias("cluster_id"))


def isolated(bins: DataFrame) -> DataFrame:
    """Bins (chr_idx, bin, proto) that differ from both neighbours."""
    w = Window.partitionBy("chr_idx").orderBy("bin")
    before, after = F.lag("proto").over(w), F.lead("proto").over(w)
    return bins.where(F.lit(True)).withColumn("_b", before).withColumn("_a", after).where("_b <> proto and _a <> proto").drop("_a", "_b")
