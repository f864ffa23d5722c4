"""BED tracks: reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.colours import colour
from ..operators.intervals import clip, deduplicate, ordered, split


def fields(lines: DataFrame) -> DataFrame:
    """S9, P1 in part: the rows of lines (line_no, value) that are intervals, with their upper-case label.

    A line needs a first field that starts with chr and at least five fields; label NA is skipped."""
    f = F.split("value", "\t")
    out = lines.select("line_no", f.alias("f")).where((F.size("f") >= 5) & F.col("f")[0].startswith("chr") & (F.upper(F.col("f")[3]) != "NA"))
    return out.select("line_no", F.col("f")[0].alias("name"), F.col("f")[1].cast("int").alias("x1"), F.col("f")[2].cast("int").alias("x2"), F.upper(F.col("f")[3]).alias("cluster_name"))


def plain(rows: DataFrame) -> DataFrame:
    """labels in lower case and chromosome names without their prefix."""
    return rows.select("line_no", F.lower("cluster_name").alias("label"), F.regexp_replace("name", "^chr", "").alias("name"))


def label_ids(rows: DataFrame) -> DataFrame:
    """Labels by order of first appearance; unknown chromosomes count, since labels come first. One row for each label."""
    first = rows.groupBy("cluster_name").agg(F.min("line_no").alias("_l"))
    return first.select("cluster_name", (F.row_number().over(Window.orderBy("_l")) - 1).cast("int").alias("cluster_id"))


def parse(lines: DataFrame, chroms: DataFrame) -> DataFrame:
    """A track from lines (line_no, value)."""
    rows = fields(lines)
    known = rows.join(label_ids(rows), "cluster_name").join(F.broadcast(chroms), "name")
    track = clip(known.select("line_no", "chr_idx", "x1", "x2", "cluster_id", "cluster_name"), chroms)
    return deduplicate(track).drop("line_no")


def read(spark: SparkSession, path: str, chroms: DataFrame, resolution: int | None = None) -> DataFrame:
    """A BED file as a track, split at the resolution if one is given."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")
    track = parse(lines, chroms)
    return split(track, resolution) if resolution else track


def read_many(spark: SparkSession, paths: dict[str, str], chroms: DataFrame, resolution: int | None = None) -> DataFrame:
    """Several files as one relation with a track_id."""
    out = None
    for name, path in paths.items():
        one = read(spark, path, chroms, resolution).withColumn("track_id", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no files")
    return out


def bed9(track: DataFrame, chroms: DataFrame) -> DataFrame:
    """K1: lines of nine tab-separated fields, in interval order."""
    name = F.concat(F.lit("chr"), F.regexp_replace("name", "^chr", ""))
    rows = ordered(track.join(F.broadcast(chroms), "chr_idx"))
    return rows.select(F.concat_ws("\t", name, "x1", "x2", "cluster_name", "cluster_id", F.lit("."), "x1", "x2", colour(F.col("cluster_id"))).alias("value"))


def bed_graph(values: DataFrame, chroms: DataFrame) -> DataFrame:
    """K2: lines of chromosome, start, end, value."""
    name = F.concat(F.lit("chr"), F.regexp_replace("name", "^chr", ""))
    return ordered(values.join(F.broadcast(chroms), "chr_idx")).select(F.concat_ws("\t", name, "x1", "x2", "value").alias("value"))


def null_bed(track: DataFrame, chroms: DataFrame) -> DataFrame:
    """K3: intervals without a cluster."""
    name = F.concat(F.lit("chr"), F.regexp_replace("name", "^chr", ""))
    return ordered(track.join(F.broadcast(chroms), "chr_idx")).select(F.concat_ws("\t", name, "x1", "x2", F.lit("null"), F.lit("null"), F.lit("."), "x1", "x2", F.lit("0,0,0")).alias("value"))


def mapping_dump(bins: DataFrame, chroms: DataFrame, resolution: int, problems: bool) -> DataFrame:
    """K8: lines of the bins below id 0 (problems) or from 0 on, coloured by the absolute id."""
    from ..operators.intervals import to_intervals

    rows = to_intervals(bins.where("proto < 0" if problems else "proto >= 0"), chroms, resolution)
    track = rows.select("chr_idx", "x1", "x2", F.abs("proto").alias("cluster_id"), F.col("proto").cast("string").alias("cluster_name"))
    return bed9(track, chroms)
