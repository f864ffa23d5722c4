"""Sources of contacts, vectors and chromosomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Preferred normalisations within and between chromosomes, best first (fixed values).
INTRA_NORMS = ("SCALE", "KR", "VC")
INTER_NORMS = ("INTER_SCALE", "INTER_KR", "INTER_VC", "VC")


def contacts(spark: SparkSession, path: str) -> DataFrame:
    """A contact table, Parquet partitioned by resolution, chr1 and chr2."""
    return spark.read.parquet(path)


def block(table: DataFrame, chr1: int, chr2: int, resolution: int | None = None) -> DataFrame:
    """One chromosome pair, either way round; a missing pair gives no rows. Stored low chromosome first, transposed if asked the other way."""
    low, high = min(chr1, chr2), max(chr1, chr2)
    out = table.where((F.col("chr1") == low) & (F.col("chr2") == high))
    if resolution is not None:
        out = out.where(F.col("resolution") == resolution)
    if chr1 <= chr2:
        return out
    swap = {"chr1": "chr2", "chr2": "chr1", "bin1": "bin2", "bin2": "bin1"}
    return out.select(*[F.col(swap.get(c, c)).alias(c) for c in table.columns])


def normalised(table: DataFrame, norm_vec: DataFrame | None) -> DataFrame:
    """S3: raw counts without a vector, else count / (v1 v2); bins without a positive value drop out."""
    if norm_vec is None:
        return table
    v = norm_vec.where(F.col("value") > 0).where(~F.isnan("value"))
    a = v.select(F.col("chr_idx").alias("chr1"), F.col("bin").alias("bin1"), F.col("value").alias("_v1"))
    b = v.select(F.col("chr_idx").alias("chr2"), F.col("bin").alias("bin2"), F.col("value").alias("_v2"))
    return table.join(a, ["chr1", "bin1"]).join(b, ["chr2", "bin2"]).withColumn("cnt", F.col("cnt") / (F.col("_v1") * F.col("_v2"))).select(*table.columns)


def norm_vector(vectors: DataFrame, norm: str, resolution: int, chr_idx: int | None = None) -> DataFrame:
    """An absent vector gives no rows."""
    out = vectors.where((F.col("norm") == norm) & (F.col("resolution") == resolution))
    return out if chr_idx is None else out.where(F.col("chr_idx") == chr_idx)


def expected_at(expected: DataFrame, dist: int) -> DataFrame:
    """For every pair of chromosomes the smaller expected value at a distance; one row for each chromosome goes in."""
    one = expected.where(F.col("dist") == dist).select("chr_idx", "value")
    a, b = one.select(F.col("chr_idx").alias("chr1"), F.col("value").alias("_a")), one.select(F.col("chr_idx").alias("chr2"), F.col("value").alias("_b"))
    return a.join(b, F.col("chr1") < F.col("chr2")).select("chr1", "chr2", F.least("_a", "_b").alias("cutoff"))


def choose_resolution(table: DataFrame, preferred: int) -> DataFrame:
    """The preferred resolution if it is there, else the largest bin width."""
    return table.agg(F.coalesce(F.max(F.when(F.col("resolution") == preferred, F.col("resolution"))), F.max("resolution")).alias("resolution"))


def chromosomes(spark: SparkSession, path: str) -> DataFrame:
    """A chrom.sizes file (name, length), numbered in file order."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.split("value", "\t").alias("f"))
    from pyspark.sql.window import Window

    return lines.select(F.row_number().over(Window.orderBy("n")).alias("chr_idx"), F.col("f")[0].alias("name"), F.col("f")[1].cast("long").alias("length"))


def pick_norms(available: DataFrame, given: tuple[str, str] | None = None) -> tuple[str | None, str | None]:
    """The given pair, else the first that exists within and between chromosomes. The labels (a handful) come to the driver."""
    if given:
        return given
    have = {r[0] for r in available.select("norm").distinct().limit(1000).collect()}
    return next((n for n in INTRA_NORMS if n in have), None), next((n for n in INTER_NORMS if n in have), None)
