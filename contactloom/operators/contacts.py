"""Operators on contacts (chr1, bin1, chr2, bin2, cnt): filters, distance statistics, joins to bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
FAR_BP = 5_000_000
OUTLIER_Z = 5.0
MIN_PER_DISTANCE = 50
COVERAGE_LOW, COVERAGE_HIGH = -3.0, 5.0
MIN_PER_CELL = 10
TRANSLOCATION_HITS = 12


def positive(contacts: DataFrame) -> DataFrame:
    """P4."""
    return contacts.where("cnt > 0")


def far(contacts: DataFrame, resolution: int) -> DataFrame:
    """Positive contacts within a chromosome, more than 5 Mb apart."""
    return positive(contacts).where("chr1 = chr2").where(F.abs(F.col("bin1") - F.col("bin2")) > FAR_BP // resolution)


def by_pair(contacts: DataFrame) -> DataFrame:
    """Sum and number of contacts of each chromosome pair."""
    return contacts.groupBy("chr1", "chr2").agg(F.sum("cnt").alias("s"), F.count(F.lit(1)).alias("n"))


def distance(contacts: DataFrame) -> DataFrame:
    """intra contacts with their distance in bins."""
    return contacts.where("chr1 = chr2").withColumn("dist", F.abs(F.col("bin1") - F.col("bin2")))


def distance_counts(contacts: DataFrame) -> DataFrame:
    """A3: records by chromosome and distance."""
    return distance(contacts).groupBy(F.col("chr1").alias("chr_idx"), "dist").agg(F.count(F.lit(1)).alias("n"))


def distance_stats(contacts: DataFrame) -> DataFrame:
    """A4: mean and sample deviation of the raw counts by chromosome and distance."""
    return distance(contacts).groupBy(F.col("chr1").alias("chr_idx"), "dist").agg(F.avg("cnt").alias("mean"), F.stddev_samp("cnt").alias("sd"))


def valid_distances(counts: DataFrame) -> DataFrame:
    """P5: distances with enough records up to the first gap; the range without its two ends, by chromosome."""
    w = Window.partitionBy("chr_idx").orderBy("dist")
    runs = counts.where(F.col("n") >= MIN_PER_DISTANCE).withColumn("_i", F.col("dist") - F.row_number().over(w))
    first = runs.groupBy("chr_idx", "_i").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")).groupBy("chr_idx").agg(F.min_by(F.struct("lo", "hi"), "lo").alias("r"))
    return first.select("chr_idx", (F.col("r.lo") + 1).alias("first"), (F.col("r.hi") - 1).alias("last"))


def distance_z(contacts: DataFrame) -> DataFrame:
    """Z score of every count within its chromosome and distance, in the valid range; the statistics have a row for each distance."""
    stats = distance_stats(contacts).join(valid_distances(distance_counts(contacts)), "chr_idx").where("dist between first and last").withColumnRenamed("chr_idx", "chr1")
    rows = distance(contacts).join(stats.select("chr1", "dist", "mean", "sd"), ["chr1", "dist"])
    return rows.withColumn("z", F.try_divide(F.col("cnt") - F.col("mean"), "sd")).drop("mean", "sd")


def without_outliers(rows: DataFrame, limit: float = OUTLIER_Z) -> DataFrame:
    """P6."""
    return rows.where(F.abs("z") < limit)


def bad_bins(norm_vec: DataFrame) -> DataFrame:
    """Bins whose coverage is not positive, or whose logarithm is an outlier in its chromosome."""
    v = norm_vec.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    log = F.when(F.col("value") > 0, F.ln("value"))
    stats = v.groupBy("chr_idx").agg(F.avg(log).alias("_m"), F.stddev_samp(log).alias("_s"))
    z = F.try_divide(F.ln("value") - F.col("_m"), "_s")
    good = (F.col("value") > 0) & ~F.coalesce((z < COVERAGE_LOW) | (z > COVERAGE_HIGH), F.lit(False))
    return v.join(stats, "chr_idx").where(~F.coalesce(good, F.lit(False))).select("chr_idx", "bin")


def union_bad(*sets: DataFrame) -> DataFrame:
    """O5."""
    out = sets[0].select("chr_idx", "bin")
    for s in sets[1:]:
        out = out.union(s.select("chr_idx", "bin"))
    return out.distinct()


def mask_near_diagonal(contacts: DataFrame, bins: int) -> DataFrame:
    """Intra cells less than `bins` from the diagonal go."""
    return contacts.where((F.col("chr1") != F.col("chr2")) | (F.abs(F.col("bin1") - F.col("bin2")) >= bins))


def mask_bad(contacts: DataFrame, bad: DataFrame, factor: int = 1) -> DataFrame:
    """Cells in a row or column of a bad bin go; bad bins may be `factor` times finer."""
    coarse = bad.select("chr_idx", F.expr(f"cast(bin div {factor} as int)").alias("bin")).distinct()
    out = contacts
    for i in ("1", "2"):
        out = out.join(coarse.select(F.col("chr_idx").alias(f"chr{i}"), F.col("bin").alias(f"bin{i}")), [f"chr{i}", f"bin{i}"], "left_anti")
    return out.select(*contacts.columns)


def without_pairs(contacts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Contacts outside a set of unordered chromosome pairs."""
    known = pairs.select(F.least("chr1", "chr2").alias("_lo"), F.greatest("chr1", "chr2").alias("_hi")).distinct()
    return contacts.withColumn("_lo", F.least("chr1", "chr2")).withColumn("_hi", F.greatest("chr1", "chr2")).join(known, ["_lo", "_hi"], "left_anti").select(*contacts.columns)


def chromosome_pairs(chroms: DataFrame, diagonal: bool = True) -> DataFrame:
    """Pairs i <= j, or i < j; a dimension against itself."""
    a, b = chroms.select(F.col("chr_idx").alias("chr1")), chroms.select(F.col("chr_idx").alias("chr2"))
    return a.join(b, F.col("chr1") <= F.col("chr2") if diagonal else F.col("chr1") < F.col("chr2"))


def translocations(contacts: DataFrame, cutoffs: DataFrame, bad: DataFrame | None = None, factor: int = 1) -> DataFrame:
    """Chromosome pairs with at least 12 cells above the pair's cutoff (chr1, chr2, cutoff) on good bins."""
    rows = contacts.where("chr1 <> chr2")
    if bad is not None:
        rows = mask_bad(rows, bad, factor)
    hits = rows.join(F.broadcast(cutoffs), ["chr1", "chr2"]).where(F.col("cnt") > F.col("cutoff"))
    return hits.groupBy("chr1", "chr2").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= TRANSLOCATION_HITS)


def both_ends(contacts: DataFrame, labels: DataFrame) -> DataFrame:
    """Contacts whose two bins have an id in labels (chr_idx, bin, cluster_id)."""
    a = labels.select(F.col("chr_idx").alias("chr1"), F.col("bin").alias("bin1"), F.col("cluster_id").alias("id1"))
    b = labels.select(F.col("chr_idx").alias("chr2"), F.col("bin").alias("bin2"), F.col("cluster_id").alias("id2"))
    return contacts.join(a, ["chr1", "bin1"]).join(b, ["chr2", "bin2"])


def areas(labels: DataFrame) -> DataFrame:
    """Number of bin pairs of each pair of ids on each chromosome pair i < j, as a product of counts."""
    n = labels.groupBy("chr_idx", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    a = n.select(F.col("chr_idx").alias("chr1"), F.col("cluster_id").alias("id1"), F.col("n").alias("n1"))
    b = n.select(F.col("chr_idx").alias("chr2"), F.col("cluster_id").alias("id2"), F.col("n").alias("n2"))
    return a.join(b, F.col("chr1") < F.col("chr2")).select("chr1", "chr2", "id1", "id2", (F.col("n1") * F.col("n2")).alias("area"))


def density_sums(contacts: DataFrame, labels: DataFrame) -> DataFrame:
    """Sum of ln(1 + count) by chromosome pair i < j and pair of ids; sums of parts of the contacts may be added."""
    return both_ends(positive(contacts).where("chr1 < chr2"), labels).groupBy("chr1", "chr2", "id1", "id2").agg(F.sum(F.log1p("cnt")).alias("s"))


def per_area(sums: DataFrame, labels: DataFrame) -> DataFrame:
    """Sums over the areas of their pairs of ids; 0 where nothing is seen."""
    all_ = areas(labels).join(sums, ["chr1", "chr2", "id1", "id2"], "left")
    return all_.select("chr1", "chr2", "id1", "id2", F.when(F.col("area") > 0, F.coalesce("s", F.lit(0.0)) / F.col("area")).otherwise(0.0).alias("density"))


def densities(contacts: DataFrame, labels: DataFrame) -> DataFrame:
    """Sum of ln(1 + count) over the area, by chromosome pair i < j and pair of ids."""
    return per_area(density_sums(contacts, labels), labels)


def variation(densities: DataFrame, least: int = 3) -> DataFrame:
    """Coefficient of variation of the positive densities of each ordered pair of ids, more than `least` of them."""
    g = densities.where("density > 0").groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.stddev_samp("density"), F.avg("density")).alias("cv"))
    return g.where(F.col("n") > least).select("id1", "id2", "cv")


def deviation_of_variations(cvs: DataFrame) -> DataFrame:
    """A17."""
    return cvs.agg(F.stddev_samp("cv").alias("sd_cv"))


def dense_ids(labels: DataFrame) -> DataFrame:
    """Cluster ids as 0 .. n - 1; one row for each id."""
    ids = labels.select("cluster_id").distinct()
    return ids.select("cluster_id", (F.dense_rank().over(Window.orderBy("cluster_id")) - 1).cast("int").alias("dense_id"))


def observed_over_expected(contacts: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """ln(count / expected at the distance), both triangles; expected (chr_idx, dist, value) is the mean count unless given."""
    rows = positive(distance(contacts))
    e = expected or rows.groupBy(F.col("chr1").alias("chr_idx"), "dist").agg(F.avg("cnt").alias("value"))
    joined = rows.join(e.withColumnRenamed("chr_idx", "chr1"), ["chr1", "dist"]).select(F.col("chr1").alias("chr_idx"), "bin1", "bin2", F.ln(F.try_divide("cnt", "value")).alias("v"))
    mirror = joined.where("bin1 <> bin2").select("chr_idx", F.col("bin2").alias("bin1"), F.col("bin1").alias("bin2"), "v")
    return joined.union(mirror)


def second_z_block(oe: DataFrame, z: DataFrame, sizes: DataFrame) -> DataFrame:
    """Z scores (chr1, bin1, bin2, z) as columns behind the n bins (chr_idx, n) of each chromosome."""
    one = z.select(F.col("chr1").alias("chr_idx"), "bin1", "bin2", F.col("z").alias("v"))
    both = one.union(one.where("bin1 <> bin2").select("chr_idx", F.col("bin2"), F.col("bin1"), "v"))
    moved = both.join(F.broadcast(sizes), "chr_idx").select("chr_idx", "bin1", (F.col("bin2") + F.col("n")).cast("int").alias("bin2"), "v")
    return oe.union(moved)


def upsample(labels: DataFrame, fine: DataFrame, factor: int) -> DataFrame:
    """Fine bins (chr_idx, bin) take the label of bin div factor."""
    coarse = labels.withColumnRenamed("bin", "_c")
    return fine.withColumn("_c", F.expr(f"cast(bin div {factor} as int)")).join(coarse, ["chr_idx", "_c"]).drop("_c")
